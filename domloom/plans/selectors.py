"""CSS selectors: text to a small tree, shared by the plan compiler and the in-tree matcher."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


class SelectorError(ValueError):
    """A selector that isn't one."""


@dataclass(frozen=True)
class Simple:
    """kind: tag, any, id, class, attr or pseudo. For attr, op and value; for pseudo, arg is text or a Selector."""

    kind: str
    name: str = ""
    op: str | None = None
    value: str | None = None
    arg: object = None


@dataclass(frozen=True)
class Complex:
    """Compounds from left to right, and the combinator before each (None before the first)."""

    steps: tuple[tuple[str | None, tuple[Simple, ...]], ...]


@dataclass(frozen=True)
class Selector:
    options: tuple[Complex, ...]


PSEUDOS = frozenset("first-child last-child only-child first-of-type last-of-type only-of-type empty root".split())
WITH_ARGUMENT = frozenset(["nth-child", "nth-of-type", "not", "contains"])
_IDENT = re.compile(r"(?:[A-Za-z_\u0080-\U0010ffff-]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*")
_SPACE = re.compile(r"[ \t\n\r\f]*")
_ATTR = re.compile(r"""\[\s*(?P<name>[^\s=~|^$*\]"']+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>(?:[^'\\]|\\.)*)'|(?P<u>[^\]\s"']+))\s*)?\]""")


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def nth(expression: str) -> tuple[int, int] | None:
    """(a, b) of an+b; None if it isn't one."""
    e = re.sub(r"\s", "", expression.lower())
    if e in ("odd", "even"):
        return (2, 1) if e == "odd" else (2, 0)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", e)
    if not e or not m or (m[1] is None and m[2] is None):
        return None
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    if m[1] is not None and m[2] is not None and m[2][0] not in "+-":
        return None
    return a, int(m[2] or 0)


def _name(s: str, i: int, what: str) -> tuple[str, int]:
    m = _IDENT.match(s, i)
    if not m:
        raise SelectorError(f"expected {what} at {i} in {s!r}")
    return _unescape(m[0]), m.end()


def _closing(s: str, i: int) -> int:
    """The place of the parenthesis that closes the one before i."""
    depth, quote = 1, ""
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1
    raise SelectorError(f"unclosed parenthesis in {s!r}")


def _compound(s: str, i: int) -> tuple[tuple[Simple, ...], int]:
    out: list[Simple] = []
    while i < len(s):
        c = s[i]
        if c == "*" and not out:
            out.append(Simple("any"))
            i += 1
        elif c in "#.":
            name, i = _name(s, i + 1, "a name")
            out.append(Simple("id" if c == "#" else "class", name))
        elif c == "[":
            m = _ATTR.match(s, i)
            if not m:
                raise SelectorError(f"bad attribute test at {i} in {s!r}")
            value = next((_unescape(v) for v in (m["d"], m["s"], m["u"]) if v is not None), None)
            out.append(Simple("attr", m["name"].lower(), m["op"], value))
            i = m.end()
        elif c == ":":
            name, i = _name(s, i + 1, "a pseudo-class")
            name, arg = name.lower(), None
            if i < len(s) and s[i] == "(":
                end = _closing(s, i + 1)
                raw, i = s[i + 1 : end].strip(), end + 1
                if name == "not":
                    arg = parse(raw) if raw else Selector(())
                elif name == "contains":
                    arg = _unescape(raw[1:-1]) if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'" else raw
                    if not raw:
                        raise SelectorError(":contains needs text")
                else:
                    arg = raw
            if name not in PSEUDOS | WITH_ARGUMENT or (name in WITH_ARGUMENT and arg is None):
                raise SelectorError(f"unknown pseudo-class :{name}")
            out.append(Simple("pseudo", name, arg=arg))
        elif not out and _IDENT.match(s, i):
            name, i = _name(s, i, "a tag")
            out.append(Simple("tag", name.lower()))
        else:
            break
    if not out:
        raise SelectorError(f"expected a selector at {i} in {s!r}")
    return tuple(out), i


@lru_cache(maxsize=512)
def parse(css: str) -> Selector:
    s = css.strip()
    if not s:
        raise SelectorError("empty selector")
    options, i = [], 0
    while i < len(s):
        steps: list[tuple[str | None, tuple[Simple, ...]]] = []
        combinator = None
        while True:
            compound, i = _compound(s, i)
            steps.append((combinator, compound))
            j = _SPACE.match(s, i).end()
            if j >= len(s) or s[j] == ",":
                i = j
                break
            if s[j] in ">+~":
                combinator, i = s[j], _SPACE.match(s, j + 1).end()
                if i >= len(s):
                    raise SelectorError(f"nothing after {combinator!r} in {s!r}")
            elif j > i:
                combinator, i = " ", j
            else:
                raise SelectorError(f"unexpected {s[j]!r} at {j} in {s!r}")
        options.append(Complex(tuple(steps)))
        if i < len(s):
            i = _SPACE.match(s, i + 1).end()
    return Selector(tuple(options))
