"""Character references."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5

REFERENCE = re.compile(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?|#[xX]?)")
LONGEST = max(map(len, html5))


@lru_cache(maxsize=4096)
def numeric(code: int) -> str:
    if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return "�"
    if 0x80 <= code < 0xA0:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return chr(code)


def decode(text: str, attribute: bool = False, errors: list | None = None, base: int = 0, open_too: bool = True) -> str:
    """text with its references replaced; in attributes, one without ';' before '=' or a letter or digit stays, and without
    open_too each one without ';' does."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        ref = m[0]
        if ref[1] == "#":
            digits = ref[2:].rstrip(";")
            hexadecimal = digits[:1] in ("x", "X")
            if hexadecimal:
                digits = digits[1:]
            if not digits:
                note("absence-of-digits-in-numeric-character-reference", m)
                return ref
            code = int(digits, 16 if hexadecimal else 10)
            if not ref.endswith(";"):
                note("missing-semicolon-after-character-reference", m)
                if not open_too:
                    return ref
            if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000 or 0x80 <= code < 0xA0 or (code < 0x20 and code not in (9, 10, 12)) or code == 0x7F:
                note("control-character-reference", m)
            elif 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
                note("noncharacter-character-reference", m)
            return numeric(code)
        body = ref[1:]
        got = html5.get(body)
        if got is not None and body[-1] == ";":
            return got
        for n in range(min(len(body), LONGEST), 1, -1):
            name = body[:n]
            if name in html5:
                after = body[n:] or text[m.end() : m.end() + 1]
                if attribute and name[-1] != ";" and (after[:1] == "=" or after[:1].isascii() and after[:1].isalnum()):
                    return ref
                if name[-1] != ";":
                    note("missing-semicolon-after-character-reference", m)
                    if not open_too:
                        return ref
                return html5[name] + body[n:]
        return ref

    def note(code: str, m: re.Match) -> None:
        if errors is not None:
            errors.append((code, base + m.start()))

    return REFERENCE.sub(one, text)
