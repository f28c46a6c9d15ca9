"""HTML output: compact, or laid out on lines without changing what white space means."""

from __future__ import annotations

import re


from .dom import Node
from .names import SPECIAL, VOID_OUTPUT

#: Levels that are indented; deeper ones stand as far in as the last. 100,000 nested elements would print 10 GB of blanks.
INDENTED = 1000
PRESERVING = frozenset("pre textarea code script style".split())
#: Elements that are laid out as blocks. Fixed values.
LAYOUT = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe li listing main marquee menu nav noframes noscript ol p
    plaintext pre search section summary table tbody td tfoot th thead tr ul""".split()
)


def escape_text(s: str | None) -> str:
    return (s or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(name: str, attrs: dict[str, str | None] | None) -> str:
    out = [f"<{name}"]
    for k, v in (attrs or {}).items():
        if v is None or v == "" or v.lower() == k.lower():
            out.append(f" {k}")
        elif '"' in v and "'" not in v:
            out.append(f" {k}='" + v.replace("&", "&amp;") + "'")
        else:
            out.append(f' {k}="' + v.replace("&", "&amp;").replace('"', "&quot;") + '"')
    out.append(">")
    return "".join(out)


def _children(n: Node) -> list[Node]:
    if n.name == "template" and n.ns in (None, "html") and n.content is not None:
        return n.content.children
    return n.children


def compact(root: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name == "#text":
            out.append(escape_text(n.data))
        elif n.name == "#comment":
            out.append(f"<!--{n.data or ''}-->")
        elif n.name == "!doctype":
            out.append("<!DOCTYPE html>")
        elif n.name[0] == "#":
            stack += n.children[::-1]
        else:
            out.append(start_tag(n.name, n.attrs))
            if n.name not in VOID_OUTPUT:
                stack.append(f"</{n.name}>")
                stack += _children(n)[::-1]
    return "".join(out)


def squeeze(s: str) -> str:
    """Runs of HTML white space to one space, ends trimmed."""
    return re.sub(r"[ \t\n\f\r]+", " ", s).strip(" ") if "\v" in s else " ".join(s.split())


def tidy(s: str) -> str:
    """Runs of white space that hold a line break or tab become one space; runs of spaces alone stay. Such a run at an end
    goes if the text begins or ends with the break itself."""
    if not re.search(r"[\n\r\t\f]", s):
        return s
    out = re.sub(r"[ \n\r\t\f]+", lambda m: m[0] if m[0].strip(" ") == "" else " ", s)
    breaks = "\n\r\t\f"
    if s[0] in breaks and out.startswith(" "):
        out = out[1:]
    if s[-1] in breaks and out.endswith(" "):
        out = out[:-1]
    return out


def _blank(n: Node) -> bool:
    return n.name == "#text" and not (n.data or "").strip()


def _is_break(data: str) -> bool:
    return bool(data) and (bool(re.search(r"[\n\r\t\f]", data)) or len(data) > 2)


#: A rendering in parts: strings, and the parts of children. Joined once, at the end.
Parts = list


def _joined(parts: Parts) -> str:
    out: list[str] = []
    stack = [iter(parts)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            out.append(x)
        else:
            stack.pop()
    return "".join(out)


def _by_lines(lines: list) -> Parts:
    out: Parts = []
    for line in lines:
        out += ["\n", line] if out else [line]
    return out


class _Layout:
    """Renderers are generators: they yield (child, depth) and are sent its parts, so trees of any depth need no recursion."""

    def __init__(self, size: int):
        self.size = size
        self.has: dict[tuple[int, int], bool] = {}

    def contains(self, n: Node, which: int) -> bool:
        """Whether n is, or holds, an element of a set: 0 the special ones, 1 the layout blocks."""
        names = LAYOUT if which else SPECIAL
        if not n.is_element:
            return False
        stack = [(n, False)]
        while stack:
            c, again = stack.pop()
            key = (id(c), which)
            if key in self.has:
                continue
            kids = [k for k in c.children if k.is_element]
            if again or c.name in names or not kids:
                self.has[key] = c.name in names or any(self.has.get((id(k), which), False) for k in kids)
            else:
                stack.append((c, True))
                stack += [(k, False) for k in kids]
        return self.has[id(n), which]

    def pad(self, depth: int) -> str:
        return " " * (min(depth, INDENTED) * self.size)

    def run(self, n: Node) -> str:
        stack, sent = [self.render(n, 0)], None
        while True:
            try:
                stack.append(self.render(*stack[-1].send(sent)))
                sent = None
            except StopIteration as done:
                stack.pop()
                sent = done.value
                if not stack:
                    return _joined(sent)

    def render(self, n: Node, depth: int):
        pad = self.pad(depth)
        name = n.name
        if name == "#text":
            data = (n.data or "").strip()
            return [pad + escape_text(data)] if data else []
        if name == "#comment":
            return [f"{pad}<!--{n.data or ''}-->"]
        if name == "!doctype":
            return [f"{pad}<!DOCTYPE html>"]
        if name[0] == "#":
            lines = []
            for c in n.children:
                if x := (yield c, depth):
                    lines.append(x)
            return _by_lines(lines)
        head, tail = pad + start_tag(name, n.attrs), f"</{name}>"
        if name in VOID_OUTPUT:
            return [head]
        kids = _children(n)
        if not kids:
            return [head + tail]
        if name in PRESERVING:
            return [head, *map(compact, kids), tail]
        if all(c.name == "#text" for c in kids):
            return [head + escape_text(squeeze("".join(c.data or "" for c in n.children))) + tail]
        layouts = (self._lines, self._runs, self._mixed, self._spaced) if name in SPECIAL else ()
        for k, layout in enumerate(layouts):
            if k == 2 and self._safe(kids):
                break
            lines = yield from layout(kids, depth + 1)
            if lines is not None:
                return _by_lines([head, *lines, pad + tail])
        if self._safe(kids):
            lines = yield from self._lines(kids, depth + 1)
            return _by_lines([head, *(lines or ()), pad + tail])
        inline = yield from self._inline(kids)
        return [head, *inline, tail]

    def _safe(self, kids: list[Node]) -> bool:
        """Whether every child may stand on a line of its own: no text, no comment, no two inline neighbours."""
        if any(c.name == "#comment" or (c.name == "#text" and not _blank(c)) for c in kids):
            return False
        blocky = [self.contains(c, 0) for c in kids if c.name != "#text"]
        if len(blocky) == 1:
            return blocky[0]
        return all(a or b for a, b in zip(blocky, blocky[1:], strict=False))

    def _lines(self, kids: list[Node], depth: int):
        """Elements alone: a line each."""
        if any(c.name == "#comment" or (c.name == "#text" and not _blank(c)) for c in kids):
            return None
        lines = []
        for c in kids:
            if not _blank(c) and (x := (yield c, depth)):
                lines.append(x)
        return lines or None

    def _runs(self, kids: list[Node], depth: int):
        """The author's breaks between siblings stay breaks; what stands between two is a line."""
        if any(c.name == "#comment" for c in kids):
            return None
        gap = lambda c: _blank(c) and _is_break(c.data or "")
        if not any(gap(c) for c in kids[1:-1]):
            return None
        runs: list[list[Node]] = [[]]
        for c in kids:
            if gap(c):
                runs.append([])
            else:
                runs[-1].append(c)
        runs = [r for r in runs if r]
        if any(len(run) > 1 and any(self.contains(c, 0) for c in run) for run in runs):
            return None
        lines = []
        for run in runs:
            if len(run) == 1 and run[0].name != "#text":
                lines.append((yield run[0], depth))
                continue
            parts: Parts = [self.pad(depth)]
            for c in run:
                if c.name == "#text":
                    parts.append((c.data or "") if _blank(c) else escape_text(tidy(c.data)))
                else:
                    parts.append((yield c, 0))
            lines.append(parts)
        return lines or None

    def _mixed(self, kids: list[Node], depth: int):
        """Text beside blocks: each block and each inline run on its line."""
        if any(c.name == "#comment" for c in kids) or not any(self.contains(c, 1) for c in kids) or not any(c.name == "#text" and not _blank(c) for c in kids):
            return None
        pad, lines, run = self.pad(depth), [], []

        def flush() -> None:
            while run and isinstance(run[0], str) and not run[0].lstrip(" "):
                run.pop(0)
            while run and isinstance(run[-1], str) and not run[-1].rstrip(" "):
                run.pop()
            if run:
                if isinstance(run[0], str):
                    run[0] = run[0].lstrip(" ")
                if isinstance(run[-1], str):
                    run[-1] = run[-1].rstrip(" ")
                lines.append([pad, *run])
            run.clear()

        for i, c in enumerate(kids):
            if _blank(c):
                data = c.data or ""
                if i in (0, len(kids) - 1):
                    continue
                if re.search(r"[\n\r\t]", data) or len(data) > 2:
                    flush()
                else:
                    run.append(data)
            elif c.name == "#text":
                run.append(escape_text(tidy(c.data)))
            elif self.contains(c, 1):
                flush()
                if x := (yield c, depth):
                    lines.append(x)
            else:
                run.append((yield c, 0))
        flush()
        return lines

    def _spaced(self, kids: list[Node], depth: int):
        """Elements that white space already parts, with text after the last at most: a line each."""
        at = [i for i, c in enumerate(kids) if c.name != "#text"]
        if not at or any(c.name == "#comment" for c in kids):
            return None
        parted = any(any(_blank(x) for x in kids[a + 1 : b]) for a, b in zip(at, at[1:], strict=False))
        if not parted or any(c.name == "#text" and not _blank(c) for c in kids[: at[-1]]):
            return None
        lines = []
        for c in kids:
            if c.name != "#text":
                if x := (yield c, depth):
                    lines.append(x)
            elif x := squeeze(c.data or ""):
                lines.append([self.pad(depth) + escape_text(x)])
        return lines or None

    def _inline(self, kids: list[Node]):
        parts: Parts = []
        for i, c in enumerate(kids):
            if c.name != "#text":
                parts.append((yield c, 0))
                continue
            data = c.data or ""
            if _blank(c):
                if i in (0, len(kids) - 1):
                    continue
                if re.search(r"[\n\r\t]", data) or len(data) > 2:
                    parts.append(" ")
                    continue
            parts.append(escape_text(tidy(data)))
        return parts


def render(root: Node, pretty: bool = True, indent_size: int = 2) -> str:
    """HTML of a tree, of any depth."""
    if not pretty:
        return compact(root)
    if root.name == "#document":
        return "\n".join(x for c in root.children if (x := _Layout(indent_size).run(c)))
    return _Layout(indent_size).run(root)
