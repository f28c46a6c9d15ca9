"""Trees as indented text, one node a line, as conformance suites write them."""

from __future__ import annotations

from .dom import Node

_SPACED = {"xlink", "xml", "xmlns"}


def dump(root: Node) -> str:
    lines: list[str] = []
    stack = [(c, 0) for c in reversed(root.children)] if root.name[0] == "#" and root.name.startswith("#document") else [(root, 0)]
    while stack:
        n, depth = stack.pop()
        pad = "| " + "  " * depth
        if n.name == "#text":
            lines.append(f'{pad}"{n.data}"')
        elif n.name == "#comment":
            lines.append(f"{pad}<!-- {n.data} -->")
        elif n.name == "!doctype":
            name, public, system, _ = n.doctype or (None, None, None, False)
            more = f' "{public or ""}" "{system or ""}"' if public or system else ""
            lines.append(f"{pad}<!DOCTYPE {name or ''}{more}>")
        elif n.name == "#document-fragment":
            lines.append(f"{pad}content")
        else:
            lines.append(f"{pad}<{n.ns + ' ' if n.ns not in (None, 'html') else ''}{n.name}>")
            shown = []
            for k, v in (n.attrs or {}).items():
                if n.ns not in (None, "html") and k.split(":")[0] in _SPACED and ":" in k:
                    k = k.replace(":", " ", 1)
                shown.append(f'{pad}  {k}="{v or ""}"')
            lines += sorted(shown)
        stack += [(c, depth + 1) for c in reversed(n.children)]
        if n.content is not None:
            stack.append((n.content, depth + 1))
    return "\n".join(lines)
