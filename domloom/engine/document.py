"""One parsed document, and its rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from . import html as _html
from . import text as _text
from .builder import Builder
from .dom import Node
from .dump import dump
from .edits import apply_and_tell, quotes_source
from .encoding import decode
from .messages import message
from .policy import ESCAPE, SanitizationPolicy, sanitize


class StrictModeError(SyntaxError):
    """The first parse error, in strict mode."""


@dataclass
class Options:
    fragment: tuple[str, str | None] | None = None
    transforms: Sequence = ()
    safe: bool = True
    policy: SanitizationPolicy | None = None
    pretty: bool = True
    indent_size: int = 2
    separator: str = " "
    strip: bool = True
    collect_errors: bool = False
    locations: bool = False
    strict: bool = False
    iframe_srcdoc: bool = False
    xml_coercion: bool = False
    discard_bom: bool = True
    #: Whether references without ';' are decoded, as the standard has it.
    open_references: bool = True
    initial_state: str = "data"
    last_start_tag: str = ""
    compiled: list = field(default_factory=list)


class Document:
    def __init__(self, source: str | bytes | None, options: Options, transport: str | None = None):
        self.options, self.encoding = options, None
        if isinstance(source, bytes):
            source, self.encoding = decode(source, transport)
        # Escaped tags are quoted from the source, so their places are kept.
        quoting = (options.safe and options.policy is not None and options.policy.disallowed_tag_handling == ESCAPE) or any(map(quotes_source, options.compiled))
        builder = Builder(
            source or "", fragment=options.fragment, locations=options.locations or quoting, collect_errors=options.collect_errors or options.strict,
            iframe_srcdoc=options.iframe_srcdoc, xml_coercion=options.xml_coercion, discard_bom=options.discard_bom, open_references=options.open_references,
        )
        self.root = builder.parse()
        self.quirks, self.lexer = builder.quirks, builder.lexer
        found = [("tokenizer", c, p, None) for c, p in builder.lexer.errors or ()] + [("treebuilder", c, p, n) for c, p, n in builder.errors]
        self.errors: list[dict] = []
        for category, code, pos, name in sorted(found, key=lambda x: x[2]):
            line, column = builder.lexer.location(pos)
            self.errors.append({"category": category, "code": code, "line": line, "column": column, "message": message(code, name)})
        if options.strict and self.errors:
            e = self.errors[0]
            raise StrictModeError(f"{e['code']} at {e['line']}:{e['column']}")
        self.reports: list[dict] = []
        if options.compiled:
            told, emitted = apply_and_tell(self.root, options.compiled, source=builder.lexer.s)
            for text, n in told:
                line, column = self._where(n)
                self.reports.append({"message": text, "name": n.name if n is not None else None, "line": line, "column": column})
            for category, code, n, text in emitted:
                self._add(category, code, n, text or message(code, n.name if n is not None else None))
            self._sort()

    def clean(self, node: Node | None = None) -> Node:
        node = node or self.root
        if not self.options.safe:
            return node
        before = len(self.errors)
        out = sanitize(node, self.options.policy, source=self.lexer.s, report=self._unsafe)
        if len(self.errors) > before:
            self._sort()
        return out

    def _add(self, category: str, code: str, n: Node | None, text: str) -> None:
        line, column = self._where(n)
        error = {"category": category, "code": code, "line": line, "column": column, "message": text}
        if category != "security" or error not in self.errors:
            self.errors.append(error)

    def _sort(self) -> None:
        """By place; what has none comes last, in the order it was found."""
        self.errors.sort(key=lambda e: (e["line"] is None, e["line"] or 0, e["column"] or 0))

    def _where(self, n: Node | None) -> tuple[int | None, int | None]:
        return self.lexer.location(n.pos) if n is not None and n.pos is not None else (None, None)

    def _unsafe(self, text: str, n: Node) -> None:
        if self.options.policy is not None and self.options.policy.unsafe_handling == "collect":
            self._add("security", "unsafe-html", n, text)

    def html(self, node: Node | None = None) -> str:
        return _html.render(self.clean(node), self.options.pretty, self.options.indent_size)

    def text(self, node: Node | None = None) -> str:
        return _text.text_of(self.clean(node), self.options.separator, self.options.strip)

    def markdown(self, node: Node | None = None) -> str:
        return _text.markdown_of(self.clean(node), lambda n: _html.compact(sanitize(n)), lambda n: _text.text_of(sanitize(n), "", False))

    def dump(self) -> str:
        return dump(self.root)

    def nodes(self) -> dict[str, list]:
        """Columns of the nodes table, in document order."""
        return flatten(self.root, self.lexer if self.options.locations else None)


NODE_COLUMNS = (
    "node_id post parent_id depth tree_id content_of name name_lc namespace attrs data doctype elem_idx elem_cnt type_idx "
    "type_cnt prev_elem_id is_empty parent_name query_ord text_ord origin_pos origin_line origin_col start_tag_start "
    "start_tag_end end_tag_start end_tag_end end_tag_present self_closing"
).split()


def flatten(root: Node, lexer=None) -> dict[str, list]:
    """Rows in pre-order, where a template's content comes before its children: node_id is that order too."""
    out: dict[str, list] = {c: [] for c in NODE_COLUMNS}
    ids: dict[int, int] = {}
    add = [out[c].append for c in NODE_COLUMNS]
    order: list[Node] = []
    # (node, depth, parent id, tree id, content owner), or an id to close
    stack: list = [(root, 0, None, 0, None)]
    post = 0
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            out["post"][top] = post
            post += 1
            continue
        n, depth, parent, tree, owner = top
        me = len(order)
        ids[id(n)] = me
        order.append(n)
        tree = me if parent is None else tree
        line, column = lexer.location(n.pos) if lexer is not None and n.pos is not None else (None, None)
        a, b, c, d = (n.spans if lexer is not None else None) or (None, None, None, None)
        doctype = None
        if n.doctype:
            doctype = dict(zip(("name", "public_id", "system_id", "force_quirks"), n.doctype, strict=True))
        attrs = [{"name": k, "value": v} for k, v in (n.attrs or {}).items()]
        empty = not any(x.name[0] != "#" or (x.name == "#text" and (x.data or "").strip()) for x in n.children)
        values = (
            me, 0, parent, depth, tree, owner, n.name, n.name.lower(), n.ns, attrs, n.data, doctype, 0, 0, 0, 0, None, empty,
            n.parent.name if n.parent is not None else None, me, 0, n.pos if lexer is not None else None, line, column, a, b, c, d, n.end_tag, n.self_closing,
        )
        for f, v in zip(add, values, strict=True):
            f(v)
        stack.append(me)
        stack += [(x, depth + 1, me, tree, None) for x in reversed(n.children)]
        if n.content is not None:
            stack.append((n.content, depth + 1, None, me, me))
    index, count, by, of, prev = (out[c] for c in ("elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_id"))
    for n in order:
        kids = [c for c in n.children if c.name[0] != "#"]
        seen: dict[str, int] = {}
        before = None
        for i, c in enumerate(kids, 1):
            k, name = ids[id(c)], c.name.lower()
            seen[name] = seen.get(name, 0) + 1
            index[k], count[k], by[k], prev[k] = i, len(kids), seen[name], before
            before = k
        for c in kids:
            of[ids[id(c)]] = seen[c.name.lower()]
    rank, text_order = 0, out["text_ord"]
    walk = [root]
    while walk:
        n = walk.pop()
        text_order[ids[id(n)]] = rank
        rank += 1
        if n.content is not None:
            walk.append(n.content)
        walk += n.children[::-1]
    return out
