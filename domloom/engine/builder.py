"""Tree construction of the HTML standard: insertion modes over the tokens of one document or fragment."""

from __future__ import annotations

from .dom import Node
from .lexer import WS, Lexer, Token
from .names import (
    BLOCK_END,
    BLOCK_START,
    BREAKOUT,
    FOREIGN_ATTRS,
    FORMATTING,
    HEAD_TAGS,
    HEADINGS,
    HTML4,
    IMPLIED_END,
    LIMITED,
    MATH_ATTRS,
    QUIRKS_PUBLIC,
    QUIRKS_PUBLIC_EXACT,
    QUIRKS_SYSTEM,
    RCDATA,
    SCOPE,
    SCOPE_FOREIGN,
    SPECIAL,
    SPECIAL_MATH,
    SPECIAL_SVG,
    SVG_ATTRS,
    SVG_TAGS,
    TABLE_TAGS,
    THOROUGH_END,
)

TABLE_CONTEXT = frozenset("table tbody tfoot thead tr".split())
MARKER = None


def quirks_mode(doctype) -> str:
    name, public, system, forced = doctype
    p, s = (public or "").lower(), (system or "").lower()
    if forced or name != "html" or p in QUIRKS_PUBLIC_EXACT or p.startswith(QUIRKS_PUBLIC) or s == QUIRKS_SYSTEM or (system is None and p.startswith(HTML4)):
        return "quirks"
    if p.startswith(LIMITED) or (system is not None and p.startswith(HTML4)):
        return "limited-quirks"
    return "no-quirks"


def _lead(data: str) -> tuple[str, str]:
    rest = data.lstrip(WS)
    return data[: len(data) - len(rest)], rest


class OpenElements(list):
    """The stack of open elements, with the places of each HTML name and of the elements that end a scope, so that a scope test
    takes the same time at any depth. Changes below the top are rare; the places are then found anew."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.members: dict[int, int] = {}
        self.fresh = not len(self)

    def _note(self, i: int, n: Node) -> None:
        self.members[id(n)] = self.members.get(id(n), 0) + 1
        if n.ns == "html":
            self.places.setdefault(n.name, []).append(i)
        if n.name in SCOPE if n.ns == "html" else (n.ns, n.name) in SCOPE_FOREIGN:
            self.walls.append(i)

    def _look(self) -> None:
        if not self.fresh:
            self._forget()
            for i, n in enumerate(self):
                self._note(i, n)
            self.fresh = True

    def append(self, n: Node) -> None:
        super().append(n)
        if self.fresh:
            self._note(len(self) - 1, n)

    def pop(self) -> Node:
        n = super().pop()
        if self.fresh:
            i = len(self)
            left = self.members[id(n)] - 1
            if left:
                self.members[id(n)] = left
            else:
                del self.members[id(n)]
            if n.ns == "html":
                self.places[n.name].pop()
            if self.walls and self.walls[-1] == i:
                self.walls.pop()
        return n

    def insert(self, i: int, n: Node) -> None:
        self.fresh = False
        super().insert(i, n)

    def __setitem__(self, i, n) -> None:
        self.fresh = False
        super().__setitem__(i, n)

    def __delitem__(self, i) -> None:
        if isinstance(i, slice) and i.stop is None and i.step is None:
            for _ in range(len(self) - i.indices(len(self))[0]):
                self.pop()
            return
        self.fresh = self.fresh and i in (-1, len(self) - 1)
        if self.fresh:
            self.pop()
        else:
            super().__delitem__(i)

    def __contains__(self, n: object) -> bool:
        self._look()
        return id(n) in self.members

    def index(self, n: Node) -> int:
        """Where an element stands, looked for from the top."""
        for i in range(len(self) - 1, -1, -1):
            if self[i] is n:
                return i
        raise ValueError("not open")

    def reach(self, names: tuple[str, ...]) -> int:
        """The place of the topmost HTML element of one of the names; -1 if there is none."""
        self._look()
        best = -1
        for name in names:
            at = self.places.get(name)
            if at and at[-1] > best:
                best = at[-1]
        return best

    def wall(self) -> int:
        """The place of the topmost element that ends a scope; -1 if there is none."""
        self._look()
        return self.walls[-1] if self.walls else -1


class Builder:
    def __init__(self, html: str, *, fragment: tuple[str, str | None] | None = None, locations: bool = False, collect_errors: bool = False, iframe_srcdoc: bool = False, **options):
        self.lexer = Lexer(html, collect_errors=collect_errors, **options)
        self.collect, self.locations, self.srcdoc = collect_errors, locations or collect_errors, iframe_srcdoc
        self.errors: list[tuple[str, int, str | None]] = []
        self.fragment = fragment
        self.root = Node("#document-fragment" if fragment else "#document")
        self.open = OpenElements()
        self.active: list[Node | None] = []
        self.modes: list[str] = []
        self.mode, self.original = "initial", "in_body"
        self.head: Node | None = None
        self.form: Node | None = None
        self.quirks = "no-quirks"
        self.frameset_ok, self.foster, self.skip_lf = True, False, False
        self.pending: list[str] = []
        self.token: Token | None = None
        self.context: Node | None = None
        self.stopped = False
        if fragment:
            self._start_fragment(*fragment)

    # ---- driving

    def _start_fragment(self, name: str, ns: str | None) -> None:
        ns = ns or "html"
        self.context = Node(name, ns)
        html = self._make("html")
        self.root.append(html)
        self.open.append(html)
        if ns == "html":
            if name in RCDATA:
                self.lexer.state, self.lexer.raw_tag = "rcdata", name
            elif name in ("style", "xmp", "iframe", "noembed", "noframes"):
                self.lexer.state, self.lexer.raw_tag = "rawtext", name
            elif name == "script":
                self.lexer.state, self.lexer.raw_tag = "script", name
            elif name == "plaintext":
                self.lexer.state = "plaintext"
            if name == "template":
                self.modes.append("in_template")
        self._reset_mode()

    def parse(self) -> Node:
        lexer = self.lexer
        while True:
            top = self.open[-1] if self.open else None
            lexer.foreign = top is not None and top.ns != "html" and not (self.context is not None and len(self.open) == 1)
            t = lexer.next()
            if t is None:
                break
            self.token = t
            if self.stopped:
                continue
            self._dispatch(t)
        self.token = Token("eof", lexer.n, lexer.n)
        if self.pending:
            self._flush_table_text()
        while not self.stopped:
            self._dispatch(self.token)
        self._selected_content()
        if self.fragment:
            html = self.root.children[0]
            kids, html.children, self.root.children = html.children, [], []
            for k in kids:
                self.root.append(k)
        return self.root

    def error(self, code: str, name: str | None = None) -> None:
        if self.collect:
            self.errors.append((code, self.token.pos if self.token else 0, name))

    def _dispatch(self, t: Token) -> None:
        if t.kind == "text" and self.skip_lf:
            self.skip_lf = False
            if t.data.startswith("\n"):
                t.data = t.data[1:]
                if not t.data:
                    return
        elif t.kind != "eof":
            self.skip_lf = False
        if self._is_foreign(t):
            self._foreign(t)
        else:
            self._again(t)

    def _again(self, t: Token) -> None:
        """Run the current mode on a token."""
        if t.kind == "text" and self.mode not in _TEXT_MODES:
            return
        if self.pending and not (t.kind == "text" and self.mode == "in_table_text"):
            self._flush_table_text()
        getattr(self, "_m_" + self.mode)(t)

    def _switch(self, mode: str, t: Token) -> None:
        self.mode = mode
        self._redo(t)

    def _redo(self, t: Token) -> None:
        if self._is_foreign(t):
            self._foreign(t)
        else:
            self._again(t)

    # ---- nodes

    def _make(self, name: str, attrs: dict | None = None, ns: str = "html", token: Token | None = None) -> Node:
        n = Node(name, ns, dict(attrs) if attrs else {})
        if self.locations and token is not None and token.kind == "start":
            n.pos = token.pos
            n.spans = (token.pos, token.end, None, None)
            n.self_closing = token.self_closing
        if name == "template" and ns == "html":
            n.content = Node("#document-fragment")
        return n

    def _place(self, target: Node | None = None) -> tuple[Node, int | None]:
        """Where the next node goes: the parent, and the index of the child it goes before."""
        target = target or self.open[-1]
        if self.foster and target.name in TABLE_CONTEXT and target.ns == "html":
            template = table = None
            for i in range(len(self.open) - 1, -1, -1):
                n = self.open[i]
                if n.ns == "html" and n.name == "template" and template is None:
                    template = i
                if n.ns == "html" and n.name == "table" and table is None:
                    table = i
                if template is not None and table is not None:
                    break
            if template is not None and (table is None or template > table):
                return self.open[template].content, None
            if table is None:
                return self.open[0], None
            parent = self.open[table].parent
            if parent is not None:
                return parent, parent.index(self.open[table])
            target = self.open[table - 1]
        if target.content is not None:
            return target.content, None
        return target, None

    def _put(self, node: Node, place: tuple[Node, int | None]) -> None:
        parent, at = place
        parent.append(node) if at is None else parent.insert(at, node)

    def _insert(self, t: Token, ns: str = "html", push: bool = True) -> Node:
        n = self._make(t.name, t.attrs, ns, t)
        self._put(n, self._place())
        if push:
            self.open.append(n)
        return n

    def _insert_name(self, name: str) -> Node:
        n = self._make(name)
        self._put(n, self._place())
        self.open.append(n)
        return n

    def _text(self, data: str) -> None:
        if not data:
            return
        if "\f" in data:
            data = data.replace("\f", " ")
        parent, at = self._place()
        if parent.name == "#document":
            return
        before = parent.children[-1] if at is None and parent.children else parent.children[at - 1] if at else None
        if before is not None and before.name == "#text":
            before.data += data
            return
        self._put(Node("#text", data=data, pos=self.token.pos if self.locations else None), (parent, at))

    def _comment(self, t: Token, parent: Node | None = None) -> None:
        n = Node("#comment", data=t.data, pos=t.pos if self.locations else None)
        if parent is not None:
            parent.append(n)
        else:
            self._put(n, self._place())

    def _pop(self) -> Node:
        n = self.open.pop()
        return n

    def _close(self, n: Node, t: Token | None) -> None:
        if t is not None and t.kind == "end":
            n.end_tag = True
            if n.spans:
                n.spans = (*n.spans[:2], t.pos, t.end)

    def _pop_until(self, *names: str) -> None:
        t = self.token
        while self.open:
            n = self.open.pop()
            if n.name in names and n.ns == "html":
                if t is not None and t.kind == "end" and t.name == n.name:
                    self._close(n, t)
                return

    def _pop_to(self, names) -> None:
        while self.open and not (self.open[-1].ns == "html" and self.open[-1].name in names) and len(self.open) > 1:
            self.open.pop()

    def _remove_open(self, n: Node) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] is n:
                del self.open[i]
                return

    # ---- scopes

    def _in_scope(self, *names: str, extra: tuple[str, ...] = ()) -> bool:
        return self.open.reach(names) >= max(self.open.wall(), self.open.reach(extra), 0)

    def _in_button(self, name: str) -> bool:
        return self._in_scope(name, extra=("button",))

    def _in_table_scope(self, *names: str) -> bool:
        return self.open.reach(names) >= max(self.open.reach(("html", "table", "template")), 0)

    def _in_select_scope(self, name: str) -> bool:
        return self.open.reach((name,)) >= 0

    def _has_open(self, name: str) -> bool:
        return self.open.reach((name,)) >= 0

    def _imply(self, but: str | None = None, names=IMPLIED_END) -> None:
        while self.open and self.open[-1].ns == "html" and self.open[-1].name in names and self.open[-1].name != but:
            self.open.pop()

    def _close_p(self) -> None:
        if self._in_button("p"):
            self._imply("p")
            if self.open[-1].name != "p":
                self.error("unexpected-end-tag", "p")
            self._pop_until("p")

    # ---- formatting

    def _reconstruct(self) -> None:
        active = self.active
        if not active or active[-1] is MARKER or active[-1] in self.open:
            return
        i = len(active) - 1
        while i > 0 and active[i - 1] is not MARKER and active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(active)):
            old = active[k]
            n = self._make(old.name, old.attrs)
            self._put(n, self._place())
            self.open.append(n)
            active[k] = n

    def _push_formatting(self, n: Node) -> None:
        same = []
        for e in reversed(self.active):
            if e is MARKER:
                break
            if e.name == n.name and e.ns == n.ns and e.attrs == n.attrs:
                same.append(e)
        if len(same) >= 3:
            self._drop_active(same[-1])
        self.active.append(n)

    def _drop_active(self, n: Node) -> None:
        for i, e in enumerate(self.active):
            if e is n:
                del self.active[i]
                return

    def _clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not MARKER:
            pass

    def _active_named(self, name: str) -> Node | None:
        for e in reversed(self.active):
            if e is MARKER:
                return None
            if e.name == name:
                return e
        return None

    def _adoption(self, t: Token) -> None:
        name = t.name
        top = self.open[-1]
        if top.name == name and top.ns == "html" and top not in self.active:
            self._close(self._pop(), t)
            return
        for _ in range(8):
            fmt = self._active_named(name)
            if fmt is None:
                self._any_end(t)
                return
            if fmt not in self.open:
                self.error("adoption-agency-1.3", name)
                self._drop_active(fmt)
                return
            if not self._node_in_scope(fmt):
                self.error("adoption-agency-1.3", name)
                return
            if fmt is not self.open[-1]:
                self.error("adoption-agency-1.3", name)
            at = self.open.index(fmt)
            furthest = next((n for n in self.open[at + 1 :] if _special(n)), None)
            if furthest is None:
                del self.open[at:]
                self._drop_active(fmt)
                self._close(fmt, t)
                return
            common = self.open[at - 1]
            bookmark = self.active.index(fmt)
            node, last = furthest, furthest
            where = self.open.index(furthest)
            inner = 0
            while True:
                inner += 1
                where -= 1
                node = self.open[where]
                if node is fmt:
                    break
                listed = node in self.active
                if inner > 3 and listed:
                    k = self.active.index(node)
                    del self.active[k]
                    if k < bookmark:
                        bookmark -= 1
                    listed = False
                if not listed:
                    del self.open[where]
                    continue
                k = self.active.index(node)
                new = self._make(node.name, node.attrs)
                self.active[k] = self.open[where] = new
                node = new
                if last is furthest:
                    bookmark = k + 1
                last.detach()
                node.append(last)
                last = node
            last.detach()
            foster, self.foster = self.foster, True
            place = self._place(common)
            self.foster = foster
            self._put(last, place)
            new = self._make(fmt.name, fmt.attrs)
            kids, furthest.children = furthest.children, []
            for k in kids:
                new.append(k)
            furthest.append(new)
            k = self.active.index(fmt)
            del self.active[k]
            if k < bookmark:
                bookmark -= 1
            self.active.insert(bookmark, new)
            self._remove_open(fmt)
            self.open.insert(self.open.index(furthest) + 1, new)

    def _node_in_scope(self, target: Node) -> bool:
        return target in self.open and self.open.index(target) >= self.open.wall()

    def _any_end(self, t: Token) -> None:
        if not self._has_open(t.name):
            return self.error("unexpected-end-tag", t.name)
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if n.name == t.name and n.ns == "html":
                self._imply(t.name)
                if self.open[-1] is not n:
                    self.error("end-tag-too-early", t.name)
                self._close(n, t)
                del self.open[i:]
                return
            if _special(n):
                self.error("unexpected-end-tag", t.name)
                return

    # ---- foreign content

    def _is_foreign(self, t: Token) -> bool:
        if not self.open or t.kind == "eof":
            return False
        n = self.context if self.context is not None and len(self.open) == 1 else self.open[-1]
        if n.ns == "html":
            return False
        if _math_text(n) and (t.kind == "text" or (t.kind == "start" and t.name not in ("mglyph", "malignmark"))):
            return False
        if n.ns == "math" and n.name == "annotation-xml" and t.kind == "start" and t.name == "svg":
            return False
        return not (_html_point(n) and t.kind in ("start", "text"))

    def _foreign(self, t: Token) -> None:
        if t.kind == "text":
            for _ in range(t.data.count("\0")):
                self.error("invalid-codepoint-in-foreign-content")
            if t.data.strip(WS + "\0"):
                self.frameset_ok = False
            self._text(t.data.replace("\0", "�"))
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "doctype":
            self.error("unexpected-doctype")
        elif t.kind == "start":
            if t.name in BREAKOUT or (t.name == "font" and {"color", "face", "size"} & t.attrs.keys()):
                self.error("unexpected-html-element-in-foreign-content", t.name)
                while len(self.open) > 1 and not (self.open[-1].ns == "html" or _math_text(self.open[-1]) or _html_point(self.open[-1])):
                    self.open.pop()
                self._reprocess_html(t)
                return
            n = self.context if self.context is not None and len(self.open) == 1 else self.open[-1]
            self._insert_foreign(t, n.ns)
        else:
            if t.name in ("br", "p"):
                self.error("unexpected-html-element-in-foreign-content", t.name)
                while len(self.open) > 1 and not (self.open[-1].ns == "html" or _math_text(self.open[-1]) or _html_point(self.open[-1])):
                    self.open.pop()
                self._reprocess_html(t)
                return
            i = len(self.open) - 1
            if self.open[i].name.lower() != t.name:
                self.error("unexpected-end-tag", t.name)
            while i > 0:
                n = self.open[i]
                if n.name.lower() == t.name:
                    self._close(n, t)
                    del self.open[i:]
                    return
                i -= 1
                if self.open[i].ns == "html":
                    self._again(t)
                    return
            if self.context is not None:
                self.error("unexpected-end-tag-in-fragment-context", t.name)

    def _reprocess_html(self, t: Token) -> None:
        """The current mode's rules for a token that foreign content gave up."""
        if self.context is not None and len(self.open) == 1 and self.context.ns != "html":
            self._again(t)
        else:
            self._again(t) if self.open[-1].ns == "html" or not self._is_foreign(t) else self._foreign(t)

    def _insert_foreign(self, t: Token, ns: str) -> None:
        attrs = {}
        own = SVG_ATTRS if ns == "svg" else MATH_ATTRS
        for k, v in t.attrs.items():
            k = own.get(k, k)
            attrs.setdefault(FOREIGN_ATTRS.get(k, k).replace(" ", ":"), v)
        if ns == "svg":
            t.name = SVG_TAGS.get(t.name, t.name)
        n = self._make(t.name, attrs, ns, t)
        self._put(n, self._place())
        if not t.self_closing:
            self.open.append(n)

    # ---- modes

    def _reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            n, last = self.open[i], i == 0
            if last and self.context is not None:
                n = self.context
            if n.ns == "html":
                name = n.name
                if name == "select":
                    self.mode = "in_select"
                    return
                if name in ("td", "th") and not last:
                    self.mode = "in_cell"
                    return
                simple = {"tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "body": "in_body", "frameset": "in_frameset"}
                if name in simple:
                    self.mode = simple[name]
                    return
                if name == "template":
                    self.mode = self.modes[-1]
                    return
                if name == "head" and not last:
                    self.mode = "in_head"
                    return
                if name == "html":
                    self.mode = "before_head" if self.head is None else "after_head"
                    return
            if last:
                self.mode = "in_body"
                return

    def _m_initial(self, t: Token) -> None:
        if t.kind == "text":
            _, t.data = _lead(t.data)
            if not t.data:
                return
            self.error("expected-doctype-but-got-chars")
        elif t.kind == "comment":
            self._comment(t, self.root)
            return
        elif t.kind == "doctype":
            n = Node("!doctype", pos=t.pos if self.locations else None)
            n.doctype = t.doctype
            name, public, system, forced = t.doctype
            if name != "html" or forced or public is not None or system not in (None, "about:legacy-compat"):
                self.error("unknown-doctype")
            self.root.append(n)
            if not self.srcdoc:
                self.quirks = quirks_mode(t.doctype)
            self.mode = "before_html"
            return
        elif not self.srcdoc:
            kind = {"start": "expected-doctype-but-got-start-tag", "end": "expected-doctype-but-got-end-tag", "eof": "expected-doctype-but-got-eof"}[t.kind]
            self.error(kind, t.name or None)
        if not self.srcdoc:
            self.quirks = "quirks"
        self._switch("before_html", t)

    def _new_html(self, t: Token | None = None) -> None:
        n = self._make("html", t.attrs if t else None, token=t)
        self.root.append(n)
        self.open.append(n)

    def _m_before_html(self, t: Token) -> None:
        if t.kind == "doctype":
            self.error("unexpected-doctype")
        elif t.kind == "comment":
            self._comment(t, self.root)
        elif t.kind == "text":
            _, t.data = _lead(t.data)
            if t.data:
                self._new_html()
                self._switch("before_head", t)
        elif t.kind == "start" and t.name == "html":
            self._new_html(t)
            self.mode = "before_head"
        elif t.kind == "end" and t.name not in ("head", "body", "html", "br"):
            self.error("unexpected-end-tag-before-html", t.name)
        else:
            self._new_html()
            self._switch("before_head", t)

    def _m_before_head(self, t: Token) -> None:
        if t.kind == "text":
            if "\0" in t.data:
                self.error("invalid-codepoint-before-head")
                t.data = t.data.replace("\0", "")
            _, t.data = _lead(t.data)
            if not t.data:
                return
        elif t.kind == "comment":
            return self._comment(t)
        elif t.kind == "doctype":
            return self.error("unexpected-doctype")
        elif t.kind == "start" and t.name == "html":
            return self._m_in_body(t)
        elif t.kind == "start" and t.name == "head":
            self.head = self._insert(t)
            self.mode = "in_head"
            return None
        elif t.kind == "end" and t.name not in ("head", "body", "html", "br"):
            return self.error("unexpected-end-tag-before-head", t.name)
        self.head = self._insert_name("head")
        return self._switch("in_head", t)

    def _raw(self, t: Token, state: str) -> None:
        self._insert(t)
        self.lexer.state, self.lexer.raw_tag = state, t.name
        self.original, self.mode = self.mode, "text"

    def _m_in_head(self, t: Token) -> None:
        if t.kind == "text":
            space, rest = _lead(t.data)
            self._text(space)
            if not rest:
                return None
            t.data = rest
        elif t.kind == "comment":
            return self._comment(t)
        elif t.kind == "doctype":
            return self.error("unexpected-doctype")
        elif t.kind == "start":
            name = t.name
            if name == "html":
                return self._m_in_body(t)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self._insert(t, push=False)
                return None
            if name == "title":
                return self._raw(t, "rcdata")
            if name in ("noframes", "style"):
                return self._raw(t, "rawtext")
            if name == "noscript":
                self._insert(t)
                self.mode = "in_head_noscript"
                return None
            if name == "script":
                return self._raw(t, "script")
            if name == "template":
                self._insert(t)
                self.active.append(MARKER)
                self.frameset_ok = False
                self.mode = "in_template"
                self.modes.append("in_template")
                return None
            if name == "head":
                return self.error("unexpected-start-tag", name)
        elif t.kind == "end":
            if t.name == "head":
                self._close(self._pop(), t)
                self.mode = "after_head"
                return None
            if t.name == "template":
                return self._end_template(t)
            if t.name not in ("body", "html", "br"):
                return self.error("unexpected-end-tag", t.name)
        self._pop()
        return self._switch("after_head", t)

    def _end_template(self, t: Token) -> None:
        if not self._has_open("template"):
            self.error("unexpected-end-tag", t.name)
            return
        self._imply(names=THOROUGH_END)
        if self.open[-1].name != "template":
            self.error("unexpected-end-tag", t.name)
        self._pop_until("template")
        self._clear_to_marker()
        self.modes.pop()
        self._reset_mode()

    def _m_in_head_noscript(self, t: Token) -> None:
        if t.kind == "doctype":
            return self.error("unexpected-doctype")
        if t.kind == "comment":
            return self._m_in_head(t)
        if t.kind == "text":
            space, rest = _lead(t.data)
            self._text(space)
            if not rest:
                return None
            t.data = rest
            self.error("unexpected-start-tag", "text")
        elif t.kind == "start":
            if t.name == "html":
                return self._m_in_body(t)
            if t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                return self._m_in_head(t)
            self.error("unexpected-start-tag", t.name)
            if t.name in ("head", "noscript"):
                return None
        elif t.kind == "end":
            if t.name == "noscript":
                self._close(self._pop(), t)
                self.mode = "in_head"
                return None
            self.error("unexpected-end-tag", t.name)
            if t.name != "br":
                return None
        else:
            self.error("expected-closing-tag-but-got-eof", "noscript")
        self._pop()
        return self._switch("in_head", t)

    def _m_after_head(self, t: Token) -> None:
        if t.kind == "text":
            space, rest = _lead(t.data)
            self._text(space)
            if not rest:
                return None
            t.data = rest
        elif t.kind == "comment":
            return self._comment(t)
        elif t.kind == "doctype":
            return self.error("unexpected-doctype")
        elif t.kind == "start":
            name = t.name
            if name == "html":
                return self._m_in_body(t)
            if name == "body":
                self._insert(t)
                self.frameset_ok = False
                self.mode = "in_body"
                return None
            if name == "frameset":
                self._insert(t)
                self.mode = "in_frameset"
                return None
            if name == "input" and t.attrs.get("type", "").lower() == "hidden":
                return self.error("unexpected-hidden-input-after-head")
            if name in HEAD_TAGS:
                self.error("unexpected-start-tag", name)
                self.open.append(self.head)
                self._m_in_head(t)
                self._remove_open(self.head)
                return None
            if name == "head":
                return self.error("unexpected-start-tag", name)
        elif t.kind == "end":
            if t.name == "template":
                return self._m_in_head(t)
            if t.name not in ("body", "html", "br"):
                return self.error("unexpected-end-tag-after-head", t.name)
        self._insert_name("body")
        return self._switch("in_body", t)

    def _m_text(self, t: Token) -> None:
        if t.kind == "text":
            self._text(t.data)
        elif t.kind == "eof":
            self.error("expected-named-closing-tag-but-got-eof", self.open[-1].name)
            self._pop()
            self._switch(self.original, t)
        else:
            self._close(self._pop(), t)
            self.mode = self.original

    def _body_text(self, t: Token) -> None:
        data = t.data
        if "\0" in data:
            self.error("invalid-codepoint")
            data = data.replace("\0", "")
            if not data:
                return
        self._reconstruct()
        self._text(data)
        if self.frameset_ok and data.strip(WS):
            self.frameset_ok = False

    def _m_in_body(self, t: Token) -> None:
        kind = t.kind
        if kind == "text":
            self._body_text(t)
        elif kind == "start":
            self._body_start(t)
        elif kind == "end":
            self._body_end(t)
        elif kind == "comment":
            self._comment(t)
        elif kind == "doctype":
            self.error("unexpected-doctype")
        elif self.modes:
            self._m_in_template(t)
        else:
            for n in self.open:
                if n.name not in ("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"):
                    self.error("expected-closing-tag-but-got-eof", n.name)
                    break
            self.stopped = True

    def _body_start(self, t: Token) -> None:
        name = t.name
        handler = _BODY_START.get(name)
        if handler is not None:
            handler(self, t)
            return
        self._reconstruct()
        self._insert(t)
        if t.self_closing:
            self.error("non-void-html-element-start-tag-with-trailing-solidus", name)

    def _b_html(self, t: Token) -> None:
        self.error("unexpected-start-tag", t.name)
        if not self._has_open("template") and self.open:
            for k, v in t.attrs.items():
                self.open[0].attrs.setdefault(k, v)

    def _b_head_tag(self, t: Token) -> None:
        self._m_in_head(t)

    def _b_body(self, t: Token) -> None:
        self.error("unexpected-start-tag", t.name)
        if len(self.open) < 2 or self.open[1].name != "body" or self._has_open("template"):
            return
        self.frameset_ok = False
        for k, v in t.attrs.items():
            self.open[1].attrs.setdefault(k, v)

    def _b_frameset(self, t: Token) -> None:
        self.error("unexpected-start-tag-ignored", t.name)
        if len(self.open) < 2 or self.open[1].name != "body" or not self.frameset_ok:
            return
        self.open[1].detach()
        del self.open[1:]
        self._insert(t)
        self.mode = "in_frameset"

    def _b_block(self, t: Token) -> None:
        self._close_p()
        self._insert(t)

    def _b_heading(self, t: Token) -> None:
        self._close_p()
        if self.open[-1].name in HEADINGS and self.open[-1].ns == "html":
            self.error("unexpected-start-tag", t.name)
            self._pop()
        self._insert(t)

    def _b_pre(self, t: Token) -> None:
        self._close_p()
        self._insert(t)
        self.skip_lf, self.frameset_ok = True, False

    def _b_form(self, t: Token) -> None:
        template = self._has_open("template")
        if self.form is not None and not template:
            self.error("unexpected-start-tag", t.name)
            return
        self._close_p()
        n = self._insert(t)
        if not template:
            self.form = n

    def _b_li(self, t: Token) -> None:
        self.frameset_ok = False
        names = ("li",) if t.name == "li" else ("dd", "dt")
        for n in reversed(self.open) if self.open.reach(names) >= 0 else ():
            if n.name in names and n.ns == "html":
                self._imply(n.name)
                if self.open[-1].name != n.name:
                    self.error("unexpected-end-tag", n.name)
                self._pop_until(n.name)
                break
            if _special(n) and n.name not in ("address", "div", "p"):
                break
        self._close_p()
        self._insert(t)

    def _b_plaintext(self, t: Token) -> None:
        self._close_p()
        self._insert(t)
        self.lexer.state = "plaintext"

    def _b_button(self, t: Token) -> None:
        if self._in_scope("button"):
            self.error("unexpected-start-tag-implies-end-tag", t.name)
            self._imply()
            self._pop_until("button")
        self._reconstruct()
        self._insert(t)
        self.frameset_ok = False

    def _b_a(self, t: Token) -> None:
        old = self._active_named("a")
        if old is not None:
            self.error("unexpected-start-tag-implies-end-tag", t.name)
            self._adoption(Token("end", t.pos, t.end, "a"))
            self._drop_active(old)
            self._remove_open(old)
        self._b_format(t)

    def _b_format(self, t: Token) -> None:
        self._reconstruct()
        if t.name == "nobr" and self._in_scope("nobr"):
            self.error("unexpected-start-tag-implies-end-tag", t.name)
            self._adoption(Token("end", t.pos, t.end, "nobr"))
            self._reconstruct()
        self._push_formatting(self._insert(t))

    def _b_applet(self, t: Token) -> None:
        self._reconstruct()
        self._insert(t)
        self.active.append(MARKER)
        self.frameset_ok = False

    def _b_table(self, t: Token) -> None:
        if self.quirks != "quirks":
            self._close_p()
        self._insert(t)
        self.frameset_ok = False
        self.mode = "in_table"

    def _b_void(self, t: Token) -> None:
        self._reconstruct()
        self._insert(t, push=False)
        self.frameset_ok = False

    def _b_input(self, t: Token) -> None:
        self._reconstruct()
        self._insert(t, push=False)
        if t.attrs.get("type", "").lower() != "hidden":
            self.frameset_ok = False

    def _b_simple_void(self, t: Token) -> None:
        self._insert(t, push=False)

    def _b_hr(self, t: Token) -> None:
        self._close_p()
        self._insert(t, push=False)
        self.frameset_ok = False

    def _b_image(self, t: Token) -> None:
        self.error("image-start-tag", t.name)
        t.name = "img"
        self._b_void(t)

    def _b_textarea(self, t: Token) -> None:
        self.frameset_ok = False
        self._raw(t, "rcdata")
        self.skip_lf = True

    def _b_xmp(self, t: Token) -> None:
        self._close_p()
        self._reconstruct()
        self.frameset_ok = False
        self._raw(t, "rawtext")

    def _b_iframe(self, t: Token) -> None:
        self.frameset_ok = False
        self._raw(t, "rawtext")

    def _b_noembed(self, t: Token) -> None:
        self._raw(t, "rawtext")

    def _b_select(self, t: Token) -> None:
        self._reconstruct()
        self._insert(t)
        self.frameset_ok = False
        self.mode = "in_select"

    def _b_option(self, t: Token) -> None:
        if self.open[-1].name == "option":
            self._pop()
        self._reconstruct()
        self._insert(t)

    def _b_rb(self, t: Token) -> None:
        if self._in_scope("ruby"):
            self._imply("rtc" if t.name in ("rp", "rt") else None)
        self._insert(t)

    def _b_math(self, t: Token) -> None:
        self._reconstruct()
        self._insert_foreign(t, t.name)

    def _b_ignored(self, t: Token) -> None:
        self.error("unexpected-start-tag-ignored", t.name)

    def _body_end(self, t: Token) -> None:
        name = t.name
        if name in FORMATTING:
            self._adoption(t)
        elif name == "template":
            self._end_template(t)
        elif name in ("body", "html"):
            if not self._in_scope("body"):
                self.error("unexpected-end-tag", name)
                return
            body = next((n for n in self.open if n.name == "body"), None)
            if body is not None and name == "body":
                self._close(body, t)
            self.mode = "after_body"
            if name == "html":
                self._redo(t)
        elif name in BLOCK_END:
            if not self._in_scope(name):
                self.error("unexpected-end-tag", name)
                return
            self._imply()
            if self.open[-1].name != name:
                self.error("end-tag-too-early", name)
            self._pop_until(name)
        elif name == "form":
            if self._has_open("template"):
                if not self._in_scope("form"):
                    self.error("unexpected-end-tag", name)
                    return
                self._imply()
                self._pop_until("form")
                return
            n, self.form = self.form, None
            if n is None or not self._node_in_scope(n):
                self.error("unexpected-end-tag", name)
                return
            self._imply()
            if self.open[-1] is not n:
                self.error("unexpected-end-tag", name)
            self._close(n, t)
            self._remove_open(n)
        elif name == "p":
            if not self._in_button("p"):
                self.error("unexpected-end-tag", name)
                self._insert_name("p")
            self._close_p()
        elif name in ("li", "dd", "dt"):
            if not self._in_scope(name, extra=("ol", "ul") if name == "li" else ()):
                self.error("unexpected-end-tag", name)
                return
            self._imply(name)
            if self.open[-1].name != name:
                self.error("unexpected-end-tag", name)
            self._pop_until(name)
        elif name in HEADINGS:
            if not self._in_scope(*HEADINGS):
                self.error("unexpected-end-tag", name)
                return
            self._imply()
            if self.open[-1].name != name:
                self.error("end-tag-too-early", name)
            self._pop_until(*HEADINGS)
        elif name in ("applet", "marquee", "object"):
            if not self._in_scope(name):
                self.error("unexpected-end-tag", name)
                return
            self._imply()
            if self.open[-1].name != name:
                self.error("end-tag-too-early", name)
            self._pop_until(name)
            self._clear_to_marker()
        elif name == "br":
            self.error("unexpected-end-tag", name)
            self._b_void(Token("start", t.pos, t.end, "br"))
        else:
            self._any_end(t)

    # ---- tables

    def _m_in_table(self, t: Token) -> None:
        if t.kind == "text" and self.open[-1].name in (*TABLE_CONTEXT, "template"):
            self.original, self.mode = self.mode, "in_table_text"
            self._m_in_table_text(t)
            return
        if t.kind == "comment":
            return self._comment(t)
        if t.kind == "doctype":
            return self.error("unexpected-doctype")
        if t.kind == "start":
            name = t.name
            if name == "caption":
                self._pop_to(("table", "template", "html"))
                self.active.append(MARKER)
                self._insert(t)
                self.mode = "in_caption"
                return None
            if name == "colgroup":
                self._pop_to(("table", "template", "html"))
                self._insert(t)
                self.mode = "in_column_group"
                return None
            if name == "col":
                self._pop_to(("table", "template", "html"))
                self._insert_name("colgroup")
                return self._switch("in_column_group", t)
            if name in ("tbody", "tfoot", "thead"):
                self._pop_to(("table", "template", "html"))
                self._insert(t)
                self.mode = "in_table_body"
                return None
            if name in ("td", "th", "tr"):
                self._pop_to(("table", "template", "html"))
                self._insert_name("tbody")
                return self._switch("in_table_body", t)
            if name == "table":
                self.error("unexpected-start-tag-implies-end-tag", name)
                if self._in_table_scope("table"):
                    self._pop_until("table")
                    self._reset_mode()
                    self._redo(t)
                return None
            if name in ("style", "script", "template"):
                return self._m_in_head(t)
            if name == "input" and t.attrs.get("type", "").lower() == "hidden":
                self.error("unexpected-hidden-input-in-table")
                self._insert(t, push=False)
                return None
            if name == "form":
                self.error("unexpected-form-in-table")
                if self.form is None and not self._has_open("template"):
                    self.form = self._insert(t, push=False)
                return None
            self.error("foster-parenting-start-tag", name)
        elif t.kind == "end":
            if t.name == "table":
                if not self._in_table_scope("table"):
                    return self.error("unexpected-end-tag", t.name)
                self._pop_until("table")
                self._reset_mode()
                return None
            if t.name in ("body", "html", *TABLE_TAGS):
                return self.error("unexpected-end-tag", t.name)
            if t.name == "template":
                return self._m_in_head(t)
            self.error("unexpected-end-tag-implies-table-voodoo", t.name)
        elif t.kind == "eof":
            if self.open[-1].name == "table":
                self.error("eof-in-table")
            return self._m_in_body(t)
        self._fostered(t)
        return None

    def _fostered(self, t: Token) -> None:
        self.foster = True
        try:
            self._m_in_body(t)
        finally:
            self.foster = False

    def _m_in_table_text(self, t: Token) -> None:
        if t.kind == "text":
            data = t.data.replace("\0", "")
            if data:
                self.pending.append(data)
            elif not self.pending:
                self.mode = self.original
            return
        self._flush_table_text()
        self._redo(t)

    def _flush_table_text(self) -> None:
        data, self.pending = "".join(self.pending), []
        if self.mode == "in_table_text":
            self.mode = self.original
        if not data.strip(WS):
            self._text(data)
            return
        self.error("foster-parenting-character")
        self.foster = True
        self._reconstruct()
        self._text(data)
        self.frameset_ok = False
        self.foster = False

    def _m_in_caption(self, t: Token) -> None:
        if (t.kind == "end" and t.name == "caption") or (t.kind == "start" and (t.name in TABLE_TAGS or t.name == "table")) or (t.kind == "end" and t.name == "table"):
            if not self._in_table_scope("caption"):
                self.error("unexpected-end-tag", t.name)
                return
            self._imply()
            if self.open[-1].name != "caption":
                self.error("unexpected-end-tag", "caption")
            self._pop_until("caption")
            self._clear_to_marker()
            self.mode = "in_table"
            if t.name != "caption" or t.kind == "start":
                if t.kind == "start":
                    self.error("unexpected-start-tag-implies-end-tag", t.name)
                self._redo(t)
        elif t.kind == "end" and t.name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error("unexpected-end-tag", t.name)
        else:
            self._m_in_body(t)

    def _m_in_column_group(self, t: Token) -> None:
        if t.kind == "text":
            space, rest = _lead(t.data)
            self._text(space)
            if not rest:
                return None
            self.error("unexpected-characters-in-template-column-group" if self.open[-1].name == "template" else "unexpected-characters-in-column-group")
            t.data = rest
        elif t.kind == "comment":
            return self._comment(t)
        elif t.kind == "doctype":
            return self.error("unexpected-doctype")
        elif t.kind == "start":
            if t.name == "html":
                return self._m_in_body(t)
            if t.name == "col":
                self._insert(t, push=False)
                return None
            if t.name == "template":
                return self._m_in_head(t)
        elif t.kind == "end":
            if t.name == "colgroup":
                if self.open[-1].name != "colgroup":
                    return self.error("unexpected-end-tag", t.name)
                self._close(self._pop(), t)
                self.mode = "in_table"
                return None
            if t.name == "col":
                return self.error("unexpected-end-tag", t.name)
            if t.name == "template":
                return self._m_in_head(t)
        else:
            return self._m_in_body(t)
        if self.open[-1].name != "colgroup":
            if t.kind == "start":
                self.error("unexpected-start-tag-in-template-column-group" if self.modes else "unexpected-start-tag-in-column-group", t.name)
            return None
        self._pop()
        return self._switch("in_table", t)

    def _m_in_table_body(self, t: Token) -> None:
        sections = ("tbody", "tfoot", "thead")
        if t.kind == "start":
            if t.name == "tr":
                self._pop_to((*sections, "template", "html"))
                self._insert(t)
                self.mode = "in_row"
                return
            if t.name in ("td", "th"):
                self.error("unexpected-cell-in-table-body")
                self._pop_to((*sections, "template", "html"))
                self._insert_name("tr")
                self._switch("in_row", t)
                return
        if t.kind == "end" and t.name in sections:
            if not self._in_table_scope(t.name):
                self.error("unexpected-end-tag", t.name)
                return
            self._pop_to((*sections, "template", "html"))
            self._close(self._pop(), t)
            self.mode = "in_table"
            return
        if (t.kind == "start" and t.name in ("caption", "col", "colgroup", *sections)) or (t.kind == "end" and t.name == "table"):
            if not self._in_table_scope(*sections):
                self.error("unexpected-start-tag-in-template-table-context" if self.modes else "unexpected-end-tag", t.name)
                return
            self._pop_to((*sections, "template", "html"))
            self._pop()
            self._switch("in_table", t)
            return
        if t.kind == "end" and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self.error("unexpected-end-tag", t.name)
            return
        self._m_in_table(t)

    def _m_in_row(self, t: Token) -> None:
        if t.kind == "start" and t.name in ("td", "th"):
            self._pop_to(("tr", "template", "html"))
            self._insert(t)
            self.mode = "in_cell"
            self.active.append(MARKER)
            return
        ends = t.kind == "end" and t.name in ("tr", "table", "tbody", "tfoot", "thead")
        if ends or (t.kind == "start" and t.name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")):
            if not self._in_table_scope("tr"):
                self.error("unexpected-end-tag", t.name)
                return
            if t.kind == "end" and t.name in ("tbody", "tfoot", "thead") and not self._in_table_scope(t.name):
                self.error("unexpected-end-tag", t.name)
                return
            self._pop_to(("tr", "template", "html"))
            row = self._pop()
            self.mode = "in_table_body"
            if t.kind == "end" and t.name == "tr":
                self._close(row, t)
            else:
                self._redo(t)
            return
        if t.kind == "end" and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self.error("unexpected-end-tag", t.name)
            return
        self._m_in_table(t)

    def _m_in_cell(self, t: Token) -> None:
        if t.kind == "end" and t.name in ("td", "th"):
            if not self._in_table_scope(t.name):
                self.error("unexpected-end-tag", t.name)
                return
            self._imply()
            if self.open[-1].name != t.name:
                self.error("unexpected-end-tag", t.name)
            self._pop_until(t.name)
            self._clear_to_marker()
            self.mode = "in_row"
        elif t.kind == "start" and t.name in TABLE_TAGS:
            if not self._in_table_scope("td", "th"):
                self.error("unexpected-start-tag-in-cell-fragment", t.name)
                return
            self._close_cell()
            self._redo(t)
        elif t.kind == "end" and t.name in ("body", "caption", "col", "colgroup", "html"):
            self.error("unexpected-end-tag", t.name)
        elif t.kind == "end" and t.name in TABLE_CONTEXT:
            if not self._in_table_scope(t.name):
                self.error("unexpected-end-tag", t.name)
                return
            self._close_cell()
            self._redo(t)
        else:
            self._m_in_body(t)

    def _close_cell(self) -> None:
        self._imply()
        if self.open[-1].name not in ("td", "th"):
            self.error("unexpected-implied-end-tag-in-table-view")
        self._pop_until("td", "th")
        self._clear_to_marker()
        self.mode = "in_row"

    # ---- select

    def _m_in_select(self, t: Token) -> None:
        top = self.open[-1].name
        if t.kind == "text":
            data = t.data.replace("\0", "")
            if data:
                self._reconstruct()
                self._text(data)
            return
        if t.kind == "comment":
            return self._comment(t)
        if t.kind == "doctype":
            return self.error("unexpected-doctype")
        if t.kind == "eof":
            return self._m_in_body(t)
        name = t.name
        if t.kind == "start":
            if name == "html":
                return self._m_in_body(t)
            if name in ("option", "optgroup", "hr"):
                if name == "hr":
                    self.error("unexpected-start-tag-in-select", name)
                if self.open[-1].name == "option":
                    self._pop()
                if name != "option" and self.open[-1].name == "optgroup":
                    self._pop()
                self._reconstruct()
                self._insert(t, push=name != "hr")
            elif name in ("select", "input", "textarea", "table", *TABLE_TAGS):
                self.error("unexpected-select-in-select" if name == "select" else "unexpected-start-tag-in-select", name)
                if not self._in_select_scope("select"):
                    return None
                self._pop_until("select")
                self._reset_mode()
                if name != "select":
                    self._redo(t)
            elif name in ("script", "template"):
                self._m_in_head(t)
            elif name in ("svg", "math"):
                self._reconstruct()
                self._insert_foreign(t, name)
            elif name in FORMATTING:
                self._reconstruct()
                self._push_formatting(self._insert(t))
            elif name in ("br", "img", "keygen"):
                self.error("unexpected-start-tag-in-select", name)
                self._reconstruct()
                self._insert(t, push=False)
            elif name in ("p", "div", "span", "button", "datalist", "selectedcontent", "menuitem", "plaintext"):
                self.error("unexpected-start-tag-in-select", name)
                self._reconstruct()
                self._insert(t, push=not (t.self_closing and name not in ("menuitem", "plaintext")))
                if name == "plaintext":
                    self.lexer.state = "plaintext"
            else:
                self.error("unexpected-start-tag-in-select", name)
            return None
        if name == "optgroup":
            if top == "option" and len(self.open) > 1 and self.open[-2].name == "optgroup":
                self._pop()
            if self.open[-1].name == "optgroup":
                self._close(self._pop(), t)
            else:
                if top == "option":
                    self._pop()
                self.error("unexpected-end-tag-in-select", name)
        elif name == "option":
            if top == "option":
                self._close(self._pop(), t)
            else:
                self.error("unexpected-end-tag-in-select", name)
        elif name == "select":
            if not self._in_select_scope("select"):
                return self.error("unexpected-end-tag", name)
            self._pop_until("select")
            self._reset_mode()
        elif name == "template":
            self._m_in_head(t)
        elif name in FORMATTING:
            fmt = self._active_named(name)
            at = max((i for i, n in enumerate(self.open) if n.name == "select"), default=-1)
            if fmt is None or (fmt in self.open and self.open.index(fmt) < at):
                return self.error("unexpected-end-tag-in-select", name)
            self._adoption(t)
        elif name in ("p", "div", "span", "button", "datalist", "selectedcontent"):
            self.error("unexpected-end-tag-in-select", name)
            select = next((i for i, n in enumerate(self.open) if n.name == "select"), None)
            target = max((i for i, n in enumerate(self.open) if n.name == name), default=None)
            if target is not None and (select is None or target > select):
                self._close(self.open[target], t)
                del self.open[target:]
        elif name == "table" or name in TABLE_TAGS:
            self.error("unexpected-end-tag-in-select", name)
            if self.context is None or self._in_table_scope(name):
                self._pop_until("select")
                self._reset_mode()
                self._redo(t)
        else:
            self.error("unexpected-end-tag", name)
        return None

    # ---- the rest

    def _m_in_template(self, t: Token) -> None:
        if t.kind in ("text", "comment", "doctype"):
            return self._m_in_body(t)
        if t.kind == "start":
            if t.name in HEAD_TAGS:
                return self._m_in_head(t)
            mode = "in_body"
            for names, m in ((("caption", "colgroup", "tbody", "tfoot", "thead"), "in_table"), (("col",), "in_column_group"), (("tr",), "in_table_body"), (("td", "th"), "in_row")):
                if t.name in names:
                    mode = m
            self.modes[-1] = mode
            return self._switch(mode, t)
        if t.kind == "end":
            if t.name == "template":
                return self._m_in_head(t)
            return self.error("unexpected-end-tag", t.name)
        if not self._has_open("template"):
            self.stopped = True
            return None
        self.error("expected-closing-tag-but-got-eof", "template")
        self._pop_until("template")
        self._clear_to_marker()
        self.modes.pop()
        self._reset_mode()
        return self._redo(t)

    def _m_after_body(self, t: Token) -> None:
        if t.kind == "text":
            if t.data.strip(WS):
                self.error("unexpected-char-after-body")
                return self._switch("in_body", t)
            return self._m_in_body(t)
        if t.kind == "comment":
            return self._comment(t, self.open[0])
        if t.kind == "doctype":
            return self.error("unexpected-doctype")
        if t.kind == "start" and t.name == "html":
            return self._m_in_body(t)
        if t.kind == "end" and t.name == "html":
            if self.context is None:
                self._close(self.open[0], t)
                self.mode = "after_after_body"
            return None
        if t.kind == "eof":
            self.stopped = True
            return None
        self.error("unexpected-token-after-body", t.name)
        return self._switch("in_body", t)

    def _m_after_after_body(self, t: Token) -> None:
        if t.kind == "comment":
            return self._comment(t, self.root)
        if t.kind == "doctype" or (t.kind == "text" and not t.data.strip(WS)) or (t.kind == "start" and t.name == "html"):
            return self._m_in_body(t)
        if t.kind == "eof":
            self.stopped = True
            return None
        self.error("unexpected-token-after-body", t.name)
        return self._switch("in_body", t)

    def _spaces(self, t: Token, code: str) -> None:
        kept = "".join(c for c in t.data if c in WS)
        if len(kept) < len(t.data):
            self.error(code)
        self._text(kept)

    def _m_in_frameset(self, t: Token) -> None:
        if t.kind == "text":
            self._spaces(t, "unexpected-token-in-frameset")
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "html":
            self._m_in_body(t)
        elif t.kind == "start" and t.name == "frameset":
            self._insert(t)
        elif t.kind == "start" and t.name == "frame":
            self._insert(t, push=False)
        elif t.kind == "start" and t.name == "noframes":
            self._m_in_head(t)
        elif t.kind == "end" and t.name == "frameset":
            if len(self.open) <= 1:
                return self.error("unexpected-end-tag", t.name)
            self._close(self._pop(), t)
            if self.context is None and self.open[-1].name != "frameset":
                self.mode = "after_frameset"
        elif t.kind == "eof":
            if len(self.open) > 1:
                self.error("expected-closing-tag-but-got-eof", self.open[-1].name)
            self.stopped = True
        else:
            self.error("unexpected-token-in-frameset")
        return None

    def _m_after_frameset(self, t: Token) -> None:
        if t.kind == "text":
            self._spaces(t, "unexpected-token-after-frameset")
        elif t.kind == "comment":
            self._comment(t)
        elif t.kind == "start" and t.name == "html":
            self._m_in_body(t)
        elif t.kind == "start" and t.name == "noframes":
            self._m_in_head(t)
        elif t.kind == "end" and t.name == "html":
            self.mode = "after_after_frameset"
        elif t.kind == "eof":
            self.stopped = True
        else:
            self.error("unexpected-token-after-frameset")

    def _m_after_after_frameset(self, t: Token) -> None:
        if t.kind == "comment":
            self._comment(t, self.root)
        elif t.kind == "text":
            self._spaces(t, "unexpected-token-after-after-frameset")
        elif t.kind == "start" and t.name == "html":
            self._m_in_body(t)
        elif t.kind == "start" and t.name == "noframes":
            self._m_in_head(t)
        elif t.kind == "eof":
            self.stopped = True
        else:
            self.error("unexpected-token-after-after-frameset")

    def _selected_content(self) -> None:
        """A selectedcontent element of a select mirrors its selected, or else first, option."""
        for select in [n for n in self.root.walk() if n.name == "select"]:
            target = select.find("selectedcontent")
            if target is None:
                continue
            options = [n for n in select.walk() if n.name == "option"]
            chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
            if chosen is not None:
                for c in chosen.children:
                    target.append(c.clone(deep=True))


def _special(n: Node) -> bool:
    return n.name in SPECIAL if n.ns == "html" else n.name in (SPECIAL_MATH if n.ns == "math" else SPECIAL_SVG)


def _math_text(n: Node) -> bool:
    return n.ns == "math" and n.name in ("mi", "mo", "mn", "ms", "mtext")


def _html_point(n: Node) -> bool:
    if n.ns == "svg":
        return n.name in SPECIAL_SVG
    return n.ns == "math" and n.name == "annotation-xml" and (n.attrs.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")


_TEXT_MODES = frozenset(m[3:] for m in dir(Builder) if m.startswith("_m_"))
_BODY_START = {
    **dict.fromkeys(BLOCK_START, Builder._b_block),
    **dict.fromkeys(HEAD_TAGS, Builder._b_head_tag),
    **dict.fromkeys(HEADINGS, Builder._b_heading),
    **dict.fromkeys(FORMATTING, Builder._b_format),
    **dict.fromkeys(("pre", "listing"), Builder._b_pre),
    **dict.fromkeys(("li", "dd", "dt"), Builder._b_li),
    **dict.fromkeys(("applet", "marquee", "object"), Builder._b_applet),
    **dict.fromkeys(("area", "br", "embed", "img", "keygen", "wbr"), Builder._b_void),
    **dict.fromkeys(("param", "source", "track"), Builder._b_simple_void),
    **dict.fromkeys(("optgroup", "option"), Builder._b_option),
    **dict.fromkeys(("rb", "rtc", "rp", "rt"), Builder._b_rb),
    **dict.fromkeys(("math", "svg"), Builder._b_math),
    **dict.fromkeys((*TABLE_TAGS, "frame", "head"), Builder._b_ignored),
    "a": Builder._b_a, "body": Builder._b_body, "button": Builder._b_button, "form": Builder._b_form, "frameset": Builder._b_frameset,
    "hr": Builder._b_hr, "html": Builder._b_html, "iframe": Builder._b_iframe, "image": Builder._b_image, "input": Builder._b_input,
    "noembed": Builder._b_noembed, "plaintext": Builder._b_plaintext, "select": Builder._b_select, "table": Builder._b_table,
    "textarea": Builder._b_textarea, "xmp": Builder._b_xmp,
}
