"""The mutable tree of one document."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """An element, or a leaf whose name starts with '#' or '!'. attrs is an ordered map; values may be None."""

    __slots__ = ("attrs", "children", "content", "data", "doctype", "end_tag", "name", "ns", "parent", "pos", "self_closing", "spans")

    def __init__(self, name: str, ns: str | None = None, attrs: dict[str, str | None] | None = None, data: str | None = None, pos: int | None = None):
        self.name, self.ns, self.data, self.pos = name, ns, data, pos
        self.attrs = {} if attrs is None and ns is not None else attrs
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.content: Node | None = None
        self.doctype: tuple[str | None, str | None, str | None, bool] | None = None
        self.spans: tuple[int, int, int | None, int | None] | None = None
        self.end_tag = self.self_closing = False

    @property
    def is_element(self) -> bool:
        return self.name[0] not in "#!"

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: Node) -> None:
        child.parent = self
        self.children.insert(at, child)

    def index(self, child: Node, near: int = -1) -> int:
        """The child's place; `near` and the last place are tried first."""
        kids = self.children
        for i in (near, len(kids) - 1):
            if 0 <= i < len(kids) and kids[i] is child:
                return i
        return kids.index(child)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.index(self)]
            self.parent = None

    def remove_child(self, child: Node) -> None:
        del self.children[self.index(child)]
        child.parent = None

    def insert_before(self, child: Node, reference: Node | None) -> None:
        child.detach() if child.parent is not None else None
        self.append(child) if reference is None else self.insert(self.index(reference), child)

    def replace_child(self, new: Node, old: Node) -> Node:
        at = self.index(old)
        new.detach() if new.parent is not None else None
        at = self.index(old)
        self.children[at] = new
        new.parent, old.parent = self, None
        return old

    def has_child_nodes(self) -> bool:
        return bool(self.children)

    def clone(self, deep: bool = False, attrs: dict[str, str | None] | None = None) -> Node:
        root = self._copy(attrs)
        stack = [(self, root)]
        while stack:
            source, target = stack.pop()
            if source.content is not None and (deep or source is self):
                target.content = source.content._copy()
                if deep:
                    stack.append((source.content, target.content))
            if deep:
                for c in source.children:
                    target.append(copy := c._copy())
                    stack.append((c, copy))
        return root

    def _copy(self, attrs: dict[str, str | None] | None = None) -> Node:
        own = attrs if attrs is not None else dict(self.attrs) if self.attrs is not None else None
        n = Node(self.name, self.ns, own, self.data, self.pos)
        n.doctype, n.spans, n.end_tag, n.self_closing = self.doctype, self.spans, self.end_tag, self.self_closing
        return n

    def walk(self, content: bool = True) -> Iterator[Node]:
        """Descendants in document order; a template's content before its children."""
        stack = self.children[::-1] + ([self.content] if content and self.content is not None else [])
        while stack:
            n = stack.pop()
            if n.name != "#document-fragment" or n.parent is not None:
                yield n
            stack += n.children[::-1]
            if content and n.content is not None:
                stack.append(n.content)

    @property
    def text(self) -> str:
        return (self.data or "") if self.name == "#text" else ""

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)
