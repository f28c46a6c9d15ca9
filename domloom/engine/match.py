"""Selectors on a tree in the worker, for edits and for queries of raw pages; queries over tables compile to plans instead."""

from __future__ import annotations

from ..plans.selectors import Complex, Selector, Simple, nth, parse
from .dom import Node
from .policy import sanitize
from .text import text_of


class Family:
    """The element children of a node: the place of each, among all and among those of its name."""

    def __init__(self, parent: Node):
        self.kids = [c for c in parent.children if c.name[0] != "#"]
        self.at = {id(c): i for i, c in enumerate(self.kids)}
        self.typed: list[int] = []
        self.types: dict[str, int] = {}
        for c in self.kids:
            name = c.name.lower()
            self.types[name] = self.types.get(name, 0) + 1
            self.typed.append(self.types[name])

    def place(self, n: Node, same: bool) -> tuple[int, int]:
        """1-based place, and how many there are."""
        i = self.at[id(n)]
        return (self.typed[i], self.types[n.name.lower()]) if same else (i + 1, len(self.kids))


class Tree:
    """What a query has found out about a tree that it doesn't change: each thing is found out once."""

    def __init__(self) -> None:
        self.families: dict[int, Family] = {}
        self.near: dict[tuple[int, int, bool], Node | None] = {}

    def family(self, parent: Node) -> Family:
        if id(parent) not in self.families:
            self.families[id(parent)] = Family(parent)
        return self.families[id(parent)]

    def nearest(self, n: Node, want: tuple[Simple, ...], up: bool) -> Node | None:
        """The nearest ancestor, or else sibling before, that a compound fits."""
        passed, found = [], None
        while True:
            key = (id(n), id(want), up)
            if key in self.near:
                found = self.near[key]
                break
            passed.append(key)
            n = n.parent if up else _before(n, self)
            if n is None or _compound(n, want, self):
                found = n
                break
        self.near.update(dict.fromkeys(passed, found))
        return found


class Changing(Tree):
    """A tree that edits change between tests: nothing is kept."""

    def family(self, parent: Node) -> Family:
        return Family(parent)

    def nearest(self, n: Node, want: tuple[Simple, ...], up: bool) -> Node | None:
        if up:
            n = n.parent
            while n is not None and not _compound(n, want, self):
                n = n.parent
            return n
        for x in reversed(n.parent.children[: n.parent.index(n)] if n.parent is not None else []):
            if x.name[0] != "#" and _compound(x, want, self):
                return x
        return None


_CHANGING = Changing()


def _before(n: Node, tree: Tree) -> Node | None:
    """The element sibling before."""
    if n.parent is None:
        return None
    family = tree.family(n.parent)
    i = family.at.get(id(n), 0)
    return family.kids[i - 1] if i else None


def _edge(n: Node, last: bool, same: bool) -> bool:
    """Whether n is the first (or last) element of its parent, or of its name there; no place has to be counted for that."""
    kids = n.parent.children if n.parent is not None else ()
    name = n.name.lower()
    return next((c is n for c in (reversed(kids) if last else kids) if c.name[0] != "#" and (not same or c.name.lower() == name)), False)


def nth_holds(a: int, b: int, i: int) -> bool:
    return i > 0 and (i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0)


def _attr(n: Node, name: str) -> str | None:
    return next((v for k, v in (n.attrs or {}).items() if k.lower() == name), None)


def _simple(n: Node, t: Simple, tree: Tree) -> bool:
    if n.name[0] == "#":
        return False
    if t.kind == "any":
        return True
    if t.kind == "tag":
        return n.name.lower() == t.name
    if t.kind == "id":
        return _attr(n, "id") == t.name
    if t.kind == "class":
        return t.name in (_attr(n, "class") or "").split()
    if t.kind == "attr":
        v = _attr(n, t.name)
        if v is None or t.op is None:
            return v is not None
        w = t.value or ""
        return {
            "=": v == w, "~=": w in v.split(), "|=": v == w or v.startswith(w + "-"),
            "^=": bool(w) and v.startswith(w), "$=": bool(w) and v.endswith(w), "*=": bool(w) and w in v,
        }[t.op]
    name = t.name
    if name == "not":
        return not t.arg.options or not any(_complex(n, c, tree) for c in t.arg.options)
    if name == "contains":
        return t.arg in text_of(sanitize(n))
    if name == "root":
        return n.parent is not None and n.parent.name in ("#document", "#document-fragment")
    if name == "empty":
        return not any(c.name[0] != "#" or (c.name == "#text" and (c.data or "").strip()) for c in n.children)
    same = "of-type" in name
    if name.startswith("nth-"):
        ab = nth(t.arg)
        return ab is not None and n.parent is not None and nth_holds(*ab, tree.family(n.parent).place(n, same)[0])
    return (name.startswith("last") or _edge(n, False, same)) and (name.startswith("first") or _edge(n, True, same))


def _compound(n: Node, tests: tuple[Simple, ...], tree: Tree) -> bool:
    return all(_simple(n, t, tree) for t in tests)


def _complex(n: Node, c: Complex, tree: Tree) -> bool:
    """Right to left; each step takes the nearest node that fits and doesn't try another."""
    steps = c.steps
    if not _compound(n, steps[-1][1], tree):
        return False
    for k in range(len(steps) - 1, 0, -1):
        how, want = steps[k][0], steps[k - 1][1]
        if how in " ~":
            n = tree.nearest(n, want, how == " ")
        else:
            n = n.parent if how == ">" else _before(n, tree)
            if n is not None and not _compound(n, want, tree):
                n = None
        if n is None:
            return False
    return True


def matches(n: Node, selector: Selector | str, tree: Tree | None = None) -> bool:
    selector = parse(selector) if isinstance(selector, str) else selector
    tree = tree or _CHANGING
    return any(_complex(n, c, tree) for c in selector.options)


def query(root: Node, css: str) -> list[Node]:
    """Descendants of root that match, in document order."""
    selector, tree = parse(css), Tree()
    return [n for n in root.walk() if n.name[0] != "#" and matches(n, selector, tree)]
