"""Ordered edits of a tree.

Edits that look at one node at a time run in one walk: at each node all of them apply, left to right, and only then the walk
goes on to its children. So a later edit sees parents that an earlier one has changed, and children that none has. Nodes that
an edit puts in a node's place are visited from the edit after it (or, after a decision to unwrap or escape, from the same
one). Whole-tree edits and stage ends part one walk from the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import lru_cache

from ..plans.selectors import Selector, parse
from . import links as _links
from .dom import Node
from .match import matches
from .names import VOID_OUTPUT
from .policy import DEFAULT_POLICY, DROP, EMPTY, ESCAPE, KEEP, UNWRAP, URL_ATTRS, SanitizationPolicy, UrlPolicy, clean_style, merge_tokens, raw_tags, tag_verdict

#: What edits of the current document have told, and the errors that callbacks have raised by emit_error.
_TOLD: ContextVar[list | None] = ContextVar("told", default=None)
_EMITTED: ContextVar[list | None] = ContextVar("emitted", default=None)

Report = Callable[[str, Node | None], None]


@dataclass(frozen=True, kw_only=True)
class Edit_:
    """What all edits take: whether they run at all, a hook called with each node they change, and one for messages. guard is
    the policy whose unsafe_handling the messages fall under, if they are findings."""

    enabled: bool = True
    callback: Callable[[Node], None] | None = None
    report: Report | None = None
    guard: SanitizationPolicy | None = None

    def told(self, n: Node, *messages: str) -> None:
        for message in messages:
            if self.guard is not None:
                self.guard.found(message)
                if self.guard.unsafe_handling == "collect" and (emitted := _EMITTED.get()) is not None:
                    emitted.append(("security", "unsafe-html", n, message))
            if self.report is not None:
                self.report(message, n)
            if (told := _TOLD.get()) is not None:
                told.append((message, n))
        if self.callback is not None:
            self.callback(n)


def emit_error(code: str, node: Node | None = None, *, message: str | None = None) -> None:
    """From a callback: add an error of category 'transform' to the document's. Outside of edits it does nothing."""
    if (emitted := _EMITTED.get()) is not None:
        emitted.append(("transform", code, node, message))


@dataclass(frozen=True)
class Selected(Edit_):
    selector: str

    @property
    def test(self) -> Selector:
        return parse(self.selector)

    def hits(self, n: Node) -> bool:
        return n.name[0] != "#" and (self.selector == "*" or matches(n, self.test))


class SetAttrs(Selected):
    def __init__(self, selector: str, attributes: Mapping[str, str | None] | None = None, *, enabled: bool = True, callback=None, report=None, **attrs: str | None):
        for k, v in {"selector": selector, "enabled": enabled, "callback": callback, "report": report, "attributes": {**(attributes or {}), **attrs}}.items():
            object.__setattr__(self, k, v)


@dataclass(frozen=True)
class Drop(Selected):
    pass


@dataclass(frozen=True)
class Unwrap(Selected):
    pass


@dataclass(frozen=True)
class Empty(Selected):
    pass


@dataclass(frozen=True)
class Edit(Selected):
    func: Callable[[Node], None]


@dataclass(frozen=True)
class EditDocument(Edit_):
    func: Callable[[Node], None]


@dataclass(frozen=True)
class Decide(Selected):
    """func says what becomes of a node: KEEP, DROP, UNWRAP, EMPTY or ESCAPE. '*' asks about nodes of every kind."""

    func: Callable[[Node], str]

    def hits(self, n: Node) -> bool:
        return self.selector == "*" or super().hits(n)


@dataclass(frozen=True)
class Judge(Edit_):
    """A policy's verdict on each node: an action and its finding."""

    verdict: Callable[[Node], tuple[str, str | None]]


@dataclass(frozen=True)
class EditAttrs(Selected):
    """func returns the new attributes, or None to leave them."""

    func: Callable[[Node], Mapping[str, str | None] | None]


RewriteAttrs = EditAttrs


@dataclass(frozen=True)
class Linkify(Edit_):
    skip_tags: Collection[str] = frozenset(["a", "code", "pre", "script", "style", "textarea"])
    fuzzy_ip: bool = False
    extra_tlds: Collection[str] = ()


@dataclass(frozen=True)
class CollapseWhitespace(Edit_):
    skip_tags: Collection[str] = frozenset(["code", "pre", "script", "style", "textarea", "title"])


@dataclass(frozen=True)
class PruneEmpty(Selected):
    strip_whitespace: bool = True


@dataclass(frozen=True)
class DropComments(Edit_):
    pass


@dataclass(frozen=True)
class DropDoctype(Edit_):
    pass


@dataclass(frozen=True)
class DropForeignNamespaces(Edit_):
    pass


@dataclass(frozen=True)
class DropAttrs(Selected):
    """patterns are names with * and ?."""

    patterns: Collection[str] = ()


@dataclass(frozen=True)
class AllowlistAttrs(Selected):
    allowed_attributes: Mapping[str, Collection[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class DropUrlAttrs(Selected):
    url_policy: UrlPolicy = field(default_factory=UrlPolicy)


@dataclass(frozen=True)
class AllowStyleAttrs(Selected):
    allowed_css_properties: Collection[str] = ()


@dataclass(frozen=True)
class MergeAttrs(Selected):
    """Tokens that an attribute must have: merge_attr('a', attr='rel', tokens=...)."""

    attr: str = ""
    tokens: Collection[str] = ()


@dataclass(frozen=True)
class Sanitize(Edit_):
    policy: SanitizationPolicy | None = None


@dataclass(frozen=True)
class Stage(Edit_):
    transforms: Sequence[object] = ()


#: Edits that only take from attributes or change them: nodes without any are passed over.
OF_ATTRIBUTES = (DropAttrs, AllowlistAttrs, DropUrlAttrs, AllowStyleAttrs)


@lru_cache(maxsize=256)
def glob(pattern: str) -> re.Pattern[str]:
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()), re.DOTALL)


def expand(e: Sanitize) -> list[Edit_]:
    """A policy as edits of one thing each. Findings go to the policy, then to the edit's report."""
    p = e.policy or DEFAULT_POLICY
    quiet = {"callback": e.callback, "report": e.report}
    unsafe = {**quiet, "guard": p}

    def content(n: Node) -> tuple[str, str | None]:
        return tag_verdict(p, n, False) if n.name.lower() in p.drop_content_tags else (KEEP, None)

    allowed = p.allowed_attributes
    if p.force_link_rel:
        allowed = {**allowed, "a": {*allowed.get("a", ()), "rel"}}
    steps = (
        (True, Judge(content, **unsafe)),
        (p.drop_comments, DropComments(**quiet)),
        (p.drop_doctype, DropDoctype(**quiet)),
        (p.drop_foreign_namespaces, DropForeignNamespaces(**unsafe)),
        (True, Judge(lambda n: tag_verdict(p, n, False) if n.is_element else (KEEP, None), **unsafe)),
        (True, DropAttrs("*", patterns=("on*", "srcdoc", "*:*"), **unsafe)),
        (True, AllowlistAttrs("*", allowed_attributes=allowed, **unsafe)),
        (True, DropUrlAttrs("*", url_policy=p.url_policy, **unsafe)),
        (True, AllowStyleAttrs("*", allowed_css_properties=p.allowed_css_properties, **unsafe)),
        (bool(p.force_link_rel), MergeAttrs("a", attr="rel", tokens=p.force_link_rel, **quiet)),
    )
    return [edit for wanted, edit in steps if wanted]


def quotes_source(edits: Sequence[object]) -> bool:
    """Whether an edit may escape tags, so that the parser must note where they stood."""
    return any(
        isinstance(e, Decide) or (isinstance(e, Sanitize) and (e.policy or DEFAULT_POLICY).disallowed_tag_handling == "escape") or (isinstance(e, Stage) and quotes_source(e.transforms))
        or (isinstance(e, Judge) and e.guard is not None and e.guard.disallowed_tag_handling == "escape")
        for e in edits
    )


def compile_edits(edits: Sequence[object]) -> list[list[Edit_]]:
    """Batches in order; a batch is one walk, or one whole-tree edit. Selectors are parsed here, so bad ones fail early."""
    batches: list[list[Edit_]] = [[]]
    for e in edits:
        if not getattr(e, "enabled", True):
            continue
        if isinstance(e, Stage):
            batches += [[], *compile_edits(e.transforms), []]
        elif isinstance(e, (PruneEmpty, EditDocument)):
            if isinstance(e, PruneEmpty):
                parse(e.selector)
            batches += [[e], []]
        elif isinstance(e, Sanitize):
            batches[-1] += expand(e)
        elif isinstance(e, Edit_):
            if isinstance(e, Selected):
                parse(e.selector)
            batches[-1].append(e)
        else:
            raise TypeError(f"not an edit: {e!r}")
    return [b for b in batches if b]


def apply_and_tell(root: Node, batches: Sequence[Sequence[Edit_]], *, source: str | None = None) -> tuple[list, list]:
    """apply_edits, and what was told and emitted meanwhile."""
    told, emitted = [], []
    tokens = _TOLD.set(told), _EMITTED.set(emitted)
    try:
        apply_edits(root, batches, source=source)
    finally:
        _TOLD.reset(tokens[0])
        _EMITTED.reset(tokens[1])
    return told, emitted


def apply_edits(root: Node, batches: Sequence[Sequence[Edit_]], *, source: str | None = None) -> Node:
    for batch in batches:
        if isinstance(batch[0], EditDocument):
            batch[0].func(root)
            batch[0].told(root, "edited document")
        elif isinstance(batch[0], PruneEmpty):
            _prune(root, batch[0])
        else:
            _Walk(batch, source).run(root)
    return root


class _Walk:
    def __init__(self, batch: Sequence[Edit_], source: str | None):
        self.batch, self.source = batch, source
        self.first: dict[int, int] = {}
        self.at = 0
        of = lambda kind: frozenset(t for e in batch if isinstance(e, kind) for t in e.skip_tags)
        self.no_links, self.no_collapse = of(Linkify), of(CollapseWhitespace)

    def run(self, root: Node) -> None:
        stack: list[list] = [[root, 0]]
        while stack:
            top = stack[-1]
            parent, i = top
            if i >= len(parent.children):
                stack.pop()
                continue
            n, self.at = parent.children[i], i
            if self._visit(n, self.first.pop(id(n), 0)):
                top[1] += 1
                if n.content is not None:
                    stack.append([n.content, 0])
                stack.append([n, 0])

    def _visit(self, n: Node, start: int) -> bool:
        """Whether n is still in its place after the edits from start on."""
        for k in range(start, len(self.batch)):
            if not self._apply(self.batch[k], n, k):
                return False
        return True

    def _drop(self, n: Node) -> None:
        """Take out the node of the walk's current place."""
        if n.parent is not None:
            del n.parent.children[n.parent.index(n, self.at)]
            n.parent = None

    def _hoist(self, n: Node, nodes: list[Node], first: int) -> None:
        parent = n.parent
        at = parent.index(n, self.at)
        parent.children[at : at + 1] = nodes
        n.parent = None
        for c in nodes:
            c.parent = parent
            self.first[id(c)] = first

    def _kids(self, n: Node) -> list[Node]:
        out, n.children = n.children, []
        if n.content is not None:
            out = out + n.content.children
            n.content.children = []
        return out

    def _apply(self, e: Edit_, n: Node, k: int) -> bool:
        name = n.name
        if isinstance(e, Linkify):
            return name != "#text" or self._linkify(e, n, k)
        if isinstance(e, CollapseWhitespace):
            if name == "#text" and not _inside(n, self.no_collapse):
                out = re.sub(r"[ \t\n\r\f]+", " ", n.data or "")
                if out != n.data:
                    n.data = out
                    e.told(n, "collapsed whitespace")
            return True
        if isinstance(e, (DropComments, DropDoctype)):
            if name != ("#comment" if isinstance(e, DropComments) else "!doctype"):
                return True
            e.told(n, "dropped " + ("comment" if name == "#comment" else "doctype"))
            self._drop(n)
            return False
        if isinstance(e, DropForeignNamespaces):
            if n.ns in (None, "html"):
                return True
            e.told(n, f"Unsafe tag '{name.lower()}' (foreign namespace)")
            self._drop(n)
            return False
        if isinstance(e, Judge):
            action, finding = e.verdict(n)
            return action == KEEP or self._decide(e, n, k, action, finding)
        if isinstance(e, OF_ATTRIBUTES) and not n.attrs:
            return True
        if not isinstance(e, Selected) or not e.hits(n):
            return True
        if isinstance(e, Decide):
            return self._decide(e, n, k, e.func(n))
        if isinstance(e, Drop):
            return self._decide(e, n, k, DROP)
        if isinstance(e, Unwrap):
            e.told(n, f"unwrapped <{name}>")
            self._hoist(n, self._kids(n), k + 1)
            return False
        if isinstance(e, Empty):
            return self._decide(e, n, k, EMPTY)
        if isinstance(e, Edit):
            e.func(n)
            e.told(n, f"edited <{name}>")
            return n.parent is not None
        self._attributes(e, n)
        return True

    def _decide(self, e: Edit_, n: Node, k: int, action: str, finding: str | None = None) -> bool:
        if action == KEEP:
            return True
        e.told(n, finding or f"{action} <{n.name}>")
        if action == DROP:
            self._drop(n)
            return False
        if action == EMPTY:
            for c in self._kids(n):
                c.parent = None
            return True
        if action == UNWRAP:
            self._hoist(n, self._kids(n), k)
            return False
        if action == ESCAPE:
            first, last = raw_tags(n, self.source)
            kids = [Node("#text", data=first), *self._kids(n), *([Node("#text", data=last)] if last else [])]
            self._hoist(n, kids, k)
            return False
        raise ValueError(f"unknown decision {action!r}")

    def _attributes(self, e: Selected, n: Node) -> None:
        if n.attrs is None:
            return
        old, findings = dict(n.attrs), []
        tag = n.name.lower()
        if isinstance(e, SetAttrs):
            new = {**old, **{k: None if v is None else str(v) for k, v in e.attributes.items()}}
        elif isinstance(e, EditAttrs):
            got = e.func(n)
            new = old if got is None else dict(got)
        elif isinstance(e, DropAttrs):
            tests = [(p, glob(p)) for p in e.patterns]
            new = {}
            for key, v in old.items():
                if fits := next((p for p, t in tests if t.fullmatch(key.lower())), None):
                    findings.append(f"Unsafe attribute '{key.lower()}' (matched pattern '{fits}')")
                else:
                    new[key] = v
        elif isinstance(e, AllowlistAttrs):
            allowed = {x.lower() for t in ("*", tag) for x in e.allowed_attributes.get(t, ())}
            new = {k.lower(): v for k, v in old.items() if k.lower() in allowed}
            findings = [f"Unsafe attribute '{k.lower()}' (not allowed)" for k in old if k.strip() and k.lower() not in allowed]
        elif isinstance(e, DropUrlAttrs):
            new = {}
            for key, v in old.items():
                low = key.lower()
                if low in URL_ATTRS:
                    kept = e.url_policy.clean(tag, low, v)
                    if kept is None:
                        findings.append(f"Unsafe URL in attribute '{low}'" + (" (no rule)" if v is not None and (tag, low) not in e.url_policy.allow_rules else ""))
                        continue
                    v = kept
                new[key] = v
        elif isinstance(e, AllowStyleAttrs):
            new = {k: clean_style(v, e.allowed_css_properties) if k.lower() == "style" else v for k, v in old.items()}
            findings = ["Unsafe inline style in attribute 'style'" for k, v in new.items() if k.lower() == "style" and v is None]
            new = {k: v for k, v in new.items() if k.lower() != "style" or v is not None}
        else:
            merged = merge_tokens(old.get(e.attr), e.tokens)
            new = {**old, e.attr: merged} if merged else old
        if new != old:
            e.told(n, *(findings or [f"changed attributes of <{n.name}>"]))
            n.attrs = new

    def _linkify(self, e: Linkify, n: Node, k: int) -> bool:
        if not n.data or _inside(n, self.no_links):
            return True
        found = _links.find_links(n.data, _links.LinkConfig(e.fuzzy_ip, frozenset(t.lower() for t in e.extra_tlds)))
        if not found:
            return True
        ns = n.parent.ns or "html"
        nodes, at = [], 0
        for x in found:
            if x.start > at:
                nodes.append(Node("#text", data=n.data[at : x.start]))
            a = Node("a", ns, {"href": x.href})
            a.append(inner := Node("#text", data=x.text))
            self.first[id(inner)] = k + 1  # what is a link now isn't looked through again, whatever tags are skipped
            nodes.append(a)
            at = x.end
        if at < len(n.data):
            nodes.append(Node("#text", data=n.data[at:]))
        e.told(n, "linkified text")
        self._hoist(n, nodes, k + 1)
        return False


def _inside(n: Node, names: Collection[str]) -> bool:
    n = n.parent
    while n is not None:
        if n.name.lower() in names:
            return True
        n = n.parent
    return False


def _prune(root: Node, e: PruneEmpty) -> None:
    """From the leaves up, so that what becomes empty goes too."""
    order = list(root.walk())
    for n in reversed(order):
        if n.name[0] in "#!" or n.name in VOID_OUTPUT or n.parent is None or not e.hits(n):
            continue
        kids = [*n.children, *(n.content.children if n.content is not None else [])]
        if any(c.name[0] not in "#!" or (c.name == "#text" and ((c.data or "").strip() if e.strip_whitespace else c.data)) for c in kids):
            continue
        e.told(n, f"pruned <{n.name}>")
        n.detach()
