"""CSS selectors over a nodes table, as Catalyst predicates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selectors import Complex, Selector, Simple, nth, parse

#: White space as Unicode has it, which class lists and words are split by. Fixed values.
SPACES = "\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def attr(name: str) -> Column:
    """The value of an attribute by its lower-cased name; null if it is absent."""
    return F.get(F.filter("attrs", lambda a: F.lower(a["name"]) == name), F.lit(0))["value"]


def _words(value: Column) -> Column:
    return F.split(value, f"[{SPACES}]+")


def nth_column(expression: str, index: Column) -> Column:
    """an+b over a 1-based index column; false where the expression isn't one."""
    got = nth(expression)
    if got is None:
        return F.lit(False)
    a, b = got
    if a == 0:
        return index == b
    return (F.pmod(index - b, F.lit(abs(a))) == 0) & ((index >= b) if a > 0 else (index <= b)) & (index > 0)


def simple_column(t: Simple) -> Column:
    if t.kind == "any":
        return F.lit(True)
    if t.kind == "tag":
        return F.col("name_lc") == t.name
    if t.kind == "id":
        return F.coalesce(attr("id") == t.name, F.lit(False))
    if t.kind == "class":
        return F.coalesce(F.array_contains(_words(attr("class")), t.name), F.lit(False))
    if t.kind == "attr":
        v, w = attr(t.name), t.value or ""
        test = {
            None: lambda: v.isNotNull(), "=": lambda: v == w, "~=": lambda: F.array_contains(_words(v), w) & F.lit(bool(w)),
            "|=": lambda: (v == w) | v.startswith(w + "-"), "^=": lambda: v.startswith(w) & F.lit(bool(w)),
            "$=": lambda: v.endswith(w) & F.lit(bool(w)), "*=": lambda: v.contains(w) & F.lit(bool(w)),
        }[t.op]()
        return F.coalesce(test, F.lit(False))
    parented = F.col("parent_id").isNotNull()
    if t.name.startswith("nth-"):
        return parented & nth_column(t.arg, F.col("type_idx" if "of-type" in t.name else "elem_idx"))
    if t.name == "root":
        return F.coalesce(F.col("parent_name").isin("#document", "#document-fragment"), F.lit(False))
    if t.name == "empty":
        return F.col("is_empty")
    index, count = (F.col("type_idx"), F.col("type_cnt")) if "of-type" in t.name else (F.col("elem_idx"), F.col("elem_cnt"))
    if t.name.startswith("first"):
        return parented & (index == 1)
    if t.name.startswith("last"):
        return parented & (index == count)
    return parented & (count == 1)


def _plain(s: Selector) -> bool:
    """Whether a selector needs no other row than the node's own."""
    return all(len(c.steps) == 1 and all(t.kind != "pseudo" or (t.name != "contains" and (t.name != "not" or _plain(t.arg))) for t in c.steps[0][1]) for c in s.options)


def _predicate(tests: tuple[Simple, ...]) -> Column:
    out = ~F.col("name").startswith("#")
    for t in tests:
        if t.kind == "pseudo" and t.name == "not":
            out = out & ~_any(t.arg)
        else:
            out = out & simple_column(t)
    return out


def _any(s: Selector) -> Column:
    return reduce(lambda a, b: a | b, (_predicate(c.steps[0][1]) for c in s.options), F.lit(False))


def matches_css(css: str) -> Column:
    """A selector of compounds alone as one boolean column over a nodes table: pushed, pruned and compiled like any other."""
    s = parse(css)
    if not _plain(s):
        raise ValueError("combinators and :contains need select_css")
    return _any(s)


_POINTER = ("node_id", "post", "parent_id", "tree_id", "prev_elem_id", "elem_idx")


def _matching(nodes: DataFrame, tests: tuple[Simple, ...], id_col: str) -> DataFrame:
    """Rows of nodes that a compound fits."""
    plain = tuple(t for t in tests if t.kind != "pseudo" or (t.name != "contains" and (t.name != "not" or _plain(t.arg))))
    out = nodes.where(_predicate(plain))
    for t in tests:
        if t in plain:
            continue
        if t.name == "not":
            hit = select_css(nodes, t.arg, id_col).select(id_col, "node_id")
            out = out.join(hit, [id_col, "node_id"], "left_anti")
        else:
            out = out.join(_containing(nodes, t.arg, id_col), [id_col, "node_id"], "left_semi")
    return out


def _containing(nodes: DataFrame, text: str, id_col: str) -> DataFrame:
    """Nodes whose visible text holds a string: text rows in order, joined by a space, without scripts, styles and foreign
    content."""
    words = nodes.where((F.col("name") == "#text") & (F.trim(F.regexp_replace("data", f"[{SPACES}]+", " ")) != ""))
    words = words.select(id_col, F.col("tree_id").alias("t"), F.col("node_id").alias("w"), F.col("post").alias("p"), "text_ord", F.regexp_replace("data", f"^[{SPACES}]+|[{SPACES}]+$", "").alias("data"))
    hidden = nodes.where(F.col("name_lc").isin("script", "style") | F.col("namespace").isin("svg", "math"))
    hidden = hidden.select(F.col(id_col).alias("hd"), F.col("tree_id").alias("ht"), F.col("node_id").alias("hn"), F.col("post").alias("hp"))
    seen = words.join(hidden, (F.col(id_col) == F.col("hd")) & (F.col("t") == F.col("ht")) & (F.col("hn") < F.col("w")) & (F.col("p") < F.col("hp")), "left_anti")
    above = nodes.where(~F.col("name").startswith("#")).select(F.col(id_col).alias("d"), "node_id", "tree_id", "post")
    joined = above.join(seen, (F.col("d") == F.col(id_col)) & (F.col("tree_id") == F.col("t")) & (F.col("node_id") < F.col("w")) & (F.col("p") < F.col("post")))
    whole = joined.groupBy(F.col("d").alias(id_col), "node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("text_ord", "data"))), lambda x: x["data"]), " ").alias("text"))
    return whole.where(F.col("text").contains(text)).select(id_col, "node_id")


def _complex(nodes: DataFrame, c: Complex, id_col: str) -> DataFrame:
    """(id_col, node_id) of nodes that a complex selector fits: from the right, each step moves to the nearest fit."""
    steps = c.steps
    pointer = [F.col(x).alias(f"c_{x}") for x in _POINTER]
    cur = _matching(nodes, steps[-1][1], id_col).select(F.col(id_col).alias("c_doc"), F.col("node_id").alias("hit"), *pointer)
    for k in range(len(steps) - 1, 0, -1):
        how = steps[k][0]
        to = _matching(nodes, steps[k - 1][1], id_col).select(F.col(id_col).alias("a_doc"), *[F.col(x).alias(f"a_{x}") for x in _POINTER])
        on = F.col("c_doc") == F.col("a_doc")
        if how == ">":
            on = on & (F.col("c_parent_id") == F.col("a_node_id"))
        elif how == "+":
            on = on & (F.col("c_prev_elem_id") == F.col("a_node_id"))
        elif how == " ":
            on = on & (F.col("c_tree_id") == F.col("a_tree_id")) & (F.col("a_node_id") < F.col("c_node_id")) & (F.col("c_post") < F.col("a_post"))
        else:
            on = on & (F.col("c_parent_id") == F.col("a_parent_id")) & (F.col("a_elem_idx") < F.col("c_elem_idx"))
        if k == 1:
            cur = cur.join(to, on, "left_semi")
            break
        cur = cur.join(to, on).select("c_doc", "hit", *[F.col(f"a_{x}").alias(f"c_{x}") for x in _POINTER])
        if how in (" ", "~"):
            near = F.max_by(F.struct(*[f"c_{x}" for x in _POINTER]), "c_node_id").alias("n")
            cur = cur.groupBy("c_doc", "hit").agg(near).select("c_doc", "hit", "n.*")
    return cur.select(F.col("c_doc").alias(id_col), F.col("hit").alias("node_id"))


def select_css(nodes: DataFrame, css: str | Selector, id_col: str = "page_id") -> DataFrame:
    """The rows of a nodes table that a selector fits, the roots aside; order by (id_col, query_ord) for document order.

    Compounds are predicates on the row. '>' and '+' are equi joins; ' ' and '~' are equi joins on document and tree with a
    range condition, and keep the nearest fit, without trying another: the semantics of the engine's own matcher. The
    leftmost step is a semi join, and a list of selectors never repeats a row.
    """
    s = parse(css) if isinstance(css, str) else css
    inner = nodes.where(F.col("parent_id").isNotNull())
    plain = Selector(tuple(c for c in s.options if _plain(Selector((c,)))))
    if len(plain.options) == len(s.options):
        return inner.where(_any(s))
    found = [_complex(nodes, c, id_col) for c in s.options if c not in plain.options]
    if plain.options:
        found.append(inner.where(_any(plain)).select(id_col, "node_id"))
    hits = reduce(lambda a, b: a.union(b), found)
    return inner.join(hits, [id_col, "node_id"], "left_semi")


def count_css(nodes: DataFrame, css: str, id_col: str = "page_id") -> DataFrame:
    """(id_col, n): how many nodes of each document a selector fits; documents without a fit are left out."""
    return select_css(nodes, css, id_col).groupBy(id_col).agg(F.count("*").alias("n"))
