"""Small literal pages, and named queries over them: one query for each part of the engine, one row for each page.

expected.py has the results that the HTML standard and the package's documents give; the SQL of a query is those rows as VALUES.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .engine import edits as E
from .engine.dom import Node
from .engine.policy import CSS_PRESET_TEXT, DEFAULT_POLICY, SanitizationPolicy, UrlPolicy, UrlProxy, UrlRule
from .expected import EXPECTED
from .operators import errors, matches_css, nodes, parse, query_html, select_css, tokens
from .operators.edit import drop_nodes, empty_nodes, text_by_document
from .sources import discard, read_html_files, shared_folder, stored, write_rendered
from .streaming import text_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def sql(name: str) -> str:
    """The expected rows of a query in SQL."""
    quoted = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(EXPECTED[name]))
    return f"SELECT n::INT AS n, result FROM (VALUES {rows}) t(n, result)"


def table(spark: SparkSession, pages: list, kind: str = "string") -> DataFrame:
    return spark.createDataFrame(list(enumerate(pages)), f"n int, html {kind}").coalesce(1)


def made(spark: SparkSession, pages: list[str], output: str = "html", **options) -> DataFrame:
    options = {"pretty": False, "safe": False, **options}
    return parse(table(spark, pages), outputs=(output,), **options).select("n", F.col(output).alias("result"))


def several(spark: SparkSession, variants: list[tuple[str, dict]], output: str = "html") -> DataFrame:
    """A row for each (page, options)."""
    one = lambda i, page, options: made(spark, [page], output, **options).withColumn("n", F.lit(i))
    return reduce(DataFrame.union, (one(i, page, options) for i, (page, options) in enumerate(variants)))


def listed(array: Column | str, one: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(array, one), " ")


TREES = {
    "tables": [
        "<table>x<tr><td>1<td>2</table>", "<table><caption>c<tr><th>h</table>y", "<table><colgroup><col span=2><col><tbody><tr><td></table>",
        "<table><tr><td><table><td>in</table>out</table>", "<table><p>f</p><tr><td>x", "<table><input type=hidden><input type=text><tr>",
        "<table><tr><td>a</tr></tbody><tfoot><tr><td>b", "<table><thead><tr><td>1</thead><tbody><td>2</table>", "<table> \n <tr>",
        "<table><form><tr><td>a</form></table>", "<b><table><td>x</b></table>", "<table><tr></td></th></caption><td>k", "<td>orphan",
        "<tr><td>q</td></tr>",
    ],
    "select": [
        "<select><option>a<option selected>b</select>", "<select><optgroup label=x><option>1<optgroup label=y><option>2</select>",
        "<select><div>d</div><button><selectedcontent></selectedcontent></button><option>one</select>", "<select><option>a<hr><option>b",
        "<select><select><p>x", "<select><input>after", "<table><tr><td><select><tr><td>z", "<select><textarea>t",
    ],
    "template": [
        "<template><tr><td>x</td></tr></template>", "<table><template><td>a</template></table>", "<template><col></template>",
        "<template><div><template>in</template></div>x</template>y", "<head><template>h</template></head>", "<template></p>text</template>",
        "</template><p>x",
    ],
    "foreign": [
        "<svg><foreignobject><p>x</foreignobject><circle/></svg>", "<svg viewbox='0 0 1 1' xlink:href=#a><lineargradient/></svg>",
        "<math><mi>x<mo>+</mi></math>", "<math><annotation-xml encoding='text/html'><p>h</annotation-xml></math>", "<svg><p>out</p></svg>",
        "<svg><title><b>t</b></title></svg>", "<svg><![CDATA[a<b]]></svg>", "<svg><font color=red>x",
        "<math definitionurl=q><mtext><b>v</b></mtext></math>", "<svg><desc></svg>z", "<p><svg></p>k",
    ],
    "formatting": [
        "<b>1<i>2</b>3</i>4", "<p><b>x</p>y</b>", "<a>1<a>2", "<b><b><b><b>x</p>", "<a><table><a>x</table>", "<b><div>1</b>2</div>", "<nobr>1<nobr>2",
        "<i><b>a<p>b</i>c", "<em><p>1</em>2<p>3", "<b>x<object></b>y</object>z", "<font size=1><p>a</font>b", "</b>x", "<b id=1><b id=2><p>x</b></b>y",
    ],
    "frameset": [
        "<frameset><frame><noframes>n</noframes></frameset>", "<html><frameset rows=1></frameset></html>x<!--c-->", "<p>x<frameset><frame></frameset>",
        "<frameset>text<frame>", "<frameset></frameset><noframes>k</noframes>",
    ],
    "head": [
        "<title>a<b>c</title>x", "<meta charset=utf-8><link rel=x><base href=y><p>", "<noscript><link><p>in</noscript>",
        "<script>a<b</script><style>p>q</style>z", "<head></head><meta>m",
        "<!doctype html><!--a--><html lang=en><!--b--><head><!--c--></head><!--d--><body>e</body><!--f--></html><!--g-->",
        "<body a=1><body b=2 a=3><html c=4>x", "<head><input type=hidden>x", "  <p>", "</head>k", "<html><body></body></html> after<p>z",
        "<noframes><b></noframes>",
    ],
    "body_starts": [
        "<p>a<address>b<p>c</address>d", "<marquee><b>x</marquee>y", "<p><img><br><wbr><embed><keygen><area>x", "<button><p>a<button>b",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<dl><dt>a<dd>b<dt>c</dl>", "<form>a<form>b</form>c", "<h1>a<h2>b</h1>c", "<image src=x>",
        "<input type=text><p><input>", "<pre>\n\na</pre><listing>\nb</listing>", "<ruby>a<rb>b<rt>c<rtc>d<rp>e</ruby>", "<textarea>\n<b></textarea>c",
        "<plaintext>a</plaintext><b>", "<xmp><b></xmp>c", "<iframe><b></iframe>c", "<p>a<hr>b", "<video><source><track><param></video>",
        "<optgroup><option>a<option>b", "<p>a<table><tr><td>b</table>c", "<br/>x<div/>y", "<noembed><b></noembed>z", "<frame><caption><col><tbody>x",
        "<dialog><details><summary>s</details></dialog>",
    ],
    "body_ends": [
        "</br>x", "</p>x", "<div><span>a</div>b", "<li>a</li></li>b", "<h1>a</h3>b", "<object><p>a</object>b", "<form><div>a</form>b</div>c",
        "<p>a</body>b</html>c", "<div>a</section>b", "<dd>a</dd>b<dt>c</dt>d", "<article><p>a</article>b", "<applet></p></applet>c",
        "<sarcasm>a</sarcasm>b", "<span>a</span></span>b",
    ],
}


def _tree(group: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return made(spark, TREES[group])

    run.__name__ = f"tree_{group}"
    return query(run)


for _group in TREES:
    _tree(_group)


@query
def tree_namespaces(spark, d):
    return made(spark, TREES["foreign"], "dump")


@query
def tree_fragments(spark, d):
    """Fragments of other contexts than a div, and a frame's document."""
    contexts = [("td", "x</td><td>y"), ("tr", "<td>a<td>b"), ("select", "<option>a<p>b"), ("template", "<tr><td>x"), ("table", "x<tr>"), ("title", "<b>&amp;"), ("script", "<b>&amp;"), ("colgroup", "<col>x"), ("body", "<body a=1>k")]
    cases = [(page, {"fragment": context}) for context, page in contexts]
    cases += [("<title>t</title><circle/>", {"fragment": ("svg", "svg")}), ("<p>x", {"iframe_srcdoc": True})]
    return several(spark, cases, "dump")


@query
def quirks_modes(spark, d):
    pages = ["<!doctype html>", "", "<!DOCTYPE html PUBLIC \"-//W3C//DTD HTML 4.01 Transitional//EN\">", "<!DOCTYPE html PUBLIC \"-//W3C//DTD XHTML 1.0 Transitional//EN\" \"x\">", "<!doctype foo>", "<!DOCTYPE html SYSTEM \"about:legacy-compat\">", "<!DOCTYPE>"]
    return made(spark, pages, "quirks")


# ---- lexer

TOKENS = [
    "a<b c=1 d='2' e=\"3\" f g = h>x</b>", "<a/><b /><c x=1/>", "<!--a--><!----><!--> <!---><!--a--!>b<!--c", "<!doctype html><!DOCTYPE x PUBLIC 'p' \"s\"><!doctype y SYSTEM 's'>",
    "<!DOCTYPE a PUBLIC><!DOCTYPE b PUBLIC'p's'><!DOCTYPE c SYSTEM><!doctype d z>", "<?php x><!x></ y></><3<", "<title>a&lt;</title ><b>", "<script><!--<script></script>--></script>x", "<style></styl</style>",
    "<textarea></text></textarea>", "<plaintext></plaintext>", "&amp;&lt;&notit;&#65;&#x42;&#0;&#x80;&nbsp&copy=1", "<a b='&amp;&lt;x&notit;' c=&copy=1 d=\"&#x41;\">", "<a a=1 A=2 b b>", "<a\tb\n=\fc>", "<a =b c\"d>",
    "<a b=c\"d e=`f>", "﻿x\r\ny\rz", "<![CDATA[x]]>", "<a b='", "<a", "</a b=c>", "<svg><![CDATA[y]]></svg>", "<xmp></x></xmp><noembed></no</noembed><noframes><b></noframes><iframe></if></iframe>",
    "<script>a<!-- b</script>c", "<script><!--<script>x</script>y</script>z", "<script><!-- - -- --></script>",
]


def _token(t: Column) -> Column:
    attrs = F.array_join(F.transform(t["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit("="), a["value"])), "")
    doctype = F.concat_ws("|", t["public_id"], t["system_id"])
    return F.concat(F.substring(t["kind"], 1, 1), F.lit("("), F.coalesce(t["name"], F.lit("")), F.coalesce(attrs, F.lit("")), F.coalesce(t["data"], F.lit("")), doctype, F.when(t["self_closing"], F.lit("/")).otherwise(F.lit("")), F.lit(")"))


@query
def lexer_tokens(spark, d):
    return made(spark, TOKENS, "tokens").select("n", listed("result", _token).alias("result"))


@query
def lexer_states(spark, d):
    """Tokens from a state that another place in a page would have set."""
    states = [("rcdata", "title", "a<b>&amp;</title>x"), ("rawtext", "style", "a<b>&amp;</style>x"), ("script", "script", "<!--<script></script>--></script>x"), ("plaintext", "", "a</plaintext>&amp;"), ("cdata", "", "a<b>]]><c>"), ("rcdata", "title", "</titles></title/>")]
    frame = lambda i, state, tag, page: tokens(table(spark, [page]), "n", "html", initial_state=state, last_start_tag=tag).withColumn("n", F.lit(i))
    rows = reduce(DataFrame.union, (frame(i, *x) for i, x in enumerate(states)))
    whole = F.sort_array(F.collect_list(F.struct("seq", *[c for c in rows.columns if c not in ("n", "seq")])))
    return rows.groupBy("n").agg(whole.alias("t")).select("n", listed("t", _token).alias("result"))


@query
def xml_coercion(spark, d):
    """In the engine, and as a column: non-characters of the planes, form feeds, dashes of comments."""
    text = "a\fb﷐￿\U0003fffe\U000afffff\U0010ffff"
    page = several(spark, [(text, {"xml_coercion": True}), ("<!--a--b---c-->", {"xml_coercion": True})])
    return page.union(table(spark, [text]).select((F.col("n") + 2).alias("n"), fn.xml_text("html"))).union(table(spark, ["a--b---c"]).select((F.col("n") + 3).alias("n"), fn.xml_comment("html")))


# ---- diagnostics

ERRORS = [
    "<!doctype html PUBLIC", "<!doctype html PUBLIC'p", "<!doctype html PUBLIC 'p'", "<!doctype html PUBLIC>", "<!doctype html PUBLIC >", "<!doctype html PUBLICx>", "<!doctype html PUBLIC x>", "<!doctype html PUBLIC ", "<!doctype html PUBLIC 'p>",
    "<!doctype html PUBLIC 'p''s'>", "<!doctype html PUBLIC 'p'x>", "<!doctype html PUBLIC 'p' x>", "<!doctype html PUBLIC 'p' ", "<!doctype html PUBLIC 'p' 's>", "<!doctype html SYSTEM", "<!doctype html SYSTEM's'>", "<!doctype html SYSTEM>",
    "<!doctype html SYSTEMx>", "<!doctype html SYSTEM x>", "<!doctype html SYSTEM ", "<!doctype html SYSTEM 's", "<!doctype html SYSTEM 's'x>", "<!doctype html x>", "<!doctype>", "<!doctypehtml>", "<!doctype",
    "<!doctype html><!-->", "<!doctype html><!--a--!>", "<!doctype html><!--a", "<!doctype html><!x>", "<!doctype html></>", "<!doctype html><a b b c=>", "<!doctype html><a/b c='1'd=\"2\">", "<!doctype html><a b=c'd =e f<g>", "<!doctype html><?x>",
    "<!doctype html></3><3", "<!doctype html><", "<!doctype html>&#0;&#x80;&#xfdd0;&copy &ampx", "<!doctype html>a\0b﷐", "<!doctype html><svg>\0\0</svg>", "<!doctype html><html>\0<head>", "<!doctype html><head></head><input type=hidden>",
    "<!doctype html><template><col>x</template>", "<!doctype html><table><colgroup>x</table>", "x", "</p>", "<p>", "<!doctype html><p></div>", "<!doctype html><table>x<b></table>", "<!doctype html><b><p></b>", "<!doctype html><div/><image>",
    "<!doctype html><table><tr><p><td></table>", "<!doctype html><select><select>", "<!doctype html><body></body>x", "<!doctype html><frameset>x</frameset>y", "<!doctype html><script><!--", "<!doctype html><title>x", "<!doctype html><svg><p></svg>",
    "<!doctype html><![CDATA[x]]>", "<!doctype html>\n<p>\n</b>", "<!doctype html><p><!doctype html>", "<!doctype html><h1><h2>", "<!doctype html><a><a>", "<!doctype html><li></ul>",
]


@query
def error_codes(spark, d):
    found = parse(table(spark, ERRORS), outputs=("errors",))
    return found.select("n", listed("errors", lambda e: F.concat(e["code"], F.lit("@"), e["line"], F.lit(":"), e["column"])).alias("result"))


@query
def error_messages(spark, d):
    pages = ["</p>", "<!doctype html><p></div>", "<!doctype html><b><p></b>", "<!doctype html><a b b>", "<!doctype html><table><p>"]
    return errors(table(spark, pages), "n").where("seq = 0").select("n", F.col("message").alias("result"))


@query
def error_highlights(spark, d):
    """The line of an error, and the part of it to show."""
    pages = table(spark, ["<!doctype html>\n<p></div><b>", "<!doctype html>\n\n  <a b b>x"])
    found = errors(pages, "n").where("seq = 0").join(pages, "n")
    span = fn.error_span("html", "line", "column")
    return found.select("n", F.concat_ws("|", fn.source_line("html", "line"), span["start"], span["end"]).alias("result"))


@query
def strict_mode(spark, d):
    """Strict parsing fails the page, not the job."""
    return parse(table(spark, ["<!doctype html><p>x", "<p>x", "<!doctype html><a b b>"]), outputs=("text",), strict=True).select("n", F.coalesce("text", "parse_failure").alias("result"))


# ---- output

PAGES = [
    "<div><p>a<p>b</div>", "<div> <b>x</b> <i>y</i> </div>", "<ul><li>a</li><li><b>b</b> c</li></ul>", "<p>a  b\n c <b> d</b></p>", "<pre> a\n  b</pre><textarea>\n x</textarea>", "<div>text<p>block</p>tail</div>", "<div><!--c--><span>s</span></div>",
    "<table><tr><td>1<td>2</table>", "<a href='x\"y' title=\"q'r\" id='' disabled class=class data-x='a&b<c>'>l</a>", "<p>&lt;&amp;&gt; \"'", "<br><img src=x><input>", "<template><p>t</template>", "<script>a<b && c</script>", "<span>a</span><span>b</span>",
    "<div>\n<span>a</span>\n<span>b</span>\n</div>", "<svg><path d=m /></svg>", "<!doctype html><!--c--><title>t</title>", "<div><a>x</a><a>y</a></div>", "<blockquote><h1>t</h1><p>u</blockquote>",
]


@query
def html_compact(spark, d):
    return made(spark, PAGES)


@query
def html_pretty(spark, d):
    return made(spark, PAGES, pretty=True)


@query
def html_deep(spark, d):
    """A page nested 5,000 deep: every level on its line, the pretty form as long as levels ask for."""
    deep = made(spark, ["<div>" * 5000 + "x"], pretty=True)
    return deep.select("n", F.concat_ws(" ", F.size(F.split("result", "\n")), F.max(F.length("result")).over(_all())).alias("result"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("n")


@query
def plain_text(spark, d):
    cases = [(page, {}) for page in PAGES] + [("<p> a <b>b</b></p>", {"separator": "|"}), ("<p> a <b>b</b></p>", {"separator": "|", "strip": False}), ("<template>in</template>out", {}), ("<script>s</script><style>t</style>u", {"safe": True})]
    return several(spark, cases, "text")


MARKDOWN = [
    "<h1>a</h1><h3>b <i>c</i></h3><p>d", "<ul><li>a<li>b<ul><li>c</ul></ul>", "<ol><li>x<li>y</ol>z", "<p>a <b>b</b> <em>c</em> <code>d`e</code>", "<a href='http://x.de/a b'>l</a> <a>m</a> <a href=/y>n <b>o</b></a>", "<pre>x\n y</pre>", "<blockquote>a<p>b</blockquote>c",
    "a<br>b<hr>c", "<img src=x alt=y>", "<table><tr><td>1</table>", "*a* _b_ [c] `d` \\e", "<p>a<p>b<div>c</div>d", "<ul><li><p>a</p><li><pre>b</pre></ul>", "<code>``</code><code>a</code>", "<title>t</title><p>x", "<blockquote><ul><li>q</ul></blockquote>",
]


@query
def markdown(spark, d):
    return made(spark, MARKDOWN, "markdown", safe=True)


@query
def markdown_columns(spark, d):
    rows = table(spark, ["a`b", "``", "x", "*_[]\\"])
    return rows.select("n", F.concat_ws(" ", fn.code_span("html"), fn.escape_markdown("html")).alias("result"))


@query
def tag_columns(spark, d):
    """Start tags and attribute edits as expressions over an array of attributes."""
    attrs = nodes(table(spark, ["<a href='x\"y' ID=b class='A b' onclick=z>"]), "n").where("name = 'a'")
    a = F.col("attrs")
    forms = [a, fn.set_attr(a, "id", "c"), fn.set_attr(a, "new", None), fn.drop_attrs(a, ("on*", "cl?ss")), fn.keep_attrs(F.lit("a"), a, {"*": ["id"], "a": ["href"]})]
    rows = attrs.select(F.posexplode(F.array(*[fn.start_tag(F.lit("a"), x) for x in forms])).alias("n", "result"))
    return rows.union(attrs.select(F.lit(len(forms)), fn.merge_tokens(F.get(F.filter(a, lambda x: x["name"] == "class"), F.lit(0))["value"], ("b", "nofollow"))))


# ---- selectors

TREE = (
    "<div id=top class='a b'><p class=x lang=en-GB>one</p><p data-k='one two'>two</p><span></span><p>three <b>bold</b></p><ul><li>1<li class=x>2<li>3<li><a href='/p/q.html'>4</a></ul></div>"
    "<section><p>s</p><em> </em></section><template><p class=x>t</p></template>"
)
CSS = [
    "p", "*", "#top", ".x", ".a.b", "[lang]", "[lang=en-GB]", "[lang|=en]", "[data-k~=two]", "[href^='/p']", "[href$=html]", "[href*=q]", "p.x", "p, li", "p:first-child", "p:last-child", "li:only-child", "b:only-child", "p:first-of-type", "p:last-of-type",
    "em:only-of-type", "li:nth-child(odd)", "li:nth-child(2n)", "li:nth-child(-n+2)", "p:nth-of-type(2)", "li:not(.x)", ":not(p, li)", ":empty", ":root", "[href='']", "[data-k~='']", "LI", "p:nth-child(n+3)",
]
COMBINED = ["div p", "div > p", "p + p", "p ~ p", "ul > li > a", "div ul a", "p + span ~ p b", "section p, ul a", "div :not(p) a", "body > *", "li ~ li.x", "span + p > b", "p:contains(three)", "div:contains('bold 1')", "li:not(ul > .x)"]


def _texts(found: DataFrame, i: int) -> DataFrame:
    whole = F.sort_array(F.collect_list(F.struct("query_ord", "name")))
    return found.agg(F.array_join(F.transform(whole, lambda x: x["name"]), " ").alias("result")).select(F.lit(i).alias("n"), "result")


@query
def selectors_on_rows(spark, d):
    """Compounds as columns of one aggregation over a nodes table."""
    n = nodes(table(spark, [TREE]), "n").where("parent_id IS NOT NULL")
    hits = lambda css: F.sort_array(F.collect_list(F.when(matches_css(css), F.struct("query_ord", "name"))))
    one = n.agg(*[F.array_join(F.transform(hits(css), lambda x: x["name"]), " ").alias(f"c{i}") for i, css in enumerate(CSS)])
    return one.select(F.posexplode(F.array(*one.columns)).alias("n", "result"))


@query
def selectors_by_joins(spark, d):
    """Combinators as joins over a stored nodes table."""
    n = stored(nodes(table(spark, [TREE]), "n"), "selector-nodes")
    return reduce(DataFrame.union, (_texts(select_css(n, css, "n"), i) for i, css in enumerate(COMBINED)))


@query
def selectors_in_worker(spark, d):
    """The same in the parse stage."""
    page = table(spark, [TREE])
    one = lambda i, css: query_html(page, css, "n").withColumnRenamed("ord", "query_ord")
    return reduce(DataFrame.union, (_texts(one(i, css), i) for i, css in enumerate([*CSS, *COMBINED])))


@query
def selector_errors(spark, d):
    """What is no selector fails on the driver, before any job."""
    def told(css: str) -> str:
        try:
            matches_css(css)
        except ValueError as e:
            return type(e).__name__
        return "fine"

    return spark.createDataFrame([(i, told(css)) for i, css in enumerate([":nope", "p[", "p >", "", "p::before", "div p", "p:nth-child(x)"])], "n int, result string")


# ---- edits

EDITED = "<div class=ad>x</div><p class='k l'>a <b>b</b>  c<!--n--></p><p> </p><svg><path/></svg><a href='http://x.de' onclick=e style='color:red;top:1'>www.y.org</a>"


def _shout(n: Node) -> None:
    n.attrs["data-seen"] = "1"


def _moved(root: Node) -> None:
    """Uses of the tree's own methods: a clone of the first p goes to its end, its first child is replaced and one put before."""
    p = root.find("p")
    copy = p.clone(deep=True)
    flat = p.clone()
    p.parent.insert_before(copy, p)
    p.replace_child(Node("#text", data="new"), p.children[0])
    p.insert_before(Node("i", "html"), p.children[1])
    copy.append(flat)
    copy.remove_child(copy.children[0])
    flat.attrs["kids"] = f"{flat.has_child_nodes()} {p.has_child_nodes()} {p.children[0].text}"


EDITS = {
    "SetAttrs": [E.SetAttrs("p", id="q", hidden=None)], "Drop": [E.Drop(".ad, svg")], "Unwrap": [E.Unwrap("b, a")], "Empty": [E.Empty("p")], "Edit": [E.Edit("a, b", _shout)], "EditDocument": [E.EditDocument(_moved)],
    "Decide": [E.Decide("*", lambda n: {"b": E.UNWRAP, "svg": E.DROP, "a": E.EMPTY, "div": E.ESCAPE}.get(n.name, E.KEEP))], "EditAttrs": [E.EditAttrs("a", lambda n: {"href": n.attrs["href"].upper()})], "RewriteAttrs": [E.RewriteAttrs("p", lambda n: None)],
    "Linkify": [E.Linkify()], "Linkify options": [E.Linkify(skip_tags=(), extra_tlds=("k",))], "CollapseWhitespace": [E.CollapseWhitespace()], "PruneEmpty": [E.PruneEmpty("p, div")], "PruneEmpty keeping": [E.PruneEmpty("p", strip_whitespace=False)], "Sanitize": [E.Sanitize()],
    "DropComments": [E.DropComments()], "DropDoctype": [E.DropDoctype()], "DropForeignNamespaces": [E.DropForeignNamespaces()], "DropAttrs": [E.DropAttrs("*", patterns=("on*", "cl?ss"))], "AllowlistAttrs": [E.AllowlistAttrs("*", allowed_attributes={"*": ["class"], "a": ["href"]})],
    "DropUrlAttrs": [E.DropUrlAttrs("a", url_policy=UrlPolicy(allow_rules={("a", "href"): UrlRule(allowed_schemes=["https"])}))], "AllowStyleAttrs": [E.AllowStyleAttrs("a", allowed_css_properties=("color",))], "MergeAttrs": [E.MergeAttrs("a", attr="rel", tokens=("nofollow", "ugc"))],
    "Stage": [E.Stage((E.Unwrap("b"), E.Drop("b"))), E.Drop("p:first-of-type")], "disabled": [E.Drop("p", enabled=False)], "order": [E.Drop("b"), E.PruneEmpty("p"), E.SetAttrs("p", last="1"), E.DropForeignNamespaces()],
}


@query
def each_edit(spark, d):
    return several(spark, [("<!doctype html>" + EDITED, {"transforms": edits}) for edits in EDITS.values()])


@query
def edit_reports(spark, d):
    """What edits report, in order, and errors that a callback emits."""
    steps = [E.Drop("svg"), E.Edit("b", lambda n: E.emit_error("found-b", n)), E.DropAttrs("a", patterns=("on*",)), E.DropComments()]
    page = parse(table(spark, [EDITED]), outputs=("reports", "errors"), transforms=steps, locations=True)
    told = listed("reports", lambda r: F.concat(r["message"], F.lit(";")))
    return page.select(F.lit(0).alias("n"), told.alias("result")).union(page.select(F.lit(1), listed(F.filter("errors", lambda e: e["category"] == "transform"), lambda e: F.concat(e["code"], F.lit("@"), e["column"]))))


@query
def relational_edits(spark, d):
    """Edits of a nodes table as joins, seen through the text that is left."""
    n = stored(nodes(table(spark, ["<div class=ad>x</div><p>a <b>b</b></p><template><i>t</i></template><p>c</p>"]), "n"), "edit-nodes")
    forms = [n, drop_nodes(n, ".ad", "n"), drop_nodes(n, "p, template", "n"), empty_nodes(n, "p", "n"), drop_nodes(n, "b", "n")]
    return reduce(DataFrame.union, (text_by_document(x, "n").select(F.lit(i).alias("n"), F.col("text").alias("result")) for i, x in enumerate(forms)))


# ---- sanitizer

_LINKS = {("a", "href"): UrlRule(allowed_schemes=("https",), allowed_hosts=("a.example",)), ("img", "src"): UrlRule(allowed_schemes=("https",)), ("img", "srcset"): UrlRule(allowed_schemes=("https",))}


def _policy(tags="a p img b", attributes=None, urls=None, **more) -> SanitizationPolicy:
    return SanitizationPolicy(tags.split(), attributes or {"*": ["class"], "a": ["href"], "img": ["src", "srcset"]}, urls or UrlPolicy(allow_rules=_LINKS), **more)


def _rewritten(tag: str, attr: str, value: str) -> str | None:
    return None if "bad" in value else value.replace("http:", "https:")


SANITIZED = [
    (EDITED, None), ("<p onclick=x class=y>a<script>s</script><u>v</u><!--c-->", _policy()), ("<a href=https://a.example/x>1</a><a href=https://b.example>2</a><a href=//a.example/y>3</a><a href=javascript:x>4</a><a href=/r>5</a><a href=#f>6</a>", _policy()),
    ("<img src=https://x/y srcset='https://x/1 1x, /2 2x'><img srcset='https://x/1, javascript:x 2x'><img srcset=' , '>", _policy()), ("<a href=https://a.example>x</a>", _policy(force_link_rel=("noopener", "NOFOLLOW"))), ("<div>x<i q=1>y</i></div>", _policy(disallowed_tag_handling="drop")),
    ("<Div  A='1'>x<br/>y</DIV><i>z", _policy(disallowed_tag_handling="escape")), ("<p style='color: red; top: 1; background-color: url(x); font-size: 1\\65m'>x</p><p style='top:1'>", _policy(attributes={"p": ["style"]}, allowed_css_properties=CSS_PRESET_TEXT)),
    ("<!doctype html><!--c--><p>x", _policy(drop_comments=False, drop_doctype=False)), ("<svg><a href=https://a.example>x</a></svg>y", _policy("svg a", drop_foreign_namespaces=False)), ("<nav><b>x</b></nav><p>y", _policy(drop_content_tags=("nav",))),
    ("<a href=http://a.example/bad>1</a><a href=http://a.example/x>2</a>", _policy(urls=UrlPolicy(allow_rules=_LINKS, url_filter=_rewritten))), ("<a href=https://a.example/?q=1 class=k>1</a><a href=#f>2</a><a href=x:y>3</a>", _policy(urls=UrlPolicy(allow_rules={("a", "href"): UrlRule(handling="proxy", allowed_schemes=("https",))}, proxy=UrlProxy("/go?a=1", "to")))),
    ("<a href='https://a.example'>1</a>", _policy(urls=UrlPolicy(allow_rules={("a", "href"): UrlRule(handling="strip", allowed_schemes=("https",))}))), ("<a href=' java\tscript:alert(1) '>1</a><a href='\x01https://a.example'>2</a><a href=tel:1>3</a>", None), ("<template><p onclick=x>t</p><script>u</script></template>", _policy("template p")),
]


@query
def sanitized_fragments(spark, d):
    return several(spark, [(page, {"safe": True, "policy": policy, "fragment": "div"}) for page, policy in SANITIZED])


@query
def sanitized_by_edit(spark, d):
    """The same policies as an edit."""
    return several(spark, [(page, {"transforms": [E.Sanitize(policy=policy)], "fragment": "div"}) for page, policy in SANITIZED])


@query
def unsafe_handling(spark, d):
    """'raise' fails the page, 'collect' lists what was found, in the clean copy and in the edit alike."""
    page = "<p onclick=x>a<script>s</script><i>v</i><svg></svg><a href=javascript:1>k</a>"
    def rows(n: int, mode: str, **options) -> DataFrame:
        df = parse(table(spark, [page]), outputs=("html", "errors"), pretty=False, fragment="div", **options)
        findings = listed(F.filter("errors", lambda e: e["category"] == "security"), lambda e: F.concat(e["message"], F.lit("@"), e["column"], F.lit(";")))
        return df.select(F.lit(n).alias("n"), F.coalesce("parse_failure", findings).alias("result"))

    raising, collecting = _policy(unsafe_handling="raise"), _policy(unsafe_handling="collect")
    return reduce(DataFrame.union, [rows(0, "raise", policy=raising), rows(1, "raise", safe=False, transforms=[E.Sanitize(policy=raising)]), rows(2, "collect", policy=collecting), rows(3, "collect", safe=False, transforms=[E.Sanitize(policy=collecting)])])


@query
def sanitized_attributes_as_columns(spark, d):
    """The attribute rules of policies as Catalyst expressions over a nodes table."""
    def one(i: int, page: str, policy: SanitizationPolicy | None) -> DataFrame:
        n = nodes(table(spark, [page]), "n", fragment="div").where("namespace = 'html' AND size(attrs) > 0")
        kept = fn.start_tag("name", fn.sanitized_attrs("name_lc", "attrs", policy or DEFAULT_POLICY))
        whole = F.sort_array(F.collect_list(F.struct("query_ord", kept.alias("tag"))))
        return n.agg(F.array_join(F.transform(whole, lambda x: x["tag"]), "").alias("result")).select(F.lit(i).alias("n"), "result")

    return reduce(DataFrame.union, (one(i, page, policy) for i, (page, policy) in enumerate(SANITIZED[:5])))


# ---- links

LINKS = [
    "see http://a.example/x.", "(https://a.example/y)", "mail me@b.example.com, ok", "www.c.org/d?e=f#g", "plain d.com and e.xyz", "//host.example/p", "http://1.2.3.4/ 1.2.3.4", "ftp://x.de:21/y", "http://a.example/(b)", "http://a.example/b)", "'http://q.example/'",
    "x@y", "mailto:a@b.c", "http://bücher.example/ü", "localhost", "http://a..b", "http://a_b.com", "foo.com,bar.com", "http://x.de:99999/", "a.b.c.museum", "[t](http://m.example)[u]", "https://u:p@h.example:80/p", "é.рф", "<http://in.example>", "http://", "test.x1", "-.-.-.",
]


def _links(found: Column) -> Column:
    return listed(found, lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), x["kind"], F.lit(":"), x["href"]))


@query
def links_in_text(spark, d):
    return table(spark, LINKS).select("n", _links(fn.html_links("html")).alias("result"))


@query
def links_with_options(spark, d):
    return table(spark, ["1.2.3.4/x 256.1.1.1", "a.xyz b.local c.com"]).select("n", _links(fn.html_links("html", fuzzy_ip=True, extra_tlds=("XYZ", "local"))).alias("result"))


# ---- bytes, files, functions

BYTES = [
    (b"\xef\xbb\xbf<p>\xc3\xa9", None), (b"\xff\xfe<\x00p\x00>\x00\xe9\x00", None), (b"\xfe\xff\x00<\x00p\x00>\x00\xe9", None), (b"<meta charset=iso-8859-2><p>\xb1", None), (b"<meta http-equiv=content-type content='text/html; charset=\"koi8-r\"'><p>\xc1", None), (b"<p>\xe9\x80", None),
    (b"<p>\xe9", "latin1"), (b"<p>\xc3\xa9", "utf-8"), (b"<p>\xe9", "nonsense"), (b"<meta charset=utf-16><p>\xc3\xa9", None), (b"<!-- <meta charset=koi8-r> --><meta charset=utf-8><p>\xc3\xa9", None), (b"<meta charset=utf-7><p>\xe9", None), (b"", None),
    (b"<script><meta charset=koi8-r></script><p>x", None), (b"<meta content='charset = shift_jis' http-equiv=Content-Type><p>\x82\xa0", None),
]


@query
def decoded_bytes_of_all_kinds(spark, d):
    raw = spark.createDataFrame([(i, content, label) for i, (content, label) in enumerate(BYTES)], "n int, content binary, label string")
    return parse(raw, "content", outputs=("text", "encoding"), encoding_col="label").select("n", F.concat_ws("|", "encoding", "text").alias("result"))


@query
def byte_order_marks(spark, d):
    raw = spark.createDataFrame([(i, content) for i, (content, _) in enumerate(BYTES)], "n int, content binary")
    return raw.select("n", fn.sniff_bom("content").alias("result"))


@query
def files_in_and_out(spark, d):
    """Renderings written as files, read again as bytes, parsed and queried."""
    path = f"{shared_folder(spark)}/rendered-pages"
    rendered = parse(table(spark, ["<p>a<b>1</b>", "<p>c<b>2</b>"]), outputs=("html",), pretty=False)
    write_rendered(rendered.coalesce(1), "html", path, mode="overwrite")
    back = parse(read_html_files(spark, path, glob="part-*"), "content", outputs=("markdown", "encoding"))
    return back.select(F.lit(0).alias("n"), F.concat_ws("|", "encoding", F.replace("markdown", F.lit("\n"), F.lit("/"))).alias("result"))


@query
def streamed_windows(spark, d):
    """Pages as a stream of files, through a watermark and windows of event time, to the end of what is there."""
    folder = f"{shared_folder(spark)}/streamed"
    rows = [("2024-01-01 00:01:00", "<p>one"), ("2024-01-01 00:05:00", "<p>two"), ("2024-01-01 00:12:00", "<b>three")]
    spark.createDataFrame(rows, "t string, html string").select(F.col("t").cast("timestamp").alias("t"), "html").write.mode("overwrite").parquet(f"{folder}/in")
    source = spark.readStream.schema("t timestamp, html string").parquet(f"{folder}/in")
    name = "domloom_streamed"
    writer = text_stats(source, "t").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/state-{F.__name__}-{id(source)}")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select((F.dense_rank().over(_ordered()) - 1).cast("int").alias("n"), F.concat_ws("|", "pages", "chars", "failed").alias("result"))


def _ordered():
    from pyspark.sql import Window

    return Window.orderBy("start")


@query
def functions_in_sql(spark, d):
    """Table functions and scalars by name, beside a table."""
    fn.register(spark)
    table(spark, ["<p>a <a href=/x>b</a> www.c.org"]).createOrReplaceTempView("domloom_case")
    statements = [
        "SELECT concat_ws(' ', html_text(html), html_markdown(html)) FROM domloom_case", "SELECT array_join(collect_list(name), ' ') FROM domloom_case, LATERAL html_nodes(html) WHERE name NOT LIKE '#%'",
        "SELECT array_join(collect_list(concat(kind, ':', coalesce(name, data))), ' ') FROM domloom_case, LATERAL html_tokens(html)", "SELECT array_join(collect_list(code), ' ') FROM domloom_case, LATERAL html_errors(html)",
        "SELECT array_join(collect_list(href), ' ') FROM domloom_case, LATERAL html_links('see www.c.org')", "SELECT html_clean(html) FROM domloom_case",
    ]
    return reduce(DataFrame.union, (spark.sql(s).toDF("result").select(F.lit(i).alias("n"), "result") for i, s in enumerate(statements)))


@query
def failures_stay_in_their_row(spark, d):
    """A page that fails has its reason in every operator; the others have their results."""
    pages = table(spark, ["<!doctype html><p>x", "<a b b>"])
    a = parse(pages, outputs=("text",), strict=True).select("n", F.coalesce("text", "parse_failure"))
    b = nodes(pages, "n", strict=True).groupBy("n").agg(F.max(F.coalesce("parse_failure", "data")))
    c = query_html(pages, "p", "n", strict=True).select("n", F.coalesce("text", "parse_failure"))
    e = pages.select("n", F.coalesce(fn.html_to_text("html", strict=True), F.lit("null")))
    return reduce(DataFrame.union, (x.toDF("n", "result").select((F.col("n") + 2 * i).alias("n"), "result") for i, x in enumerate((a, b, c, e))))


@query
def stored_tables_go_when_told(spark, d):
    kept = stored(table(spark, ["<p>x"]), "to-discard")
    n = kept.count()
    return spark.createDataFrame([(0, f"{n} {discard(kept) > 0}")], "n int, result string")
