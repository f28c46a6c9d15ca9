"""Operators over DataFrames, and their agreement with the engine and with SQL."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from domloom import functions as fn
from domloom.__main__ import main
from domloom.engine import edits as E
from domloom.engine.policy import CSS_PRESET_TEXT, DEFAULT_POLICY, clean_style, merge_tokens
from domloom.engine.text import code_span, escape_markdown
from domloom.operators import drop_nodes, empty_nodes, errors, matches_css, nodes, parse, query_html, select_css, text_by_document, unwrap_nodes
from domloom.plans.selectors import SelectorError
from domloom.streaming import read_pages, text_stats

PAGES = [
    (1, "<!DOCTYPE html><title>t</title><nav><ul><li><a href=/a class='k m'>1</a><li><a href=/b>2</a></ul></nav><h1>h</h1><p>x<p>y <b>z</b>"),
    (2, "<div id=d><p></p><p> <!--c--></p><p lang=en-GB>q</p></div><x><b><i><b><d></d></b></i></b></x><template><p class=k>in</p></template>"),
    (3, ""),
    (4, None),
    (5, "<table><tr><td>1<td>2</table><svg><title>s</title><p>"),
]
SELECTORS = [
    "p", "*", "a[href]", "li:first-child", "li:last-child > a", "nav li a", "h1 + p", "h1 ~ p", "p:empty", "#d > p", ".k", "[lang|=en]", "[class~=m]",
    "a[href^='/']", "a[href$=b]", "a[href*='']", "p:nth-child(2n+1)", "p:nth-of-type(2)", "p:only-of-type", ":root", "p:not(:empty)", "li:not(nav > li)",
    "p:contains('y z')", "nav, p.k", "x > b d", "x b d", "div p, h1 ~ p", "td + td", ":not(p)",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


@pytest.fixture(scope="module")
def table(pages):
    return nodes(pages).cache()


@pytest.mark.parametrize("css", SELECTORS)
def test_plans_agree_with_matcher(pages, table, css):
    got = sorted((r.page_id, r.name) for r in select_css(table, css).select("page_id", "name").collect())
    want = sorted((r.page_id, r.name) for r in query_html(pages, css).select("page_id", "name").collect())
    assert got == want


def test_bad_selectors_fail_before_any_job(table, pages):
    for f in (lambda: select_css(table, "p["), lambda: query_html(pages, "p["), lambda: parse(pages, transforms=[E.Drop("p[")])):
        with pytest.raises(SelectorError):
            f()


def test_intervals(table):
    a, d = table.alias("a"), table.alias("d")
    inside = (F.col("a.page_id") == F.col("d.page_id")) & (F.col("a.tree_id") == F.col("d.tree_id")) & (F.col("a.node_id") < F.col("d.node_id")) & (F.col("d.post") < F.col("a.post"))
    depth = d.join(a, inside, "left").groupBy("d.page_id", "d.node_id").agg(F.count("a.node_id").alias("n"))
    flat = table.where("tree_id = 0").join(depth, ["page_id", "node_id"])
    assert flat.where("n <> depth").count() == 0


def test_outputs_and_failures(spark, pages):
    row = parse(pages.where("page_id = 1"), outputs=("text", "markdown", "html", "dump", "errors", "tokens", "quirks", "encoding")).first()
    assert row.text == "t 1 2 h x y z" and row.quirks == "no-quirks" and row.encoding is None and row.parse_failure is None
    assert row.markdown.startswith("- [1](/a)\n- [2](/b)") and row.tokens[0].kind == "doctype"
    boom = parse(pages, outputs=("text",), transforms=[E.Edit("nav", lambda n: 1 / 0)]).orderBy("page_id").collect()
    assert "ZeroDivisionError" in boom[0].parse_failure and boom[0].text is None and boom[1].parse_failure is None
    strict = parse(pages, outputs=("text",), strict=True)
    assert strict.where("parse_failure IS NOT NULL").count() >= 1
    assert parse(pages.where("page_id > 2"), outputs=("text",)).where("text = ''").count() == 2
    with pytest.raises(ValueError):
        parse(pages, outputs=("nope",))


def test_clashing_columns(pages):
    odd = pages.withColumns({"text": F.lit(1), "nodes": F.lit(2), "__html": F.lit(3)})
    out = parse(odd, outputs=("text",))
    assert out.columns == ["page_id", "nodes", "__html", "text", "parse_failure"]
    assert out.where("page_id = 1").first().text == "t 1 2 h x y z"
    assert parse(pages.limit(0), outputs=("text", "nodes")).count() == 0


def test_bytes(spark):
    df = spark.createDataFrame([(1, "ü<meta charset=utf-8>".encode(), None), (2, "ü".encode("latin1"), "latin1"), (3, None, None)], "id int, content binary, label string")
    out = parse(df, "content", outputs=("text", "encoding"), encoding_col="label").orderBy("id").collect()
    assert [(r.text, r.encoding) for r in out] == [("ü", "utf-8"), ("ü", "windows-1252"), ("", None)]


def test_error_rows(pages):
    found = {(r.page_id, r.code) for r in errors(pages).collect()}
    assert (2, "expected-doctype-but-got-start-tag") in found and not any(p == 3 and c != "expected-doctype-but-got-eof" for p, c in found)


def test_expressions_agree_with_engine(spark):
    texts = ["a & <b>", "`x`y``", "\\*_[z]", "", 'q"\'', "a\n\n b\f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", fn.escape_markdown("t").alias("m"), fn.code_span("t").alias("c"), fn.merge_tokens("t", ["k", "a"]).alias("k")).collect()
    for r in rows:
        assert (r.m, r.c, r.k) == (escape_markdown(r.t), code_span(r.t), merge_tokens(r.t, ["a", "k"]))
    styles = ["color: red; x: 1", "color:url(a)", "font-size: 1em ; COLOR: blue", "color", "", "color: ex/**/pression(1)", "color: \\72"]
    rows = spark.createDataFrame([(s,) for s in styles], "s string").select("s", fn.clean_style("s", CSS_PRESET_TEXT).alias("c")).collect()
    assert all(r.c == clean_style(r.s, CSS_PRESET_TEXT) for r in rows)
    urls = ["http://a", "//b/c", "#d", "", " ", "x y", "java\nscript:1", "tel:1", "HTTPS://E", "a:b", "/p:q", "?x:y"]
    rule = DEFAULT_POLICY.url_policy.allow_rules["a", "href"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", fn.url_allowed("u", rule).alias("k")).collect()
    assert all(r.k == DEFAULT_POLICY.url_policy.clean("a", "href", r.u) for r in rows)


def test_attribute_expressions(spark):
    df = spark.sql("SELECT array(named_struct('name', 'Class', 'value', 'x'), named_struct('name', 'onclick', 'value', 'y'), named_struct('name', 'title', 'value', '')) AS attrs")
    row = df.select(
        fn.drop_attrs("attrs", ["on*"]).alias("a"), fn.keep_attrs(F.lit("p"), "attrs", {"*": ["class"], "p": ["title"]}).alias("b"), fn.set_attr("attrs", "title", "t").alias("c"), fn.start_tag(F.lit("p"), "attrs").alias("d"),
    ).first()
    assert [x.name for x in row.a] == ["Class", "title"] and [x.name for x in row.b] == ["class", "title"]
    assert row.c[-1].value == "t" and row.d == '<p Class="x" onclick="y" title>'


def test_predicates_are_pushed_to_stored_nodes(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    plan = stored.where(matches_css("a")).select("page_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(name)" in plan or "EqualTo(name_lc,a)" in plan
    assert "ReadSchema: struct<page_id:bigint,name:string,name_lc:string>" in plan


def test_sql_table_functions(spark, pages):
    fn.register(spark)
    pages.createOrReplaceTempView("test_pages")
    assert spark.sql("SELECT count(*) AS n FROM test_pages, LATERAL html_nodes(html) WHERE name = 'li'").first().n == 2
    assert spark.sql("SELECT * FROM html_links('see a.com')").first().href == "http://a.com"
    assert spark.sql("SELECT html_text(html) AS t FROM test_pages WHERE page_id = 5").first().t == "1 2"
    assert spark.sql("SELECT count(*) AS n FROM html_tokens('<p>x')").first().n == 2
    assert spark.sql("SELECT count(*) AS n FROM html_errors('<p></b>')").first().n == 2


def test_streaming(spark, data, tmp_path):
    source = tmp_path / "in"
    made = spark.read.parquet(f"{data}/pages.parquet").limit(20).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(page_id as int) % 30)"))
    made.repartition(3).write.parquet(str(source))
    pages = read_pages(spark, str(source), made.schema, files_per_trigger=1)
    assert parse(pages, outputs=("text",)).isStreaming
    q = text_stats(pages, "ts").writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    total = spark.table("stats").agg(F.sum("pages"), F.sum("chars")).first()
    want = parse(made, outputs=("text",)).agg(F.count("*"), F.sum(F.length("text"))).first()
    assert tuple(total) == tuple(want)


def test_cli(tmp_path, capsys):
    page = tmp_path / "a.html"
    page.write_text("<p>x <b>y</b></p><p>z</p>")
    assert main([str(page), "--selector", "p", "--format", "text"]) == 0
    assert capsys.readouterr().out == "x y\nz\n"
    assert main([str(page), "--selector", "p", "--first", "--format", "markdown"]) == 0
    assert capsys.readouterr().out == "x **y**\n"
    assert main([str(page), "--selector", "q"]) == 1 and main([str(page), "--selector", "p["]) == 2 and main([]) == 1
    assert main([str(page), "--fragment", "--output", str(tmp_path / "o")]) == 0 and "<p>z</p>" in (tmp_path / "o").read_text()
    done = subprocess.run([sys.executable, "-m", "domloom", "--version"], capture_output=True, text=True, check=True)
    assert done.stdout.strip()


def test_reports_and_emitted_errors(pages):
    def look(n):
        E.emit_error("seen", n, message="m")

    steps = [E.Edit("h1", look), E.Drop("nav")]
    row = parse(pages.where("page_id = 1"), outputs=("reports", "errors"), transforms=steps, locations=True).first()
    assert {r.message for r in row.reports} == {"edited <h1>", "drop <nav>"} and all(r.line == 1 for r in row.reports)
    assert [(e.category, e.code, e.message) for e in row.errors if e.category == "transform"] == [("transform", "seen", "m")]


def test_collected_security_errors(spark):
    from domloom.engine.policy import SanitizationPolicy

    df = spark.createDataFrame([(1, "<p onclick=x>a</p>\n<script>b</script>")], "id int, html string")
    out = parse(df, outputs=("html", "errors"), policy=SanitizationPolicy(["p"], {}, unsafe_handling="collect"), pretty=False).first()
    found = [(e.line, e.message) for e in out.errors if e.category == "security"]
    assert (1, "Unsafe attribute 'onclick' (matched pattern 'on*')") in found and (2, "Unsafe tag 'script' (dropped content)") in found
    lines = df.select(fn.source_line("html", F.lit(2)).alias("x"), fn.source_line("html", F.lit(9)).alias("y")).first()
    assert lines.x == "<script>b</script>" and lines.y is None


@pytest.mark.parametrize("css", ["nav", "p", "b, li", "div > p", "template", "x b"])
@pytest.mark.parametrize(("relational", "edit"), [(drop_nodes, E.Drop), (empty_nodes, E.Empty), (unwrap_nodes, E.Unwrap)])
def test_relational_edits_agree_with_the_worker(pages, table, relational, edit, css):
    if (css, edit) == ("template", E.Unwrap):
        pytest.skip("hoists content in the worker alone")
    count = lambda df: {(r.page_id, r.name): r.n for r in df.groupBy("page_id", "name").agg(F.count("*").alias("n")).collect()}
    got, want = relational(table, css), nodes(pages, transforms=[edit(css)])
    joined = lambda df: {r.page_id: r.text.replace(" ", "") for r in text_by_document(df).collect()}
    assert joined(got) == joined(want)
    if edit is not E.Unwrap:
        assert count(got) == count(want)
    parents = lambda df: sorted((r.page_id, r.a, r.b) for r in df.alias("c").join(df.alias("p"), F.expr("c.page_id = p.page_id AND c.parent_id = p.node_id")).where("c.name <> '#text'").select("c.page_id", F.col("c.name").alias("a"), F.col("p.name").alias("b")).collect())
    assert parents(got) == parents(want)


def test_text_by_document(pages, table):
    whole = {r.page_id: r.text for r in parse(pages, outputs=("text",), safe=False).collect() if r.text}
    assert {r.page_id: r.text for r in text_by_document(table).collect()} == whole
