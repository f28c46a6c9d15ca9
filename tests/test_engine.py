"""Lexing, rendering, sanitizing, editing, link detection and decoding of single documents."""

import pytest

from domloom.engine import edits as E
from domloom.engine.builder import Builder
from domloom.engine.document import Document, Options, StrictModeError
from domloom.engine.dom import Node
from domloom.engine.encoding import decode, normalise, sniff
from domloom.engine.html import render
from domloom.engine.lexer import stream
from domloom.engine.links import LinkConfig, find_links
from domloom.engine.match import query
from domloom.engine.policy import CSS_PRESET_TEXT, DEFAULT_POLICY, SanitizationPolicy, UnsafeHtmlError, UrlPolicy, UrlProxy, UrlRule, clean_style, sanitize
from domloom.plans.selectors import SelectorError, nth, parse


def fragment(html):
    return Builder(html, fragment=("div", "html")).parse()


def compact(root):
    return render(root, pretty=False)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("a<b c=1 c=2 D='&lt;' e>x</B >", [("text", "a"), ("start", "b", {"c": "1", "d": "<", "e": ""}), ("text", "x"), ("end", "b")]),
        ("<a href=x?a=1&copy=2&amp;b>", [("start", "a", {"href": "x?a=1&copy=2&b"})]),
        ("&notit; &#x80; &#0; &nope;", [("text", "¬it; € � &nope;")]),
        ("<title>a<b></title><p>", [("start", "title", {}), ("text", "a<b>"), ("end", "title"), ("start", "p", {})]),
        ("<!--a--!>b<!-->c<?x?></ y>", [("comment", "a"), ("text", "b"), ("comment", ""), ("text", "c"), ("comment", "?x?"), ("comment", " y")]),
        ("a\r\nb\rc", [("text", "a\nb\nc")]),
        ("x < y <3", [("text", "x < y <3")]),
        ("only x<y", [("text", "only x"), ("text", "<y")]),
        ("<![CDATA[x]]>", [("comment", "[CDATA[x]]")]),
        ("<a/b/>", [("start", "a", {"b": ""})]),
        ('<a b="1"c>', [("start", "a", {"b": "1", "c": ""})]),
        ("<a b = 'v'>", [("start", "a", {"b": "v"})]),
    ],
)
def test_tokens(html, expected):
    got = [(t.kind, t.name, t.attrs) if t.kind == "start" else (t.kind, t.name or t.data) for t in stream(html)]
    assert got == expected


def test_doctype_tokens():
    one = next(iter(stream("<!DOCTYPE Html PUBLIC 'a' \"b\">")))
    assert one.doctype == ("html", "a", "b", False)
    assert next(iter(stream("<!doctype>"))).doctype == (None, None, None, True)
    assert next(iter(stream("<!doctype html system>"))).doctype[3]


def test_compact_and_pretty():
    html = '<p class="a">x &lt; <b>y</b><br></p><pre> a\n b</pre><img alt=\'say "hi"\'>'
    assert compact(fragment(html)) == html
    doc = Document("<ul><li>a</li><li><b>c</b> d</li></ul>", Options())
    assert doc.html() == "<html>\n  <head></head>\n  <body>\n    <ul>\n      <li>a</li>\n      <li><b>c</b> d</li>\n    </ul>\n  </body>\n</html>"
    assert Document("<div>a<p>b</p>c</div>", Options()).html().split("\n")[3:8] == ["    <div>", "      a", "      <p>b</p>", "      c", "    </div>"]
    assert "<span>a</span><span>b</span>" in Document("<p><span>a</span><span>b</span> t</p>", Options()).html()


def test_text_and_markdown():
    html = "<head><title>t</title></head><h1>A *b*</h1><p>x  <em>y</em> <a href='/q (1)'>l\n k</a></p><ul><li>1<li>2</ul><pre>c\n d</pre><blockquote>q<p>r</blockquote><script>s</script><code>`</code>"
    doc = Document(html, Options())
    assert doc.text() == "t A *b* x y l\n k 1 2 c\n d q r `"
    assert doc.markdown() == "# A \\*b\\*\n\nx *y* [l k](</q%20(1)>)\n\n- 1\n- 2\n\n```\nc\n d\n```\n\n> q\n>\n> r\n\n`` ` ``"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p onclick=x id=y>a<script>b</script><foo>c</foo></p><!--d-->", '<p id="y">ac</p>'),
        ("<a href='java\tscript:x'>a</a><a href='/b'>b</a><a href='//c.d/e'>c</a>", '<a>a</a><a href="/b">b</a><a href="https://c.d/e">c</a>'),
        ("<img src='http://x/y.png' alt=z><img src=y.png>", '<img alt="z"><img src="y.png">'),
        ("<svg><p>x</svg>y<style>z</style><math><mi>q", "<p>xy</p>"),
        ("<table><tr><td colspan=2 style='color:red'>q", '<table><tbody><tr><td colspan="2">q</td></tr></tbody></table>'),
    ],
)
def test_default_policy(html, expected):
    got = compact(sanitize(fragment(html)))
    assert got == expected


def test_policies():
    rule = UrlRule(allowed_schemes=["https"], allowed_hosts=["a.b"], handling="proxy", proxy=UrlProxy("/p"))
    policy = SanitizationPolicy(["a", "p"], {"a": ["href"], "p": ["style"]}, UrlPolicy(allow_rules={("a", "href"): rule}), allowed_css_properties=CSS_PRESET_TEXT, force_link_rel=["noopener"])
    html = "<a href='https://a.b/c d' rel='X noopener'>1</a><a href='https://c.d'>2</a><p style='color: red; width: 1px'>3</p>"
    assert compact(sanitize(fragment(html), policy)) == '<a href="/p?url=https%3A%2F%2Fa.b%2Fc%20d" rel="x noopener">1</a><a rel="noopener">2</a><p style="color: red">3</p>'
    with pytest.raises(UnsafeHtmlError):
        sanitize(fragment("<script>"), SanitizationPolicy(["p"], {}, unsafe_handling="raise"))
    assert compact(sanitize(fragment("<x>a</x>"), SanitizationPolicy(["p"], {}, disallowed_tag_handling="escape"))) == "&lt;x&gt;a&lt;/x&gt;"
    assert compact(sanitize(fragment("<x>a</x>b"), SanitizationPolicy(["p"], {}, disallowed_tag_handling="drop"))) == "b"
    with pytest.raises(ValueError, match="allows the 'style' attribute"):
        SanitizationPolicy(["p"], {"p": ["style"]})
    with pytest.raises(ValueError):
        UrlPolicy(allow_rules={("a", "href"): UrlRule(handling="proxy")})
    assert clean_style("background: url(x); color: u/**/rl(y); color: \\72", ["color", "background"]) is None


def test_strict():
    with pytest.raises(StrictModeError):
        Document("<p></b>", Options(strict=True))
    assert Document("<!DOCTYPE html><p>x</p>", Options(strict=True)).text() == "x"


def edited(html, *steps):
    root = fragment(html)
    return compact(E.apply_edits(root, E.compile_edits(steps)))


def test_edits():
    assert edited("<p>a</p>", E.SetAttrs("p", id="x", hidden=None)) == '<p id="x" hidden>a</p>'
    assert edited("<p>a<i>b</i></p><u>c</u>", E.Drop("i, u")) == "<p>a</p>"
    assert edited("<p>a<i>b<u>c</u></i></p>", E.Unwrap("i")) == "<p>ab<u>c</u></p>"
    assert edited("<p>a<i>b</i></p>", E.Empty("p")) == "<p></p>"
    assert edited("<p>a</p>", E.Edit("p", lambda n: n.append(Node("#text", data="!")))) == "<p>a!</p>"
    assert edited("<p a=1 onx=2 xml:b=3>", E.DropAttrs("*", patterns=["on*", "*:*"])) == '<p a="1"></p>'
    assert edited("<a rel=a>", E.MergeAttrs("a", attr="rel", tokens=["b", "a"])) == '<a rel="a b"></a>'
    assert edited("<div><p> <b></b></p><img></div><p>x</p>", E.PruneEmpty("*")) == "<div><img></div><p>x</p>"
    assert edited("<p>a <!--c-->\n b</p>", E.DropComments(), E.CollapseWhitespace()) == "<p>a  b</p>"
    assert edited("<p>go to a.com. <code>b.com</code></p>", E.Linkify()) == '<p>go to <a href="http://a.com">a.com</a>. <code>b.com</code></p>'
    assert edited("<p>a</p>", E.Decide("p", lambda n: E.ESCAPE)) == "&lt;p&gt;a&lt;/p&gt;"
    assert edited("<p>a</p>", E.Drop("p", enabled=False)) == "<p>a</p>"
    with pytest.raises(SelectorError):
        E.compile_edits([E.Drop("p[")])
    with pytest.raises(TypeError):
        E.compile_edits([object()])


def test_edit_order():
    """Left to right at each node: a later edit sees the parent as an earlier one left it, and children not yet edited."""
    seen = []
    steps = [E.SetAttrs("p", id="x"), E.Edit("p", lambda n: seen.append((n.attrs["id"], len(n.children)))), E.Drop("p > i")]
    assert edited("<p><i>a</i><i>b</i></p>", *steps) == '<p id="x"></p>'
    assert seen == [("x", 2)]
    # Nodes that an edit makes are seen by the edits after it, not by those before.
    assert edited("a.com", E.SetAttrs("a", early="1"), E.Linkify(), E.SetAttrs("a", late="2")) == '<a href="http://a.com" late="2">a.com</a>'
    # A stage ends the walk before.
    assert edited("<p><i>a</i></p>", E.Stage([E.Drop("i")]), E.Stage([E.Edit("p", lambda n: seen.append(len(n.children)))])) == "<p></p>"
    assert seen[-1] == 0


def test_sanitize_as_edits_equals_clone():
    html = "<p onclick=x>a<script>b</script><foo>c<a href='javascript:x' title=t>d</a></foo></p><!--e-->"
    assert edited(html, E.Sanitize()) == compact(sanitize(fragment(html), DEFAULT_POLICY))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("see http://a.b/c?d=1. now", ["http://a.b/c?d=1"]),
        ("(www.x.org/a_(b))", ["www.x.org/a_(b)"]),
        ("mail me@x.com, or you@y.zz9", ["me@x.com"]),
        ("file.js and e.g. a.museum", ["a.museum"]),
        ("http://a.b:99999/ //c.d/e ://f.com", ["//c.d/e"]),
        ("_x.com http://a_b.com", []),
        ('"http://q.com"', ["http://q.com"]),
        ("", []),
    ],
)
def test_links(text, expected):
    assert [x.text for x in find_links(text)] == expected


def test_link_details():
    x = find_links("a bücher.com b")[0]
    assert (x.start, x.end, x.href, x.kind) == (2, 12, "http://xn--bcher-kva.com", "url")
    assert find_links("me@x.com")[0][3:] == ("mailto:me@x.com", "email")
    assert not find_links("1.2.3.4") and find_links("1.2.3.4", LinkConfig(fuzzy_ip=True))
    assert find_links("x.foo", LinkConfig(extra_tlds=frozenset(["foo"])))


def test_encodings():
    assert sniff(b"\xef\xbb\xbfx") == ("utf-8", 3)
    assert sniff(b"<meta charset=latin1>", None)[0] == "windows-1252"
    assert sniff(b'<!-- <meta charset=euc-jp> --><meta http-equiv=Content-Type content="text/html; charset=utf-16">')[0] == "utf-8"
    assert sniff(b" " * 2000 + b"<meta charset=utf-8>")[0] == "windows-1252"
    assert sniff(b"<meta charset=utf-8>", "iso-8859-2")[0] == "iso-8859-2"
    assert decode(b"\x80\x81") == ("€\x81", "windows-1252")
    assert decode("ü".encode("utf-16"), None) == ("ü", "utf-16le")
    assert normalise("nope") is None


def test_selectors_in_trees():
    root = fragment("<div id=a><p class='x y'>1</p><p>2</p><span lang=en-GB>3</span></div><x><b><i><b><d></d></b></i></b></x>")
    count = lambda css: len(query(root, css))
    assert [count(c) for c in ("p", "*", "#a > p", ".y", "p + p", "p ~ span", "[lang|=en]", "p:nth-child(2)", ":not(p)", "p:contains('2')", "span:last-child")] == [2, 9, 2, 1, 1, 1, 1, 1, 7, 1, 1]
    # The nearest fit counts, and no other is tried.
    assert count("x b d") == 1 and count("x > b d") == 0
    for bad in ("", "p >", "p[", ":nope", ":not(", "..a", "a b,"[:-1] + " >"):
        with pytest.raises(SelectorError):
            parse(bad)
    assert [nth(x) for x in ("odd", "2n + 1", "-n+3", "n", "4", "x")] == [(2, 1), (2, 1), (-1, 3), (1, 0), (0, 4), None]


def test_node_api():
    root = fragment("<p>a</p><i>b</i>")
    p, i = root.children
    root.insert_before(Node("u", "html"), i)
    assert compact(root) == "<p>a</p><u></u><i>b</i>"
    assert root.replace_child(Node("s", "html"), p) is p and p.parent is None
    root.remove_child(i)
    with pytest.raises(ValueError):
        root.remove_child(i)
    assert compact(root) == "<s></s><u></u>"
    copy = fragment("<template><b>x</b></template>").clone(deep=True)
    assert compact(copy) == "<template><b>x</b></template>"


def test_references_without_semicolon():
    html = "<title>a&amp</title><p title='&lt &lt; &#60'>&ampb; &amp;&amp &#65;&#65 &notit;"
    closed, standard = Document(html, Options(open_references=False, collect_errors=True)), Document(html, Options(collect_errors=True))
    assert closed.text() == "a&amp &ampb; &&amp A&#65 &notit;" and standard.text() == "a& &b; && AA ¬it;"
    assert [query(d.root, "p")[0].attrs["title"] for d in (closed, standard)] == ["&lt < &#60", "< < <"]
    assert closed.errors == standard.errors
    assert [t.data for t in stream("<p>&amp", open_references=False) if t.kind == "text"] == ["&amp"]
