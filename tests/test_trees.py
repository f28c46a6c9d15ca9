"""Tree construction against dumps, in the format of conformance suites."""

import re
from pathlib import Path

import pytest

from domloom.engine.builder import Builder
from domloom.engine.dump import dump

CASES = Path(__file__).parent / "fixtures" / "trees.dat"


def cases():
    for block in CASES.read_text(encoding="utf-8").split("\n\n#data\n"):
        block = block.removeprefix("#data\n")
        data, _, rest = block.partition("\n#")
        parts = dict(p.partition("\n")[::2] for p in re.split(r"(?m)^#", rest) if p)
        yield pytest.param(data, parts.get("document-fragment", "").strip() or None, parts["document"].rstrip("\n"), id=data[:40])


@pytest.mark.parametrize(("data", "fragment", "expected"), list(cases()))
def test_tree(data, fragment, expected):
    context = None
    if fragment:
        ns, _, name = fragment.rpartition(" ")
        context = (name, ns or "html")
    assert dump(Builder(data, fragment=context).parse()) == expected


@pytest.mark.parametrize("html", ["", "<", "</", "<!", "<a", "<a b", "<a b=", "<a b='", "<!--", "<!doctype", "&", "&#", "<svg><![CDATA[x", "\0", "<table>" * 300 + "x", "<b>" * 2000 + "x", "<div>" * 5000])
def test_any_input_gives_a_document(html):
    root = Builder(html, collect_errors=True).parse()
    assert [n.name for n in root.children if n.is_element] == ["html"]
    assert dump(root)


def test_quirks():
    def mode(html):
        b = Builder(html)
        b.parse()
        return b.quirks

    assert mode("<!DOCTYPE html>") == "no-quirks"
    assert mode("<p>") == "quirks"
    assert mode('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "x">') == "limited-quirks"
    assert mode('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">') == "quirks"


def test_errors_have_codes_and_places():
    from domloom.engine.document import Document, Options

    doc = Document("<p>a</b>\n<div id=a id=b>&ampx", Options(collect_errors=True))
    codes = [e["code"] for e in doc.errors]
    assert codes[:3] == ["expected-doctype-but-got-start-tag", "unexpected-end-tag", "duplicate-attribute"]
    assert [(e["line"], e["column"]) for e in doc.errors if e["code"] == "duplicate-attribute"] == [(2, 11)]
    assert "missing-semicolon-after-character-reference" in codes
