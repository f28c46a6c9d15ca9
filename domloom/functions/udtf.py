"""Table functions for SQL: FROM pages, LATERAL html_nodes(html)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..engine.document import Document, Options
from ..engine.links import find_links
from ..operators.parse import NODE_FIELDS, _rows, _tokens


def _guarded(rows: Callable[[], Iterable[tuple]], width: int) -> Iterator[tuple]:
    """The rows of a document, each with a null reason; one row of nulls and the reason if it fails."""
    try:
        for row in rows():
            yield *row, None
    except Exception as e:
        yield *[None] * width, f"{type(e).__name__}: {e}"


def _values(rows: list[dict]) -> Iterator[tuple]:
    return (tuple(row.values()) for row in rows)


@udtf(returnType=", ".join(f"{c} {t}" for c, t in NODE_FIELDS.items()) + ", parse_failure string", useArrow=True)
class HtmlNodes:
    def eval(self, html: str):
        yield from _guarded(lambda: _values(_rows(Document(html, Options()).nodes())), len(NODE_FIELDS))


@udtf(returnType="seq int, kind string, name string, attrs array<struct<name:string,value:string>>, data string, public_id string, system_id string, self_closing boolean, parse_failure string", useArrow=True)
class HtmlTokens:
    def eval(self, html: str):
        yield from _guarded(lambda: _values(_tokens(html or "")), 8)


@udtf(returnType="category string, code string, line int, column int, message string, parse_failure string", useArrow=True)
class HtmlErrors:
    def eval(self, html: str):
        yield from _guarded(lambda: _values(Document(html, Options(collect_errors=True, locations=True)).errors), 5)


@udtf(returnType="start int, end int, text string, href string, kind string", useArrow=True)
class HtmlLinks:
    def eval(self, text: str):
        yield from (tuple(x) for x in find_links(text))


def register(spark: SparkSession) -> None:
    """Table functions html_nodes, html_tokens, html_errors and html_links, and scalar html_text, html_markdown, html_clean."""
    for name, f in (("html_nodes", HtmlNodes), ("html_tokens", HtmlTokens), ("html_errors", HtmlErrors), ("html_links", HtmlLinks)):
        spark.udtf.register(name, f)
    from .html import _each

    for name, f in (("html_text", lambda d: d.text()), ("html_markdown", lambda d: d.markdown()), ("html_clean", lambda d: d.html())):
        spark.udf.register(name, _each(f, "string", {}))
