"""CSS queries in the parse stage: no node table, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine.document import Document, Options
from ..engine.match import query
from ..plans.selectors import parse as parse_selector

FOUND = "ord int, name string, attrs map<string,string>, text string, html string, parse_failure string"
_TYPES = (pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string())
#: Matches, and characters of their text and markup, that a worker holds before it hands them on.
ROWS, CHARACTERS = 10_000, 1 << 22


def query_html(df: DataFrame, css: str, id_col: str = "page_id", html_col: str = "html", *, first: bool = False, with_html: bool = False, on_error: str = "column", **options) -> DataFrame:
    """A row for each match: id_col, ord, name, attrs, text (and html if with_html), in document order; the first alone if
    first. For one pass over raw pages; use select_css where a nodes table is kept. A page that fails has one row, with nulls
    and the reason in parse_failure (on_error='raise' to stop). Pages are taken one by one, matches handed on some thousands
    at a time."""
    parse_selector(css)
    setup = Options(**options)
    id_type = df.schema[id_col].dataType.simpleString()

    def found(html: str | None) -> Iterator[tuple]:
        doc = Document(html, setup)
        nodes = query(doc.root, css)
        for k, n in enumerate(nodes[:1] if first else nodes):
            yield k, n.name, list((n.attrs or {}).items()), doc.text(n), doc.html(n) if with_html else None, None

    def handed(ids: pa.Array, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True))], ["id", "ord", "name", "attrs", "text", "html", "parse_failure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows, size = [], [], 0
            for i in range(len(batch)):
                try:
                    for row in found(batch.column(1)[i].as_py()):
                        take.append(i)
                        rows.append(row)
                        size += len(row[3]) + len(row[4] or "")
                        if len(rows) >= ROWS or size >= CHARACTERS:
                            yield handed(batch.column(0), take, rows)
                            take, rows, size = [], [], 0
                except Exception as e:
                    if on_error == "raise":
                        raise
                    take.append(i)
                    rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield handed(batch.column(0), take, rows)

    out = df.select(F.col(id_col).alias("id"), F.col(html_col)).mapInArrow(run, f"id {id_type}, {FOUND}").withColumnRenamed("id", id_col)
    return out if with_html else out.drop("html")
