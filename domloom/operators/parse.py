"""Parsing a column of HTML: one stateless Arrow batch stage that makes just the outputs asked for."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..engine.document import NODE_COLUMNS, Document, Options
from ..engine.edits import compile_edits
from ..engine.lexer import stream

ATTR = "array<struct<name:string,value:string>>"
DOCTYPE = "struct<name:string,public_id:string,system_id:string,force_quirks:boolean>"
_KIND = {"attrs": ATTR, "doctype": DOCTYPE} | dict.fromkeys(("name", "name_lc", "namespace", "data", "parent_name"), "string") | dict.fromkeys(("is_empty", "end_tag_present", "self_closing"), "boolean")
NODE_FIELDS = {c: _KIND.get(c, "int") for c in NODE_COLUMNS}
NODES = "array<struct<" + ",".join(f"{c}:{t}" for c, t in NODE_FIELDS.items()) + ">>"
ERRORS = "array<struct<category:string,code:string,line:int,column:int,message:string>>"
TOKENS = f"array<struct<seq:int,kind:string,name:string,attrs:{ATTR},data:string,public_id:string,system_id:string,self_closing:boolean>>"

REPORTS = "array<struct<message:string,name:string,line:int,column:int>>"

#: What parse can make, and its type.
OUTPUTS = {"text": "string", "markdown": "string", "html": "string", "dump": "string", "encoding": "string", "quirks": "string", "nodes": NODES, "errors": ERRORS, "reports": REPORTS, "tokens": TOKENS}
#: Rows in a batch that the worker holds at once; node tables are many times the size of their pages.
SLICE = 64
NODE_ROWS = 20_000


def _tokens(source: str, state: str = "data", raw_tag: str = "", open_references: bool = True) -> list[dict]:
    out = []
    for i, t in enumerate(stream(source, state, raw_tag, open_references)):
        name, public, system, _ = t.doctype or (t.name or None, None, None, False)
        out.append({"seq": i, "kind": t.kind, "name": name, "attrs": [{"name": k, "value": v} for k, v in t.attrs.items()], "data": t.data if t.kind in ("text", "comment") else None, "public_id": public, "system_id": system, "self_closing": t.self_closing})
    return out


def _rows(columns: dict[str, list]) -> list[dict]:
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


def _make(output: str, doc: Document, source) -> object:
    if output == "nodes":
        return _rows(doc.nodes())
    if output == "tokens":
        return _tokens(doc.lexer.s, doc.options.initial_state, doc.options.last_start_tag, doc.options.open_references)
    value = getattr(doc, output)
    return value() if callable(value) else value


def parse(
    df: DataFrame, html_col: str = "html", *, outputs: Sequence[str] = ("text",), encoding_col: str | None = None, keep: Sequence[str] | None = None,
    fragment: str | tuple[str, str | None] | None = None, transforms: Sequence = (), on_error: str = "column", **options,
) -> DataFrame:
    """df with a column for each output, made by one parse of html_col (text, or bytes with an optional transport label).

    outputs: any of OUTPUTS. keep: the columns of df to carry (all but html_col without it); only those are read and
    shipped. options are fields of engine.document.Options (safe, policy, pretty, strict, ...). Selectors and edits are
    compiled here, before any job. A row that fails has null outputs and its reason in parse_failure; on_error='raise'
    fails the job instead. Null HTML is an empty document.

    A filter on df belongs before this call: nothing is pushed below a Python stage.
    """
    wanted = [o for o in outputs]
    if unknown := [o for o in wanted if o not in OUTPUTS]:
        raise ValueError(f"unknown outputs {unknown}")
    names = list(keep) if keep is not None else [c for c in df.columns if c != html_col]
    names = [c for c in names if c not in wanted and c != "parse_failure"]
    setup = Options(**options)
    compiled = compile_edits(transforms)
    setup = replace(
        setup, compiled=compiled, fragment=(fragment, "html") if isinstance(fragment, str) else fragment,
        collect_errors=setup.collect_errors or "errors" in wanted, locations=setup.locations or "errors" in wanted,
    )
    source, label = _inputs(df, html_col, encoding_col)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"{o} {OUTPUTS[o]}" for o in wanted] + ["parse_failure string"])

    types = {o: _arrow(OUTPUTS[o]) for o in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                made: dict[str, list] = {o: [] for o in wanted}
                failures: list[str | None] = []
                for html, transport in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                    try:
                        doc = Document(html, setup, transport)
                        row = [_make(o, doc, html) for o in sorted(wanted, key=lambda o: o == "errors")]
                        row = dict(zip(sorted(wanted, key=lambda o: o == "errors"), row, strict=True))
                        failures.append(None)
                    except Exception as e:
                        if on_error == "raise":
                            raise
                        row = dict.fromkeys(wanted)
                        failures.append(f"{type(e).__name__}: {e}")
                    for o in wanted:
                        made[o].append(row[o])
                columns = [*part.columns[:k], *(pa.array(made[o], types[o]) for o in wanted), pa.array(failures, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *wanted, "parse_failure"])

    return df.select(*[F.col(f"`{c}`") for c in names], source.alias(_free("html", names)), label.alias(_free("label", names))).mapInArrow(run, schema)


def _inputs(df: DataFrame, html_col: str, encoding_col: str | None) -> tuple[Column, Column]:
    """The HTML as text or bytes, and the transport's label."""
    binary = isinstance(df.schema[html_col].dataType, BinaryType)
    source = F.col(f"`{html_col}`") if binary else F.col(f"`{html_col}`").cast("string")
    return source, F.col(f"`{encoding_col}`").cast("string") if encoding_col else F.lit(None).cast("string")


def _free(name: str, taken: Sequence[str]) -> str:
    """A column name that isn't taken; Spark tells names apart without regard to case."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def _exploded(df: DataFrame, id_col: str, html_col: str, output: str, options: dict, *, place: str | None = None) -> DataFrame:
    """The rows of an array output; a document that failed has one row, with nulls and the reason."""
    made = parse(df, html_col, outputs=(output,), keep=(id_col,), **options)
    rows = F.when(F.col("parse_failure").isNotNull(), F.array(F.lit(None).cast(made.schema[output].dataType.elementType))).otherwise(F.col(output))
    names = [place] if place else []
    return made.select(id_col, "parse_failure", (F.posexplode if place else F.explode)(rows).alias(*names, "r")).select(id_col, *names, "r.*", "parse_failure")


def nodes(df: DataFrame, id_col: str = "page_id", html_col: str = "html", *, encoding_col: str | None = None, fragment: str | tuple[str, str | None] | None = None, transforms: Sequence = (), on_error: str = "column", **options) -> DataFrame:
    """A row for each node of each document, in the layout of NODE_FIELDS. An ancestor a of d, in the same tree_id, has
    a.node_id < d.node_id and d.post < a.post. Rows leave the worker as flat columns, some thousands at a time. A document
    that fails has one row, with nulls and the reason in parse_failure (on_error='raise' to stop)."""
    setup = replace(Options(**options), compiled=compile_edits(transforms), fragment=(fragment, "html") if isinstance(fragment, str) else fragment)
    source, label = _inputs(df, html_col, encoding_col)
    id_type = df.schema[id_col].dataType.simpleString()
    types = {c: _arrow(t) for c, t in NODE_FIELDS.items()}

    def flat(ids: pa.Array, take: list[int], columns: dict[str, list], failures: list[str | None]) -> pa.RecordBatch:
        made = []
        for c, values in columns.items():
            if c == "attrs":
                offsets = [0, *accumulate(len(v or ()) for v in values)]
                pairs = [(a["name"], a["value"]) for v in values for a in v or ()]
                inner = pa.StructArray.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], ["name", "value"])
                made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner).cast(types[c]))
            else:
                made.append(pa.array(values, types[c]))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *made, pa.array(failures, pa.string())], ["id", *columns, "parse_failure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, columns, failures = [], {c: [] for c in NODE_COLUMNS}, []
            for i in range(len(batch)):
                failure = None
                try:
                    rows = Document(batch.column(1)[i].as_py(), setup, batch.column(2)[i].as_py()).nodes()
                except Exception as e:
                    if on_error == "raise":
                        raise
                    rows, failure = dict.fromkeys(NODE_COLUMNS, [None]), f"{type(e).__name__}: {e}"
                n = len(rows["node_id"])
                take += [i] * n
                failures += [failure] * n
                for c, values in rows.items():
                    columns[c] += values
                if len(take) >= NODE_ROWS:
                    yield flat(batch.column(0), take, columns, failures)
                    take, columns, failures = [], {c: [] for c in NODE_COLUMNS}, []
            if take:
                yield flat(batch.column(0), take, columns, failures)

    made = df.select(F.col(f"`{id_col}`").alias("id"), source.alias("html"), label.alias("label")).mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} {t}" for c, t in NODE_FIELDS.items()) + ", parse_failure string")
    return made.withColumnRenamed("id", id_col)


def tokens(df: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """A row for each lexical token, without a tree. initial_state and last_start_tag say where the lexer begins."""
    return _exploded(df, id_col, html_col, "tokens", options)


def errors(df: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """A row for each diagnostic, in order of line and column."""
    return _exploded(df, id_col, html_col, "errors", options, place="seq")
