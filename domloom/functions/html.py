"""Whole-document functions as vectorised UDFs, and their options. Each call parses once; to get several results of a page,
use operators.parse, which makes them all in one stage and says why a page fails. Here the result of a page that fails is null
(on_error='raise' to stop)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..engine.document import Document, Options
from ..engine.edits import compile_edits
from ..engine.links import LinkConfig, find_links
from ..engine.match import query
from ..engine.policy import SanitizationPolicy
from ..plans.selectors import parse as parse_selector


def _each(make: Callable[[Document], object], returns: str, options: dict, transforms: Sequence = ()):
    raising = options.pop("on_error", "null") == "raise"
    setup = replace(Options(**options), compiled=compile_edits(transforms))

    def one(h: object) -> object:
        try:
            return make(Document(None if pd.isna(h) is True else h, setup))
        except Exception:
            if raising:
                raise
            return None

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def _col(html: Column | str) -> Column:
    return F.col(html) if isinstance(html, str) else html


def html_to_text(html: Column | str, *, transforms: Sequence = (), **options) -> Column:
    """Visible text. Null is an empty document."""
    return _each(lambda d: d.text(), "string", options, transforms)(_col(html))


def html_to_html(html: Column | str, *, transforms: Sequence = (), **options) -> Column:
    return _each(lambda d: d.html(), "string", options, transforms)(_col(html))


def html_to_markdown(html: Column | str, *, transforms: Sequence = (), **options) -> Column:
    return _each(lambda d: d.markdown(), "string", options, transforms)(_col(html))


def html_sanitize(html: Column | str, policy: SanitizationPolicy | None = None, *, fragment: str | None = "div", **options) -> Column:
    """Clean compact HTML of a fragment (or, with fragment=None, of a document)."""
    options = {"pretty": False, "policy": policy, "fragment": (fragment, "html") if fragment else None, **options}
    return _each(lambda d: d.html(), "string", options)(_col(html))


def html_query(html: Column | str, css: str, **options) -> Column:
    """The texts of the matches, in document order."""
    parse_selector(css)
    return _each(lambda d: [d.text(n) for n in query(d.root, css)], "array<string>", options)(_col(html))


def html_links(text: Column | str, *, fuzzy_ip: bool = False, extra_tlds: Sequence[str] = ()) -> Column:
    """Links in plain text: an array of (start, end, text, href, kind), offsets in code points."""
    config = LinkConfig(fuzzy_ip, frozenset(t.lower() for t in extra_tlds))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x._asdict() for x in find_links(t, config)] if isinstance(t, str) else [])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<start:int,end:int,text:string,href:string,kind:string>>")(_col(text))
