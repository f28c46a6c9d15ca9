"""python -m domloom: one page, or a folder of them, to HTML, text or Markdown."""

from __future__ import annotations

import argparse
import sys

from .engine.document import Document, Options
from .engine.match import query
from .plans.selectors import SelectorError

VERSION = "0.1.0"


def render(doc: Document, css: str | None, form: str, first: bool) -> str | None:
    found = query(doc.root, css) if css else [doc.root]
    found = found[:1] if first else found
    if not found:
        return None
    make = {"html": doc.html, "text": doc.text, "markdown": doc.markdown}[form]
    return ("\n\n" if form == "markdown" else "\n").join(make(n) for n in found)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="domloom", description="Parse, clean, query and render HTML.")
    p.add_argument("path", nargs="?", help="a file, '-' for standard input; with --spark any path that Spark reads")
    p.add_argument("--output", help="a file, or with --spark a folder")
    p.add_argument("--selector")
    p.add_argument("--format", choices=("html", "text", "markdown"), default="html")
    p.add_argument("--unsafe", action="store_true")
    p.add_argument("--first", action="store_true")
    p.add_argument("--fragment", action="store_true")
    p.add_argument("--separator", default=" ")
    p.add_argument("--strip", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--spark", action="store_true", help="read path with Spark and write a rendering a page")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    if not a.path:
        p.print_usage(sys.stderr)
        return 1
    options = {"safe": not a.unsafe, "separator": a.separator, "strip": a.strip}
    fragment = ("div", "html") if a.fragment else None
    if a.spark:
        from pyspark.sql import SparkSession

        from .operators.parse import parse
        from .sources import read_html_files, write_rendered

        made = parse(read_html_files(SparkSession.builder.getOrCreate(), a.path), "content", outputs=(a.format,), fragment=fragment, **options)
        if a.output:
            write_rendered(made, a.format, a.output)
        else:
            made.select("path", a.format).show(truncate=False)
        return 0
    data = sys.stdin.buffer.read() if a.path == "-" else open(a.path, "rb").read()
    try:
        out = render(Document(data, Options(fragment=fragment, **options)), a.selector, a.format, a.first)
    except SelectorError as e:
        print(f"bad selector: {e}", file=sys.stderr)
        return 2
    if out is None:
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out + "\n")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
