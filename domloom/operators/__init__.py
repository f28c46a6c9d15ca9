"""Operators over tables of HTML and of nodes."""

from .edit import drop_nodes, empty_nodes, text_by_document, unwrap_nodes
from .parse import errors, nodes, parse, tokens
from .query import query_html
from .select import count_css, matches_css, select_css

__all__ = [
    "count_css", "drop_nodes", "empty_nodes", "errors", "matches_css", "nodes", "parse", "query_html", "select_css", "text_by_document", "tokens", "unwrap_nodes",
]
