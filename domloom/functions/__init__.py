"""Column functions over HTML and over nodes tables."""

from .columns import (
    clean_style,
    code_span,
    collapse_whitespace,
    declared_encoding,
    drop_attrs,
    escape_attr,
    escape_markdown,
    error_span,
    escape_text,
    keep_attrs,
    loads_resource,
    merge_tokens,
    normalise_encoding,
    proxy_url,
    sanitized_attrs,
    set_attr,
    sniff_bom,
    source_line,
    srcset_allowed,
    start_tag,
    url_allowed,
    xml_comment,
    xml_text,
)
from .html import html_links, html_query, html_sanitize, html_to_html, html_to_markdown, html_to_text
from .udtf import register

__all__ = [
    "clean_style", "code_span", "collapse_whitespace", "declared_encoding", "drop_attrs", "error_span", "escape_attr", "escape_markdown", "escape_text",
    "html_links", "html_query", "html_sanitize", "html_to_html", "html_to_markdown", "html_to_text", "keep_attrs", "loads_resource",
    "merge_tokens", "normalise_encoding", "proxy_url", "register", "sanitized_attrs", "set_attr", "sniff_bom", "source_line", "srcset_allowed", "start_tag", "url_allowed", "xml_comment", "xml_text",
]
