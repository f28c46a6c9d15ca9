"""What needs no parser, as Catalyst expressions: they stay in generated code, and filters on them can be pushed."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..engine.encoding import LABELS
from ..engine.policy import CSS_LOADERS, URL_ATTRS, SanitizationPolicy, UrlRule

_HTML_SPACE = r"[ \t\n\r\f]"
_ATTRS = "array<struct<name:string,value:string>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape_text(s: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_c(s), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(s: Column | str) -> Column:
    """A quoted attribute value: single quotes only where the value has double ones and no single ones."""
    amp = F.replace(_c(s), F.lit("&"), F.lit("&amp;"))
    single = _c(s).contains('"') & ~_c(s).contains("'")
    return F.when(single, F.concat(F.lit("'"), amp, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(amp, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def start_tag(name: Column | str, attrs: Column | str) -> Column:
    """A start tag from a name and an array of (name, value); empty values and those equal to their name print bare."""

    def one(a: Column) -> Column:
        bare = a["value"].isNull() | (a["value"] == "") | (F.lower(a["value"]) == F.lower(a["name"]))
        return F.when(bare, F.concat(F.lit(" "), a["name"])).otherwise(F.concat(F.lit(" "), a["name"], F.lit("="), escape_attr(a["value"])))

    return F.concat(F.lit("<"), _c(name), F.array_join(F.transform(_c(attrs), one), ""), F.lit(">"))


def collapse_whitespace(s: Column | str) -> Column:
    """Runs of HTML white space to one space; ends aren't trimmed."""
    return F.regexp_replace(_c(s), _HTML_SPACE + "+", " ")


def xml_text(s: Column | str) -> Column:
    last = "".join(f"\\x{{{plane << 16 | low:X}}}" for plane in range(17) for low in (0xFFFE, 0xFFFF))
    return F.regexp_replace(F.replace(_c(s), F.lit("\f"), F.lit(" ")), f"[\\x{{FDD0}}-\\x{{FDEF}}{last}]", "�")


def xml_comment(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), "-(?=-)", "- ")


def escape_markdown(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), r"([\\`*_\[\]])", r"\\$1")


def code_span(s: Column | str) -> Column:
    runs = F.transform(F.regexp_extract_all(_c(s), F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(_c(s).startswith("`") | _c(s).endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, _c(s), pad, fence)


def merge_tokens(value: Column | str, tokens: Collection[str]) -> Column:
    """A token list with tokens added, lower-cased, each once."""
    own = F.filter(F.split(F.lower(F.coalesce(_c(value), F.lit(""))), r"\s+"), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(own, F.array(*[F.lit(t.lower()) for t in sorted(tokens)]))), " ")


# ---- attributes


def set_attr(attrs: Column | str, name: str, value: Column | str | None) -> Column:
    v = F.lit(value) if value is None or isinstance(value, str) else value
    new = F.struct(F.lit(name).alias("name"), v.cast("string").alias("value"))
    there = F.exists(_c(attrs), lambda a: a["name"] == name)
    return F.when(there, F.transform(_c(attrs), lambda a: F.when(a["name"] == name, new).otherwise(a))).otherwise(F.concat(_c(attrs), F.array(new)))


def drop_attrs(attrs: Column | str, patterns: Collection[str]) -> Column:
    """Without the attributes whose lower-cased name fits a pattern of * and ?."""
    anchored = "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.lower()) for p in patterns)
    return F.filter(_c(attrs), lambda a: ~F.lower(a["name"]).rlike(f"^(?s:{anchored})$"))


def keep_attrs(tag: Column | str, attrs: Column | str, allowed: Mapping[str, Collection[str]]) -> Column:
    """The attributes allowed for '*' or for the tag, names lower-cased."""
    low = F.transform(_c(attrs), lambda a: F.struct(F.lower(a["name"]).alias("name"), a["value"].alias("value")))
    general = sorted({x.lower() for x in allowed.get("*", ())})
    names = F.array(*map(F.lit, general)) if general else F.expr("cast(array() as array<string>)")
    for t, extra in sorted(allowed.items()):
        if t != "*":
            names = F.when(_c(tag) == t.lower(), F.array(*map(F.lit, sorted({*general, *(x.lower() for x in extra)}) or [""]))).otherwise(names)
    return F.filter(low, lambda a: F.array_contains(names, a["name"]))


# ---- URLs and styles


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "")


def proxy_url(proxy: str, param: str, url: Column | str) -> Column:
    coded = F.url_encode(_c(url))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"{proxy}{'&' if '?' in proxy else '?'}{param}="), coded)


def url_allowed(url: Column | str, rule: UrlRule, default_relative: bool = True) -> Column:
    """The URL that a rule keeps, or null. A rule's own proxy applies; callbacks are for the worker."""
    value = F.trim(_c(url))
    seen = _bare(value)
    scheme = F.lower(F.regexp_extract(seen, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    resolved = F.concat(F.lit(f"{(rule.resolve_protocol_relative or '').lower()}:"), seen)

    def absolute(u: Column, s: Column) -> Column:
        ok = s.isin(*sorted(rule.allowed_schemes)) if rule.allowed_schemes else F.lit(False)
        if rule.allowed_hosts is None:
            return ok
        host = F.lower(F.regexp_extract(u, r"^[^:/?#]+:(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
        return ok & (host.isin(*sorted(rule.allowed_hosts)) if rule.allowed_hosts else F.lit(False))

    relative = rule.allow_relative if rule.allow_relative is not None else default_relative
    null = F.lit(None).cast("string")
    kept = (
        F.when(seen.isNull() | (seen == ""), null)
        .when(seen.startswith("#"), value if rule.allow_fragment else null)
        .when(seen.startswith("//"), F.when(absolute(resolved, F.lit((rule.resolve_protocol_relative or "").lower())), resolved) if rule.resolve_protocol_relative else null)
        .when(scheme != "", F.when(absolute(seen, scheme), value))
        .otherwise(value if relative else null)
    )
    mode = rule.handling or "allow"
    if mode == "strip":
        return null
    if mode == "proxy" and rule.proxy is not None:
        odd = seen.rlike(r"^[^/?#:]+:") & (scheme == "")
        return F.when(~odd, proxy_url(rule.proxy.url, rule.proxy.param, kept))
    return kept


def srcset_allowed(srcset: Column | str, rule: UrlRule, default_relative: bool = True) -> Column:
    """The candidates of a srcset if a rule keeps the URL of each, or null."""
    parts = F.filter(F.transform(F.split(_c(srcset), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    url = lambda x: url_allowed(F.regexp_extract(x, r"(?U)^(\S+)", 1), rule, default_relative)
    size = lambda x: F.regexp_replace(x, r"(?U)^\S+\s*", "")
    kept = F.transform(parts, lambda x: F.concat(url(x), F.when(size(x) == "", F.lit("")).otherwise(F.concat(F.lit(" "), size(x)))))
    return F.when((F.size(parts) > 0) & ~F.exists(kept, lambda x: x.isNull()), F.array_join(kept, ", "))


def loads_resource(value: Column | str) -> Column:
    """Whether a CSS value may fetch something."""
    bare = F.regexp_replace(_c(value), r"(?s)/\*.*?\*/", "")
    seen = F.lower(_bare(bare))
    out = _c(value).contains("\\") | bare.contains("/*")
    for x in CSS_LOADERS:
        out = out | seen.contains(x)
    return out


def clean_style(style: Column | str, allowed: Collection[str]) -> Column:
    """The declarations of an inline style that are allowed and fetch nothing; null if none is."""
    names = F.array(*[F.lit(a.lower()) for a in sorted(allowed)]) if allowed else F.expr("cast(array() as array<string>)")
    parts = F.transform(
        F.split(_c(style), ";"),
        lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("p"), F.trim(F.substring(d, F.length(F.substring_index(d, ":", 1)) + F.lit(2), F.length(d))).alias("v"), d.contains(":").alias("c")),
    )
    good = F.filter(parts, lambda x: x["c"] & (x["v"] != "") & x["p"].rlike("^[a-z0-9-]+$") & F.array_contains(names, x["p"]) & ~loads_resource(x["v"]))
    joined = F.array_join(F.transform(good, lambda x: F.concat(x["p"], F.lit(": "), x["v"])), "; ")
    return F.when(joined != "", joined)


def sanitized_attrs(tag: Column | str, attrs: Column | str, policy: SanitizationPolicy) -> Column:
    """The attributes that a policy keeps of an element, as one expression; url_filter callbacks are for the worker."""
    allowed = dict(policy.allowed_attributes)
    if policy.force_link_rel:
        allowed["a"] = {*allowed.get("a", ()), "rel"}
    kept = keep_attrs(tag, drop_attrs(attrs, ("on*", "srcdoc", "*:*")), allowed)

    def value(a: Column) -> Column:
        v = F.when(a["name"] == "style", clean_style(a["value"], policy.allowed_css_properties))
        urls = F.lit(None).cast("string")
        for (t, name), rule in sorted(policy.url_policy.allow_rules.items()):
            check = srcset_allowed if name == "srcset" else url_allowed
            urls = F.when((_c(tag) == t) & (a["name"] == name), check(a["value"], rule, policy.url_policy.default_allow_relative)).otherwise(urls)
        return v.when(a["name"].isin(*sorted(URL_ATTRS)), urls).otherwise(a["value"])

    checked = F.transform(kept, lambda a: F.struct(a["name"].alias("name"), value(a).alias("value"), a["name"].isin("style", *sorted(URL_ATTRS)).alias("guarded")))
    left = F.filter(checked, lambda a: ~a["guarded"] | a["value"].isNotNull())
    out = F.transform(left, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    if policy.force_link_rel:
        rel = F.get(F.filter(out, lambda a: a["name"] == "rel"), F.lit(0))["value"]
        out = F.when(_c(tag) == "a", set_attr(out, "rel", merge_tokens(rel, policy.force_link_rel))).otherwise(out)
    return out


def source_line(html: Column | str, line: Column | str) -> Column:
    """The line of the source that a diagnostic points at; null if there is none."""
    return F.get(F.split(_c(html), "\r\n?|\n"), _c(line) - 1)


def error_span(html: Column | str, line: Column | str, column: Column | str) -> Column:
    """What to highlight of that line, as 1-based (start, end): the tag around the place, whose '<' is looked for eleven
    characters back, up to and with the next '>' or the line's end. Null without a line."""
    text, at = source_line(html, line), _c(column)
    before = F.substring(text, F.greatest(at - 11, F.lit(1)), F.least(at - 1, F.lit(11)))
    back = F.locate("<", F.reverse(before))
    start = F.when((F.substring(text, at, F.lit(1)) == "<") | (back == 0), at).otherwise(at - back)
    close = F.locate(">", F.substring(text, at, F.length(text)))
    end = F.when(close > 0, at + close).otherwise(F.greatest(at, F.length(text) + 1))
    return F.when(text.isNotNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


# ---- encodings


def normalise_encoding(label: Column | str) -> Column:
    """The encoding that a transport label means; null if it is unknown."""
    pairs = [F.lit(x) for name, labels in LABELS.items() for label_ in labels.split() for x in (label_, name)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(_c(label))))


def declared_encoding(label: Column | str) -> Column:
    name = normalise_encoding(label)
    return F.when(name.startswith("utf-16"), F.lit("utf-8")).otherwise(name)


def sniff_bom(content: Column | str) -> Column:
    head = F.hex(F.substring(_c(content), 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")
