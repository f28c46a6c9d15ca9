"""Bytes to text: transport label, byte order mark, meta declaration, windows-1252."""

from __future__ import annotations

import codecs
import re

#: Labels of each encoding. Fixed values.
LABELS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8",
    "windows-1252": "ascii us-ascii iso-8859-1 iso8859-1 latin1 latin-1 l1 cp1252 windows-1252 x-cp1252 utf-7 utf7 x-utf-7",
    "iso-8859-2": "iso-8859-2 iso8859-2 latin2 latin-2 l2",
    "euc-jp": "euc-jp eucjp x-euc-jp",
    "utf-16": "utf-16 utf16",
    "utf-16le": "utf-16le utf16le",
    "utf-16be": "utf-16be utf16be",
}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
PRESCAN, PRESCAN_TOTAL = 1024, 65536

_ATTR = re.compile(rb"""[\t\n\f\r />]*([^\t\n\f\r />=]+)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"']+)))?""")
_CHARSET = re.compile(rb"""charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r ;"']+))""", re.IGNORECASE)


def normalise(label: str | bytes | None) -> str | None:
    if label is None:
        return None
    if isinstance(label, bytes):
        label = label.decode("ascii", "ignore")
    return _BY_LABEL.get(label.strip().lower())


def declared(label: str | bytes | None) -> str | None:
    """An encoding that a document names in itself: it can't be UTF-16, whatever it says."""
    name = normalise(label)
    return "utf-8" if name is not None and name.startswith("utf-16") else name


def charset_of(content: bytes) -> bytes | None:
    m = _CHARSET.search(content)
    return next((g for g in m.groups() if g is not None), None) if m else None


def prescan(data: bytes) -> str | None:
    """The encoding of a meta element near the start; comments don't count to the limit of PRESCAN bytes."""
    i, spent, end = 0, 0, min(len(data), PRESCAN_TOTAL)
    while i < end and spent < PRESCAN:
        j = data.find(b"<", i, end)
        if j < 0:
            return None
        spent += j - i
        if spent >= PRESCAN:
            return None
        i = j
        if data.startswith(b"<!--", i):
            j = data.find(b"-->", i + 4 - 2, end)
            if j < 0:
                return None
            i = j + 3
            continue
        tag = re.compile(rb"<[/]?([A-Za-z][^\t\n\f\r />]*)").match(data, i)
        if not tag:
            j = data.find(b">", i, end) if data[i + 1 : i + 2] in (b"!", b"/", b"?") else i
            if j < 0:
                return None
            spent += j + 1 - i
            i = j + 1
            continue
        at, attrs = tag.end(), {}
        while at < end and not re.compile(rb"[\t\n\f\r /]*>").match(data, at):
            m = _ATTR.match(data, at)
            if not m or m.end() == at:
                return None
            attrs.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), b""))
            at = m.end()
        if at >= end:
            return None
        at = data.find(b">", at) + 1
        if tag[1].lower() == b"meta" and data[i + 1 : i + 2] != b"/":
            if b"charset" in attrs and (name := declared(attrs[b"charset"])):
                return name
            if attrs.get(b"http-equiv", b"").lower() == b"content-type" and (name := declared(charset_of(attrs.get(b"content", b"")))):
                return name
        spent += at - i
        i = at
    return None


def sniff(data: bytes, transport: str | None = None) -> tuple[str, int]:
    """The encoding's name, and the length of a byte order mark to skip."""
    mark = next(((name, len(bom)) for bom, name in BOMS if data.startswith(bom)), None)
    if name := normalise(transport):
        return name, mark[1] if mark and mark[0] == name else 0
    return mark or (prescan(data) or "windows-1252", 0)


def decode(data: bytes, transport: str | None = None) -> tuple[str, str]:
    """Text and the name of its encoding. What doesn't decode becomes U+FFFD; the five unassigned bytes of windows-1252 are
    the control characters of their numbers, as the encoding standard has them, and never an error."""
    name, skip = sniff(data, transport)
    if name == "windows-1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if re.search(rb"[\x81\x8d\x8f\x90\x9d]", data) else data.decode("cp1252"), name
    return data[skip:].decode("utf-16le" if name == "utf-16" and not skip else name.replace("utf-16le", "utf-16-le").replace("utf-16be", "utf-16-be"), "replace"), name
