"""Tokens of HTML text: the tokenization stage of the HTML standard, by pattern searches instead of one step a character."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from .references import decode

WS = "\t\n\f "
TAG_NAME = re.compile(r"[^\t\n\f />]+")
GAP = re.compile(r"[\t\n\f /]*")
BLANK = re.compile(r"[\t\n\f ]*")
ATTR_NAME = re.compile(r"=?[^\t\n\f />=]*")
UNQUOTED = re.compile(r"[^\t\n\f >]*")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCRIPT = re.compile(r"<!--|-->|</?script(?=[\t\n\f />])", re.IGNORECASE)
COMMENT_END = re.compile(r"--!?>|--!?\Z|-\Z")


def lower(s: str) -> str:
    return s.translate(UPPER) if not s.islower() else s


#: The last two code points of each plane, and a block of the first one, are no characters.
NONCHARACTERS = re.compile("[\ufdd0-\ufdef" + "".join(chr(plane << 16 | low) for plane in range(17) for low in (0xFFFE, 0xFFFF)) + "]")


def coerce_text(s: str) -> str:
    """XML-safe text: form feeds become spaces, non-characters U+FFFD."""
    return NONCHARACTERS.sub("\ufffd", s.replace("\f", " "))


def coerce_comment(s: str) -> str:
    while "--" in s:
        s = s.replace("--", "- -")
    return s


class Token:
    """kind: start, end, text, comment or doctype. pos and end are offsets into the normalised source."""

    __slots__ = ("attrs", "data", "end", "kind", "name", "pos", "self_closing", "doctype")

    def __init__(self, kind: str, pos: int, end: int, name: str = "", data: str = "", attrs: dict[str, str] | None = None, self_closing: bool = False, doctype=None):
        self.kind, self.pos, self.end, self.name, self.data = kind, pos, end, name, data
        self.attrs, self.self_closing, self.doctype = attrs if attrs is not None else {}, self_closing, doctype


class Lexer:
    """Yields tokens on demand. Between tokens its user sets `state` ('data', 'rcdata', 'rawtext', 'script', 'plaintext',
    'cdata'), `raw_tag`, and `foreign` (whether '<![CDATA[' opens a section)."""

    def __init__(self, html: str, *, discard_bom: bool = True, xml_coercion: bool = False, collect_errors: bool = False, open_references: bool = True):
        if discard_bom and html.startswith("﻿"):
            html = html[1:]
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        self.s, self.n, self.i = html, len(html), 0
        self.state, self.raw_tag, self.foreign = "data", "", False
        self.xml, self.open_references = xml_coercion, open_references
        self.errors: list[tuple[str, int]] | None = [] if collect_errors else None
        self._lines: list[int] | None = None

    def error(self, code: str, pos: int) -> None:
        if self.errors is not None:
            self.errors.append((code, min(pos, self.n)))

    def location(self, pos: int) -> tuple[int, int]:
        """1-based line and column."""
        if self._lines is None:
            self._lines = [-1, *(m.start() for m in re.finditer("\n", self.s))]
        line = bisect_right(self._lines, pos - 1)
        return line, pos - self._lines[line - 1]

    def __iter__(self) -> Iterator[Token]:
        while (t := self.next()) is not None:
            yield t

    def next(self) -> Token | None:
        while self.i < self.n:
            t = getattr(self, "_" + self.state)()
            if t is not None:
                return t
        return None

    # ---- text

    def _text(self, a: int, b: int, references: bool = True) -> Token | None:
        if a >= b:
            return None
        data = self.s[a:b]
        if self.errors is not None and "\0" in data:
            for m in re.finditer("\0", data):
                self.error("unexpected-null-character", a + m.start())
        if self.errors is not None and self.state == "data" and not data.isascii():
            for m in NONCHARACTERS.finditer(data):
                self.error("noncharacter-in-input-stream", a + m.start())
        if references and "&" in data:
            data = decode(data, errors=self.errors, base=a, open_too=self.open_references)
        return Token("text", a, b, data=coerce_text(data) if self.xml else data)

    def _plaintext(self) -> Token | None:
        a, self.i = self.i, self.n
        t = self._text(a, self.n, False)
        t.data = t.data.replace("\0", "�")
        return t

    def _cdata(self) -> Token | None:
        a = self.i
        b = self.s.find("]]>", a)
        self.state = "data"
        if b < 0:
            self.error("eof-in-cdata", self.n)
            self.i = self.n
            return self._text(a, self.n, False)
        self.i = b + 3
        return self._text(a, b, False)

    def _rcdata(self) -> Token | None:
        return self._until_end_tag(True)

    def _rawtext(self) -> Token | None:
        return self._until_end_tag(False)

    def _until_end_tag(self, references: bool) -> Token | None:
        a, tag = self.i, self.raw_tag
        m = re.compile(rf"</{re.escape(tag)}(?=[\t\n\f />])", re.IGNORECASE).search(self.s, a)
        b = m.start() if m else self.n
        return self._raw_to(a, b, references)

    def _raw_to(self, a: int, b: int, references: bool) -> Token | None:
        self.i = b
        if b > a:
            t = self._text(a, b, references)
            t.data = t.data.replace("\0", "�")
            return t
        self.state = "data"
        return self._tag(b, b + 2, "end")

    def _script(self) -> Token | None:
        a, at, level = self.i, self.i, 0
        while m := SCRIPT.search(self.s, at):
            found = m[0]
            at = m.end()
            if found == "<!--":
                if level == 0:
                    level = 1
                    at = m.start() + 2
            elif found == "-->":
                level = 0
            elif found[1] == "/":
                if level == 2:
                    level = 1
                else:
                    return self._raw_to(a, m.start(), False)
            elif level == 1:
                level = 2
        if level:
            self.error("eof-in-script-html-comment-like-text", self.n)
        return self._raw_to(a, self.n, False) if a < self.n else None

    # ---- markup

    def _data(self) -> Token | None:
        s, a = self.s, self.i
        j = a
        while True:
            j = s.find("<", j)
            if j < 0:
                self.i = self.n
                return self._text(a, self.n)
            c = s[j + 1 : j + 2]
            if c.isascii() and (c.isalpha() or c in ("!", "/", "?")) and c:
                break
            self.error("eof-before-tag-name" if not c else "invalid-first-character-of-tag-name", j + 1)
            j += 1
        if c == "/":
            d = s[j + 2 : j + 3]
            if not d:
                self.error("eof-before-tag-name", j + 2)
                self.i = self.n
                return self._text(a, self.n)
        if j > a:
            self.i = j
            return self._text(a, j)
        if c == "!":
            return self._declaration(j)
        if c == "?":
            self.error("unexpected-question-mark-instead-of-tag-name", j + 1)
            return self._bogus(j, j + 1)
        if c == "/":
            if d == ">":
                self.error("empty-end-tag", j + 2)
                self.i = j + 3
                return None
            if not (d.isascii() and d.isalpha()):
                self.error("invalid-first-character-of-tag-name", j + 2)
                return self._bogus(j, j + 2)
            return self._tag(j, j + 2, "end")
        return self._tag(j, j + 1, "start")

    def _tag(self, pos: int, i: int, kind: str) -> Token | None:
        """A tag whose name starts at i; None and the end of the input if it isn't closed."""
        s, n = self.s, self.n
        m = TAG_NAME.match(s, i)
        name = lower(m[0])
        if "\0" in name:
            self.error("unexpected-null-character", i)
            name = name.replace("\0", "�")
        i = m.end()
        if i >= self.n:
            self.error("eof-in-tag", self.n)
            self.i = self.n
            return Token("text", pos, self.n, data=s[pos:])
        attrs: dict[str, str] = {}
        closing = False
        while True:
            g = GAP.match(s, i)
            gap, i = g[0], g.end()
            if i >= n:
                self.error("eof-in-tag", n)
                self.i = n
                return None
            if s[i] == ">":
                closing = gap.endswith("/")
                if "/" in gap[:-1] or (gap and not closing and "/" in gap):
                    self.error("unexpected-character-after-solidus-in-tag", i)
                break
            if "/" in gap:
                self.error("unexpected-character-after-solidus-in-tag", i)
            elif not gap and attrs:
                self.error("missing-whitespace-between-attributes", i)
            m = ATTR_NAME.match(s, i)
            if s[i] == "=":
                self.error("unexpected-equals-sign-before-attribute-name", i)
            raw = m[0]
            if self.errors is not None and re.search("[\"'<]", raw):
                self.error("unexpected-character-in-attribute-name", i)
            key, at = lower(raw).replace("\0", "�"), i
            i = BLANK.match(s, m.end()).end()
            value = ""
            if s[i : i + 1] == "=":
                i = BLANK.match(s, i + 1).end()
                q = s[i : i + 1]
                if q in ('"', "'") and q:
                    j = s.find(q, i + 1)
                    if j < 0:
                        self.error("eof-in-tag", n)
                        self.i = n
                        return None
                    value, i = s[i + 1 : j], j + 1
                elif q == ">":
                    self.error("missing-attribute-value", i)
                else:
                    u = UNQUOTED.match(s, i)
                    value, i = u[0], u.end()
                    if self.errors is not None and re.search("[\"'<=`]", value):
                        self.error("unexpected-character-in-unquoted-attribute-value", i)
                if "&" in value:
                    value = decode(value, True, self.errors, i, self.open_references)
                if "\0" in value:
                    self.error("unexpected-null-character", i)
                    value = value.replace("\0", "�")
            else:
                i = m.end()
            if key in attrs:
                self.error("duplicate-attribute", at)
            else:
                attrs[key] = value
        self.i = i + 1
        if kind == "end":
            attrs, closing = {}, False
        return Token(kind, pos, i + 1, name, attrs=attrs, self_closing=closing)

    def _bogus(self, pos: int, i: int) -> Token:
        j = self.s.find(">", i)
        j, self.i = (self.n, self.n) if j < 0 else (j, j + 1)
        return self._comment(pos, self.s[i:j])

    def _comment(self, pos: int, data: str) -> Token:
        if "\0" in data:
            self.error("unexpected-null-character", pos)
            data = data.replace("\0", "�")
        return Token("comment", pos, self.i, data=coerce_comment(data) if self.xml else data)

    def _declaration(self, pos: int) -> Token | None:
        s, i = self.s, pos + 2
        if s.startswith("--", i):
            i += 2
            early = re.compile("-?>").match(s, i)
            if early:
                self.error("abrupt-closing-of-empty-comment", i)
                self.i = early.end()
                return self._comment(pos, "")
            m = COMMENT_END.search(s, i)
            if m is None or not m[0].endswith(">"):
                self.error("eof-in-comment", self.n)
                self.i = self.n
                return self._comment(pos, s[i : m.start() if m else self.n])
            if m[0] == "--!>":
                self.error("incorrectly-closed-comment", m.start())
            self.i = m.end()
            return self._comment(pos, s[i : m.start()])
        if s[i : i + 7].lower() == "doctype":
            return self._doctype(pos, i + 7)
        if s.startswith("[CDATA[", i):
            if self.foreign:
                self.i, self.state = i + 7, "cdata"
                return None
            self.error("cdata-in-html-content", i)
            return self._bogus(pos, i)
        self.error("incorrectly-opened-comment", i)
        return self._bogus(pos, i)

    def _doctype(self, pos: int, i: int) -> Token:
        s, n = self.s, self.n
        name = public = system = None
        quirks = False

        def done(i: int) -> Token:
            self.i = i
            return Token("doctype", pos, i, name or "", doctype=(name, public, system, quirks))

        def finish(i: int) -> Token:
            j = s.find(">", i)
            return done(n if j < 0 else j + 1)

        def eof() -> Token:
            nonlocal quirks
            quirks = True
            self.error("eof-in-doctype", n)
            return done(n)

        j = BLANK.match(s, i).end()
        if j == i and s[i : i + 1] not in ("", ">"):
            self.error("missing-whitespace-before-doctype-name", i)
        i = j
        if i >= n:
            return eof()
        if s[i] == ">":
            self.error("expected-doctype-name-but-got-right-bracket", i)
            quirks = True
            return done(i + 1)
        m = re.compile(r"[^\t\n\f >]+").match(s, i)
        for z in re.finditer("\0", m[0]):
            self.error("unexpected-null-character", m.start() + z.start())
        name = lower(m[0]).replace("\0", "�")
        i = BLANK.match(s, m.end()).end()
        if i >= n:
            return eof()
        if s[i] == ">":
            return done(i + 1)
        word = s[i : i + 6].upper()
        if word not in ("PUBLIC", "SYSTEM"):
            self.error("missing-whitespace-after-doctype-name", i)
            quirks = True
            return finish(i)
        i += 6
        place = f"{word.lower()} keyword"
        while True:
            j = BLANK.match(s, i).end()
            at_end, at_bracket, at_quote, otherwise, after = _IDENTIFIERS[place, j > i]
            c = s[j : j + 1]
            code = at_end if not c else at_bracket if c == ">" else at_quote if c in "\"'" else otherwise
            if code:
                self.error(code, j)
            if c and c in "\"'" and after:
                k = re.compile(f"[{c}>]").search(s, j + 1)
                value = s[j + 1 : k.start() if k else n]
                for m in re.finditer("\0", value):
                    self.error("unexpected-null-character", j + 1 + m.start())
                value = value.replace("\0", "\ufffd")
                if after == "public":
                    public = value
                else:
                    system = value
                if k is None or k[0] == ">":
                    quirks = True
                    self.error(f"eof-in-doctype-{after}-identifier" if k is None else f"abrupt-doctype-{after}-identifier", k.start() if k else n)
                    return done(k.end() if k else n)
                i, place = k.end(), after
                continue
            # Only text after a whole system identifier leaves the document out of quirks mode.
            quirks = quirks or (code is not None and (place != "system" or not c))
            return done(n) if not c else done(j + 1) if c == ">" else finish(j)


#: What follows in a doctype, by what went before and whether white space stands between: the codes at the end of the input, at
#: '>', at a quote and at anything else (None: no error), and the identifier that a quote opens. Codes are fixed values.
_IDENTIFIERS = {
    ("public keyword", False): (
        "missing-quote-before-doctype-public-identifier", "missing-doctype-public-identifier", "missing-whitespace-before-doctype-public-identifier",
        "unexpected-character-after-doctype-public-keyword", "public",
    ),
    ("public keyword", True): ("missing-doctype-public-identifier", "missing-doctype-public-identifier", None, "missing-quote-before-doctype-public-identifier", "public"),
    ("public", False): (
        "missing-whitespace-between-doctype-public-and-system-identifiers", None, "missing-whitespace-between-doctype-public-and-system-identifiers",
        "unexpected-character-after-doctype-public-identifier", "system",
    ),
    ("public", True): ("missing-quote-before-doctype-system-identifier", None, None, "missing-quote-before-doctype-system-identifier", "system"),
    ("system keyword", False): (
        "missing-quote-before-doctype-system-identifier", "missing-doctype-system-identifier", "missing-whitespace-after-doctype-public-identifier",
        "unexpected-character-after-doctype-system-keyword", "system",
    ),
    ("system keyword", True): ("missing-doctype-system-identifier", "missing-doctype-system-identifier", None, "missing-quote-before-doctype-system-identifier", "system"),
    ("system", False): ("eof-in-doctype", None, *["unexpected-character-after-doctype-system-identifier"] * 2, None),
    ("system", True): ("eof-in-doctype", None, *["unexpected-character-after-doctype-system-identifier"] * 2, None),
}


#: Elements whose content isn't markup, in a stream of tokens without a tree.
_STREAM_STATES = {"title": "rcdata", "textarea": "rcdata", "script": "script", "plaintext": "plaintext"} | dict.fromkeys(("style", "xmp", "iframe", "noembed", "noframes"), "rawtext")


def stream(html: str, state: str = "data", raw_tag: str = "", open_references: bool = True) -> Iterator[Token]:
    """Tokens without a tree: elements are all taken as HTML, so CDATA sections are comments. The lexer may begin in another
    state than data; raw_tag is the element whose end tag ends it."""
    lexer = Lexer(html, discard_bom=False, open_references=open_references)
    lexer.state, lexer.raw_tag = state, raw_tag
    for t in lexer:
        if t.kind == "start" and (state := _STREAM_STATES.get(t.name)):
            lexer.state, lexer.raw_tag = state, t.name
        if t.kind == "text":
            t.data = t.data.replace("\0", "")
            if not t.data:
                continue
        yield t
