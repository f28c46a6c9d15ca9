"""SentencePiece encoding as the shortest path through a weighted finite-state transducer, and decoding.

The transducer is a composition of three machines, each compiled from the model file. The normaliser rewrites characters: at
each place the longest rule of the model's own compiled map applies, spaces become U+2581 and a dummy prefix is put before the
text. The piece machine is a trie whose final states emit a piece's id; a character that no piece covers has an arc that emits
its bytes' ids. The history machine weighs a piece by the one before it. In a unigram model a piece costs its negative log
probability whatever stands before it. In a merge (BPE) model a pair of pieces costs nothing if merging the pair's text gives
just that pair, and infinity otherwise: exactly one path over any text has a finite weight, and it is the one that the merges
give. The shortest path is searched in the tropical semiring (min, +) over the lattice, which is composed as it is searched:
place by place where arcs have costs of their own, and best first where all finite costs are equal, so that any path that
arrives is shortest.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import BYTE, NORMAL, UNKNOWN, USER, _fields, load_model

SPACE = "▁"
CACHE = 300_000
PAIRS = 400_000


class Rules:
    """The normaliser's compiled map: a double array over the bytes of what is rewritten, and the strings it becomes."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.strings = compiled[4 + size :]
        self.begins: dict[str, bool] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """How many bytes the longest rule from a place takes, and what it makes of them."""
        units, found = self.units, None
        place = self._offset(units[0])
        for n in range(at, len(raw)):
            place ^= raw[n]
            unit = units[place] if place < len(units) else 0
            if unit & 0x800000FF != raw[n]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = n + 1 - at, start
        if found is None:
            return None
        n, start = found
        return n, self.strings[start : self.strings.index(0, start)].decode()

    def _may_begin(self, c: str) -> bool:
        got = self.begins.get(c)
        if got is None:
            place, got = self._offset(self.units[0]), True
            for b in c.encode():
                place ^= b
                unit = self.units[place] if place < len(self.units) else 0
                if unit & 0x800000FF != b:
                    got = False
                    break
                place ^= self._offset(unit)
            self.begins[c] = got
        return got

    def pieces(self, text: str) -> Iterator[str]:
        """What each stretch of the text becomes: by the longest rule, or as it is."""
        i, n = 0, len(text)
        while i < n:
            j = i
            while j < n and not self._may_begin(text[j]):
                j += 1
            if j > i:
                yield text[i:j]
                i = j
                continue
            got = self.longest(text[i : i + 64].encode(), 0)
            if got is None:
                yield text[i]
                i += 1
            else:
                taken, made = got
                yield made
                i += len(text[i : i + 64].encode()[:taken].decode())


class Codec:
    """One model file compiled into a transducer. Encoding and decoding are deterministic; caches are of bounded size."""

    def __init__(self, path: str):
        pieces, spec = load_model(path)
        with open(path, "rb") as f:
            trainer = next((dict(_fields(v)) for n, v in _fields(f.read()) if n == 2), {})
        self.merges = trainer.get(3, 1) == 2
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        usable = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        self.ids = {p: i for p, (i, _) in usable.items()}
        self.score = {p: s for p, (_, s) in usable.items()}
        #: In single precision, as the library adds them up: ties fall the same way.
        self.costs = {i: np.float32(-s) for i, s in usable.values()}
        #: An arc that no piece covers costs ten more than the dearest piece.
        self.dearest = max(self.costs.values(), default=np.float32(0)) + np.float32(10)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What an arc emits, by its number: a piece its id, a character that no piece covers its bytes' ids or the unknown one.
        self.emits: dict[int, tuple[int, ...]] = {}
        if not spec.get(5, 1) or trainer.get(24, 0) or trainer.get(3, 1) not in (1, 2) or any(k == USER for k in self.kind):
            raise ValueError("only unigram and merge models that mark words in front and have no user-defined pieces")
        self.rules = Rules(spec.get(2, b""))
        if not self.rules and spec.get(1, b"identity") != b"identity":
            raise ValueError(f"the model file has no rules for its normaliser {spec[1].decode()!r}")
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        # Texts fall apart where no piece can cross: before a mark that follows other text, around characters that are in no
        # longer piece, and after a word before a sign, if pieces have no sign after a letter.
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.inner_mark = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.splits = self.prefix and not (self.squeeze or self.rules or self.inner_mark)
        alone = {c for c in map(chr, range(1, 128)) if c not in joined and not c.isalpha()}
        signs = self._signs() - alone
        one, two = (f"{''.join(map(re.escape, sorted(x)))}" for x in (alone, signs))
        cuts = [f"{SPACE}*" + (f"[{two}]*" if two else "") + f"[^{SPACE}{one}{two}]+", *([f"{SPACE}*[{two}]+"] if two else []), f"{SPACE}+", *([f"[{one}]"] if one else [])]
        self.cut = re.compile("(?s)" + ("|".join(cuts) if not self.inner_mark else ".+"))
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        #: Piece ids by text, and -1 for texts that only begin a piece: a walk from a place goes on while it finds anything.
        reached = {p: i for p, i in self.ids.items() if not self.merges or self._merge(p) == [p]}
        self.steps = {p[:n]: -1 for p in reached for n in range(1, len(p))} | reached
        plain = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([self.byte_of[i]]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.plain = pa.array(plain, pa.large_binary())

    def _signs(self) -> set[str]:
        """Characters that no piece has after a letter or digit: the largest such set that holds only signs."""
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                before.setdefault(y, set()).add(x)
        signs = {c for p in self.ids for c in p if not c.isalnum() and c != SPACE and unicodedata.category(c)[0] in "PS"}
        while bad := {c for c in signs if not before.get(c, set()) <= signs | {SPACE}}:
            signs -= bad
        return signs

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.rules:
            text = "".join(self.rules.pieces(text))
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def _merge(self, text: str) -> list[str]:
        """Merges by score, the leftmost of equals first; the definition that pairs are weighed by."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _symbol(self, number: int) -> str:
        """The text of a piece, or of a character that is none (numbered after the pieces)."""
        return self.text[number] if number < len(self.text) else chr(number - len(self.text))

    def _live(self, key: int, before: int, piece: int) -> bool:
        """Whether the pair's weight is finite."""
        one, two = self._symbol(before), self._symbol(piece)
        got = self._merge(one + two) == [one, two]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = got
        return got

    def _arcs(self, text: str, s: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs from a place, short ones first."""
        get, out = self.steps.get, []
        piece = get(text[s])
        out.append((s + 1, len(self.text) + ord(text[s]) if piece is None or piece < 0 else piece))
        if piece is not None:
            for e in range(s + 2, len(text) + 1):
                piece = get(text[s:e])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((e, piece))
        return out

    def _path_merges(self, text: str) -> list[int]:
        """The one path of finite weight. The lattice is composed as it is searched, the longest arc of a place first; a
        place is reached by one finite path at most, so one that leads no further is closed for good."""
        n, pair, live, arcs = len(text), self.pairs.get, self._live, self._arcs
        out: list[int] = []
        begun: list[int] = []
        left: list[list[tuple[int, int]]] = []
        shut = bytearray(n + 1)
        pos, found = 0, arcs(text, 0)
        while pos < n:
            while found:
                e, piece = found.pop()
                if shut[e]:
                    continue
                if out:
                    key = out[-1] << 21 | piece
                    ok = pair(key)
                    if ok is None:
                        ok = live(key, out[-1], piece)
                    if not ok:
                        continue
                left.append(found)
                begun.append(pos)
                out.append(piece)
                pos = e
                if e < n:
                    found = arcs(text, e)
                break
            else:
                shut[pos] = 1
                found, pos = left.pop(), begun.pop()
                out.pop()
        return out

    def _path_costs(self, text: str) -> list[int]:
        """The cheapest path, relaxed place by place; of equal ones the first found, which has the longer pieces in front."""
        n = len(text)
        cost, back = [np.float32(0)] + [np.float32(np.inf)] * n, [(0, 0)] * (n + 1)
        for s in range(n):
            for e, number in self._arcs(text, s):
                c = cost[s] + self.costs.get(number, self.dearest)
                if c < cost[e]:
                    cost[e], back[e] = c, (s, number)
        out, e = [], n
        while e:
            e, number = back[e]
            out.append(number)
        return out[::-1]

    def _output(self, number: int) -> tuple[int, ...]:
        """What the arc of a character that no piece covers emits."""
        got = tuple(self.bytes[b] for b in chr(number - len(self.text)).encode()) if self.bytes else (self.unknown,)
        self.emits[number] = got
        return got

    def _emit(self, part: str) -> bytes:
        """Ids of a part that no piece leaves, as 32-bit numbers: what the arcs of its path emit."""
        path = self._path_merges(part) if self.merges else self._path_costs(part)
        out, size = [], len(self.text)
        for number in path:
            if number < size:
                out.append(number)
            else:
                out += self.emits.get(number) or self._output(number)
        raw = array("i", out).tobytes()
        if len(part) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[part] = raw
        return raw

    def _parts(self, text: str) -> bytes:
        get, emit = self.cache.get, self._emit
        raw = b"".join([got if (got := get(p)) is not None else emit(p) for p in self.cut.findall(text)])
        return raw if self.bytes else self._known(raw)

    def _known(self, raw: bytes) -> bytes:
        """Without byte pieces: unknown ids in a row are one."""
        ids = np.frombuffer(raw, np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text, as 32-bit numbers."""
        if not text:
            return b""
        if not self.splits or not self.bytes or text[0] == " " or "  " in text or SPACE in text:
            return self._parts(self.normalise(text))
        # Single spaces: words are parts with a mark before them, so the cache answers for most of them at once.
        get, parts = self.cache.get, self._parts
        return b"".join([got if (got := get(w)) is not None else parts(w) for w in [SPACE + w for w in text.split(" ")]])

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def expected(self, text: str) -> str:
        """What decoding an encoded text must give: the normalised text with its spaces back."""
        whole = self.normalise(text).replace(SPACE, " ")
        return whole[1:] if self.prefix and whole[:1] == " " else whole

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids say nothing, bytes that aren't UTF-8 become U+FFFD."""
        return self._decoded(self.plain.take(pa.array(ids, pa.int32())).buffers()[2], 0, None) if ids else ""

    def _decoded(self, data, a: int, b: int | None) -> str:
        whole = (data.to_pybytes() if data is not None else b"")[a:b].decode(errors="replace")
        return whole[1:] if self.prefix and whole[:1] == " " else whole

    def same(self, texts: list[str | None], ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """For each text whether decoding its ids (offsets into ids) gives it back, as normalised. All are decoded at once."""
        taken = self.plain.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
        raw = taken.buffers()[2].to_pybytes() if len(ids) else b""
        cut = ends[offsets].tolist() if len(ids) else [0] * len(offsets)
        out = []
        for text, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
            whole = raw[a:b].decode(errors="replace")
            out.append(not text or (whole[1:] if self.prefix and whole[:1] == " " else whole) == self.expected(text))
        return out


def _free(name: str, taken: list[str]) -> str:
    """A column name that isn't taken; Spark tells names apart without regard to case."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, text_col: str = "text", *, ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """docs with ids_col, the token ids of text_col by the model file at path `model`, and, if named, check_col: whether
    decoding the ids gives the text back (as normalised).

    One pass without a shuffle. Every worker compiles the machine from the model file, whose path must be readable on each
    executor. Null or empty texts have no ids and check as true. Columns of docs are carried; ids_col and check_col replace
    columns of their name. A text of any length is encoded whole, in memory of about its length.
    """
    names = [c for c in docs.columns if c not in (ids_col, check_col)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"`{ids_col}` array<int>"] + [f"`{check_col}` boolean"] * bool(check_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = part.column(len(names)).to_pylist()
                raw = [c.encode_bytes(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
                ids = np.frombuffer(b"".join(raw), np.int32)
                columns = [*part.columns[: len(names)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
                if check_col:
                    columns.append(pa.array(c.same(texts, ids, offsets), pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*names, ids_col, *[check_col] * bool(check_col)])

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(_free("text", names))).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids_col: str = "ids", *, text_col: str = "text") -> DataFrame:
    """tokens with text_col, the text of ids_col; null ids give a null text. It replaces a column of its name."""
    names = [c for c in tokens.columns if c != text_col]
    schema = ", ".join([f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in names] + [f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if i is None else c.decode([x for x in i if x is not None and 0 <= x < len(c.kind)]) for i in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, text_col])

    return tokens.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids_col}`").alias(_free("ids", names))).mapInArrow(run, schema)
