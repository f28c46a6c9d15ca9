"""Reading the public vocabularies; their path is always a parameter."""

from __future__ import annotations

import importlib.util
import os
from functools import lru_cache

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_path(name: str) -> str:
    """Where the machine keeps a public vocabulary file."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = next(iter(spec.submodule_search_locations)) if spec and spec.submodule_search_locations else "/opt/tokenizers"
    return os.path.join(folder, name)


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message's fields; values are bytes or ints."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, raw[at : at + n]
        at += n


@lru_cache(maxsize=4)
def load_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, object]]:
    """(piece, score, kind) by id, and the fields of the normaliser's specification."""
    import struct

    pieces, normaliser = [], {}
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, normaliser


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    return [p for p, _, kind in load_model(path)[0] if kind == NORMAL]


def pattern() -> str:
    """The pattern that the byte-level vocabularies split text by."""
    import public_tokenizers

    return public_tokenizers.PATTERN
