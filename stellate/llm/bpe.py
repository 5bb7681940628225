"""Encoding texts with a public byte-level BPE vocabulary.

The vocabulary's tokens, as Latin-1 strings of their bytes, form an Aho-Corasick automaton. A piece of text is encoded
from the left by the longest token at each place; where a token can't follow the one before it, a shorter one is tried,
and where none is left the encoder goes back a token. Whether two tokens may stand side by side is decided once and
kept; a place found to be a dead end isn't visited again, so the time is linear and the result that of merging by rank.

Defined results: a null or empty text has no ids; names of special tokens within a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Where the public vocabularies are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: How texts are cut into pieces before merging: fixed with each vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERNS = {"byte_bpe_50k": PATTERN, "byte_bpe_multi_50k": PATTERN}
#: Entries of the per-process memory of pieces, and the length up to which a piece is kept there.
_PIECES, _PIECE_LENGTH = 400_000, 48


class Bpe:
    """An encoder for ranks, (token bytes, id) with ids in the order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ids = {token.decode("latin-1"): n for token, n in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, n in self.ids.items():
            self.automaton.add_word(token, (len(token), n))
        self.automaton.make_automaton()
        size = max(self.ids.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for token, n in sorted(self.ids.items(), key=lambda x: x[1]):
            for cut in range(len(token) - 1, 0, -1):
                a, b = self.ids.get(token[:cut], size), self.ids.get(token[cut:], size)
                if a < n and b < n and self._compatible(a, b):
                    self.left[n], self.right[n] = a, b
                    self.merged[a, b] = n
                    break
        self._fits.clear()
        self.pieces: dict[str, array] = {}
        self.split = regex.compile(pattern).findall

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave a and b side by side.

        Undoes the merges on both sides of the border, the latest first. If the two tokens at the border at some moment
        merge to one of a lower rank than the merges already undone, that merge would have come first.
        """
        known = self._fits.get((a, b))
        if known is not None:
            return known
        first, second, bound, fits = a, b, len(self.left) + 1, True
        while True:
            joined = self.merged.get((first, second))
            if joined is not None and joined < bound:
                fits = False
                break
            if first > second:
                later, other = (first, self.right[first], 0), (second, self.left[second], 1)
            else:
                later, other = (second, self.left[second], 1), (first, self.right[first], 0)
            for token, part, is_second in (later, other):
                if part != token:
                    bound = token + is_second
                    first, second = (first, part) if is_second else (part, second)
                    break
            else:
                break
        self._fits[a, b] = fits
        return fits

    def encode_piece(self, text: str) -> array:
        """Ids of a piece, without cutting it further."""
        data = text.encode().decode("latin-1")
        whole = self.ids.get(data)
        if whole is not None:
            return array("i", (whole,))
        size = len(data)
        options: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(data):
            options[end + 1 - match[0]].append(match)
        # A stack of (place, which option); options stand in the order of their length.
        open_ = bytearray(b"\1") * (size + 1)
        chosen: list[int] = []
        where: list[tuple[int, int]] = []
        at, option = 0, len(options[0]) - 1
        fits, compatible = self._fits, self._compatible
        while at < size:
            before = chosen[-1] if chosen else -1
            here = options[at]
            while option >= 0:
                length, token = here[option]
                if open_[at + length]:
                    if before < 0:
                        break
                    ok = fits.get((before, token))
                    if compatible(before, token) if ok is None else ok:
                        break
                option -= 1
            if option >= 0:
                chosen.append(token)
                where.append((at, option))
                at += length
                if at < size:
                    option = len(options[at]) - 1
            else:
                open_[at] = 0
                chosen.pop()
                at, option = where.pop()
        return array("i", chosen)

    def encode(self, text: str) -> array:
        out = array("i")
        pieces = self.pieces
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= _PIECE_LENGTH:
                    if len(pieces) >= _PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from a file of lines 'base64 id'."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The encoder of a vocabulary file, made once a process."""
    with open(path, "rb") as f:
        return Bpe(ranks_of(f.read()), PATTERNS[os.path.basename(path).removesuffix(".tiktoken")])


def vocabulary(name: str, folder: str | None = None) -> str:
    """The file of a vocabulary; only those whose way of cutting texts is known."""
    if name not in PATTERNS:
        raise ValueError(f"no vocabulary of byte tokens: {name!r}; there are {sorted(PATTERNS)}")
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Ids of each text."""
    path = vocabulary(name, folder)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        offsets, out = np.zeros(len(texts) + 1, np.int32), array("i")
        for n, text in enumerate(texts):
            out += bpe.encode(text.as_py() or "")
            offsets[n + 1] = len(out)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(out, np.int32) if out else np.empty(0, np.int32)))

    return ids(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """How many ids each text has."""
    path = vocabulary(name, folder)

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([len(bpe.encode(t.as_py() or "")) for t in texts], pa.int64())

    return count(text)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): a row for each row of docs."""
    return spread(docs.select(key, text)).select(key, token_ids(F.col(text), name, folder).alias("ids"))
