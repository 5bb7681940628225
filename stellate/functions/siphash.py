"""The public SipHash-2-4 of integers under the zero key, for deterministic slices of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = np.uint64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _WORD(n)) | (x >> _WORD(64 - n))


def siphash(words: list[np.ndarray]) -> np.ndarray:
    """Of messages of whole 64-bit words, many messages at a time."""
    size = len(words[0])
    v = [np.full(size, c, _WORD) for c in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]

    def mix(times: int) -> None:
        for _ in range(times):
            v[0] += v[1]
            v[2] += v[3]
            v[1], v[3] = _rotate(v[1], 13) ^ v[0], _rotate(v[3], 16) ^ v[2]
            v[0] = _rotate(v[0], 32) + v[3]
            v[2] += v[1]
            v[1], v[3] = _rotate(v[1], 17) ^ v[2], _rotate(v[3], 21) ^ v[0]
            v[2] = _rotate(v[2], 32)

    last = np.full(size, (8 * len(words) % 256) << 56, _WORD)
    with np.errstate(over="ignore"):
        for m in [*words, last]:
            v[3] = v[3] ^ m
            mix(2)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ _WORD(0xFF)
        mix(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def slice_of(id_: Column, total: int) -> Column:
    """The slice, of total, that an id falls into."""

    @F.arrow_udf(T.LongType())
    def slices(ids: pa.Array) -> pa.Array:
        n = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array((siphash([n]) % _WORD(total)).astype(np.int64))

    return slices(id_.cast("long"))
