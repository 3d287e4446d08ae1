"""A Bloom filter of bounded size in DataFrame operations: which rows need a join at all."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS_PER_KEY = 16


@dataclass(frozen=True)
class Bloom:
    """``size`` words of 64 bits, a power of two, as JSON."""

    words: str
    size: int

    def passes(self, key: str) -> str:
        """SQL: whether the number ``key`` can be one of the filter's. It is true for all of them, and for few others as
        long as the filter is not crowded."""
        bits = f"from_json('{self.words}', 'array<bigint>')"
        hit = "(shiftright(get({bits}, CAST(shiftright({p}, 6) AS int)), CAST({p} & 63 AS int)) & 1L) = 1L"
        return " AND ".join(hit.format(bits=bits, p=p) for p in _probes(key, self.size))


def _probes(key: str, size: int) -> list[str]:
    return [f"(shiftrightunsigned({key}, {shift}) & {size * 64 - 1}L)" for shift in (0, 32)]


def bloom_of(keys: DataFrame, most_words: int = 1 << 16) -> Bloom:
    """The filter of a frame's only column, distinct 64-bit hashes. It has 16 bits a key, but no more than ``most_words``
    words: of more keys more other rows pass, and none is lost."""
    (key,) = keys.columns
    wanted, size = keys.count() * _BITS_PER_KEY // 64 + 1, 64
    while size < min(wanted, most_words):
        size *= 2
    probes = keys.select(F.explode(F.array(*[F.expr(p) for p in _probes(f"`{key}`", size)])).alias("bit"))
    words = probes.groupBy(F.expr("CAST(shiftright(bit, 6) AS int)").alias("at"))
    filled = [0] * size
    # ``size`` rows at most.
    for at, word in words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS int))"))).collect():
        filled[at] = word
    return Bloom(json.dumps(filled), size)
