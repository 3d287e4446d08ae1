"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes, per document, the set of its word shingles as 64-bit hashes, a key of
   that set and MinHash band keys. Equal sets are one class from here on, so copies cost nothing more.
2. Classes that share a band key are candidates. Within a band key every class is paired with the
   smallest one only (a star), never with all others.
3. Candidates are compared by batches of signature values. After each batch the posterior probability
   that the similarity reaches the threshold, under a uniform prior, is held against the allowed miss
   probability, and hopeless pairs are dropped (Satuluri and Parthasarathy, "Bayesian Locality
   Sensitive Hashing", 2012). Survivors are confirmed on the full sets.
4. Confirmed links give components. Where one band key still holds classes of several components,
   the pairs across components are compared in the same way. Pairs within one component are not: they
   could not change a result. Then the components are final.

At 28 bands of 4 rows a pair of similarity 0.8 shares no band with probability 4e-7, one of 0.85 with
1e-9. ``miss`` adds to that. No link is accepted on a signature alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_batches, settled
from tidelog.llm.components import components

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_BLOCK = 2048
_WORDS_KEPT = 250_000
_LEADERS = 4
_CELLS = 64


@dataclass(frozen=True)
class NearDups:
    """How documents are compared.

    ``words`` per shingle; a text with fewer words is one shingle. Linked are sets with
    ``100 * |intersection| >= percent * |union|``. ``values`` signature values are compared in batches of
    ``batch``, giving up a pair once the probability that it is linked is below ``miss``.
    """

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    values: int = 128
    batch: int = 16
    miss: float = 1e-8

    def __post_init__(self) -> None:
        if self.bands * self.rows > self.values:
            raise ValueError("bands need more signature values than there are")


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORDS_KEPT and len(word) < 64:
            self[word] = value
        return value


def shingle_set(text: bytes | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. Words are runs of anything but ASCII white
    space, A-Z in lower case."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    z = np.full(len(h) - k + 1, k, np.uint64) * _MIX[0]
    for i in range(k):
        z = (z ^ h[i : len(h) - k + 1 + i]) * _MIX[1]
        z ^= z >> np.uint64(29)
    z *= _MIX[2]
    z ^= z >> np.uint64(32)
    return np.unique(z)


def _seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 2**63, values, np.uint64)[:, None]
    return draw(), (draw() << np.uint64(1)) | np.uint64(1)


def signature(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values; the set must not be empty."""
    xor, odd = seeds
    low = np.full(len(xor), 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        mixed = (shingles[None, start : start + _BLOCK] ^ xor) * odd
        np.minimum(low, mixed.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _profiles(spec: NearDups, with_sets: bool) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Rows (id, key, n, bands), or (id, key, n, sig, shingles, cells) for those compared."""

    def start():
        hashes, seeds = _WordHashes(), _seeds(spec.values)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, bands, values, sets, spread = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, spec.words, hashes)
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sizes.append(len(shingles))
                sig = signature(shingles, seeds) if len(shingles) else None
                if with_sets:
                    values.append(None if sig is None else sig.tobytes())
                    sets.append(shingles.tobytes())
                    spread.append(np.bincount((shingles % np.uint64(_CELLS)).astype(np.int64), minlength=_CELLS))
                elif sig is None:
                    bands.append(None)
                else:
                    rows = sig[: spec.bands * spec.rows].reshape(spec.bands, spec.rows)
                    bands.append(
                        [
                            xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2**63
                            for i, row in enumerate(rows)
                        ]
                    )
            columns = {"id": batch.column(0), "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int64())}
            if with_sets:
                columns |= {"sig": pa.array(values, pa.binary()), "shingles": pa.array(sets, pa.binary()), "cells": pa.array(spread, pa.list_(pa.int32()))}
            else:
                columns |= {"bands": pa.array(bands, pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(columns)

        return apply

    return start


def least_matches(spec: NearDups) -> np.ndarray:
    """For each batch end, the fewest matching values with which a pair is still worth comparing.

    With m of n values alike and a uniform prior, the similarity has a Beta(m + 1, n - m + 1)
    distribution. Its tail above the threshold equals the chance of at most m successes in n + 1 draws.
    """
    t = spec.percent / 100
    out = []
    for n in range(spec.batch, spec.values + 1, spec.batch):
        tail, least = 0.0, n + 1
        for m in range(n + 1):
            choose = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m)
            tail += exp(choose + m * log(t) + (n + 1 - m) * log(1 - t)) if t < 1 else float(m > n)
            if tail >= spec.miss:
                least = m
                break
        out.append(min(least, n))
    return np.array(out)


def _exploded() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Rows (cid, shingle, cell) of sets."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        all_ = np.concatenate(sets)
        cid = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        return pa.RecordBatch.from_pydict({"cid": pa.array(cid), "shingle": pa.array(all_), "cell": pa.array((all_.view(np.uint64) % np.uint64(_CELLS)).astype(np.int32))})

    return apply


def _sequential(spec: NearDups) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Pairs (a, b, sig_a, sig_b) that no batch rules out, with the number of values alike."""

    def start():
        least = least_matches(spec)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, spec.values)
                for i in (2, 3)
            )
            open_, alike = np.arange(len(left)), np.zeros(len(left), np.int64)
            for k, least_now in enumerate(least):
                at = slice(k * spec.batch, (k + 1) * spec.batch)
                alike[open_] += (left[open_, at] == right[open_, at]).sum(axis=1)
                open_ = open_[alike[open_] >= least_now]
            return pa.RecordBatch.from_pydict(
                {
                    "a": batch.column(0).take(pa.array(open_)),
                    "b": batch.column(1).take(pa.array(open_)),
                    "alike": pa.array(alike[open_]),
                }
            )

        return apply

    return start


def _exact(spec: NearDups) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Pairs (a, b, set_a, set_b) that are linked."""

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= spec.percent * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return apply

    return start


def _of_pairs(pairs: DataFrame, profiles: DataFrame, column: str) -> DataFrame:
    side = lambda name: profiles.select(F.col("cid").alias(name), F.col(column).alias(f"{column}_{name}"))
    return (
        pairs.select("a", "b")
        .join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", f"{column}_a", f"{column}_b")
    )


def _plausible(pairs: DataFrame, profiles: DataFrame, spec: NearDups) -> DataFrame:
    schema = "a bigint, b bigint, alike bigint"
    return map_batches(_of_pairs(pairs, profiles, "sig"), _sequential(spec), schema)


def _linked(pairs: DataFrame, profiles: DataFrame, spec: NearDups) -> DataFrame:
    return map_batches(_of_pairs(pairs, profiles, "shingles"), _exact(spec), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, spec: NearDups = NearDups(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``; the id keeps its name.

    ``component_id`` is the smallest id reachable over links; ``kept`` marks that row. NULL and empty
    texts, and texts of white space, have an empty set and are linked with nothing. A row without an id
    takes part in linking but never gives a component its id; if a component has no id at all, its
    ``component_id`` is NULL and its rows are kept. Rows that repeat an id count as that one document:
    they are kept or not together. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = settled(
        map_batches(texts, _profiles(spec, False), "id bigint, key binary, n bigint, bands array<bigint>")
    )
    n = rows.count()  # no narrow table below has more rows than a few for each document
    # One row per set. The key is shuffled with one row per task and class at most.
    classes = settled(
        rows.where("n > 0")
        .groupBy("key")
        .agg(F.min("id").alias("id"), F.min(F.struct("n", "bands")).alias("own"))
        .select("key", "id", "own.n", "own.bands", F.monotonically_increasing_id().alias("cid"))
    )
    places = classes.select("cid", "n", F.explode("bands").alias("band"))
    stars = settled(
        places.groupBy("band")
        .agg(F.min(F.struct("cid", "n")).alias("first"), F.count("*").alias("size"))
        .where("size > 1")
        .select("band", F.col("first.cid").alias("a"), F.col("first.n").alias("n_a"))
    )
    fits = F.expr(f"100 * least(n_a, n) >= {spec.percent} * greatest(n_a, n)")
    shared = settled(places.join(stars, "band").select("band", "a", "n_a", "cid", "n"))
    pairs = settled(
        shared.where(F.col("a") != F.col("cid")).where(fits).select("a", F.col("cid").alias("b")).distinct(), n
    )

    # The sets themselves are made anew for the classes that share a band with another.
    wanted = settled(shared.select("cid").distinct().join(classes.select("cid", "key", "id"), "cid"), n)
    ids = wanted.select(F.col("id").alias("wanted_id"))
    again = texts.join(ids, texts.id.eqNullSafe(ids.wanted_id), "left_semi")
    made = map_batches(again, _profiles(spec, True), "id bigint, key binary, n bigint, sig binary, shingles binary, cells array<int>")
    # Rows of a repeated or missing id bring sets that nobody asked for, or one several times.
    profiles = settled(
        wanted.select("cid", "key").join(
            made.where("n > 0").groupBy("key").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles"), F.first("cells").alias("cells")),
            "key",
        ).drop("key")
    )

    def confirmed(candidates: DataFrame) -> DataFrame:
        return settled(_linked(settled(_plausible(candidates, profiles, spec)), profiles, spec))

    def open_places(links: DataFrame) -> DataFrame:
        """Places on shared band keys that hold several components, with the component so far."""
        roots = settled(components(links, "a", "b"), n).withColumnRenamed("node", "cid")
        known = settled(shared.join(roots, "cid", "left").select("band", "cid", "n", F.coalesce("root", "cid").alias("root")))
        several = known.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        return settled(known.join(settled(several.select("band"), n), "band"))

    links = confirmed(pairs)
    known = open_places(links)

    # Shingles that a class has alone among those still open are in no intersection. The others are counted by
    # cells of their hash: the smaller counts of two classes, summed over cells, bound their intersection.
    asked = settled(known.select("cid").distinct())
    sets = map_batches(
        profiles.join(asked, "cid").select("cid", "shingles"), _exploded, "cid bigint, shingle bigint, cell int"
    )
    alone = (
        sets.groupBy("shingle")
        .agg(F.count("*").alias("owners"), F.min("cid").alias("cid"), F.min("cell").alias("cell"))
        .where("owners = 1")
        .groupBy("cid")
        .agg(F.count("*").alias("alone"), F.array(*[F.count_if(F.col("cell") == i) for i in range(_CELLS)]).alias("off"))
    )
    common = F.expr("CASE WHEN off IS NULL THEN cells ELSE zip_with(cells, off, (x, y) -> CAST(x - y AS int)) END")
    shape = settled(
        profiles.select("cid", "cells")
        .join(asked, "cid")
        .join(settled(alone, n), "cid", "left")
        .join(classes.select("cid", "bands"), "cid")
        .select("cid", "bands", F.coalesce("alone", F.lit(0)).alias("alone"), common.alias("cells"))
    )
    can_link = F.expr(
        f"100 * least(n_a - alone_a, n - alone) >= {spec.percent} * (n_a + n - least(n_a - alone_a, n - alone))"
    )

    # More leaders: on each band key the classes with the smallest share of shingles they have alone, and the
    # first in other orders. In a large group of copies that differ by about as much as is allowed, a
    # class that misses one leader meets a better one, and the group grows together.
    known = settled(known.join(shape.select("cid", "alone"), "cid"))
    member = F.struct("cid", "n", "root", "alone")
    orders = [F.struct(F.col("alone") / F.col("n"), F.xxhash64("cid", F.lit(i))) for i in range(2)]
    orders += [F.xxhash64("cid", F.lit(i)) for i in range(_LEADERS)]
    leaders = known.groupBy("band").agg(F.array_distinct(F.array(*[F.min_by(member, o) for o in orders])).alias("leads"))
    met = (
        known.join(settled(leaders), "band")
        .select("cid", "n", "root", "alone", F.explode("leads").alias("lead"))
        .where(F.col("lead.root") != F.col("root"))
        .select(F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b"), "n", "alone", F.col("lead.n").alias("n_a"), F.col("lead.alone").alias("alone_a"))
        .where(can_link)
        .select("a", "b")
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    met = settled(met, n)
    links = links.union(confirmed(met))

    # What is left: the pairs of a band key across components, each on the first band key it shares.
    known = settled(open_places(links).join(shape, "cid"))
    other = known.select("band", *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "root", "alone", "bands", "cells")])
    first = F.expr("get(bands, CAST(array_position(zip_with(bands, bands_a, (x, y) -> x = y), true) AS int) - 1) = band")
    overlap = "aggregate(zip_with(cells, cells_a, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    close = F.expr(f"{100 + spec.percent} * {overlap} >= {spec.percent} * (n_a + n)")
    crossing = (
        known.join(other, "band")
        .where((F.col("cid_a") < F.col("cid")) & (F.col("root_a") != F.col("root")) & can_link & first & close)
        .select(F.col("cid_a").alias("a"), F.col("cid").alias("b"))
        .join(pairs.union(met), ["a", "b"], "left_anti")
    )
    links = links.union(confirmed(settled(crossing)))

    members = settled(
        classes.select("key", "id", "cid")
        .join(components(links, "a", "b").withColumnRenamed("node", "cid"), "cid", "left")
        .select("key", "id", F.coalesce("root", "cid").alias("root")),
        n,
    )
    smallest = settled(members.groupBy("root").agg(F.min("id").alias("component")), n)
    named = settled(members.join(smallest, "root").select("key", "component"), n)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return (
        rows.drop("bands")
        .join(named, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            component.eqNullSafe(F.col("id")).alias("kept"),
        )
    )
