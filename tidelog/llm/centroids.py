"""Centroid clustering over zone maps: vectors in the order of a space-filling curve, blocks with boxes, exact distances.

Vectors are put in the order of a Hilbert curve and cut into blocks. A block keeps, beside its vectors, their least and
greatest value in every dimension: a box. In each round the distance of a centroid to the nearest and to the farthest
point of the box bounds its distance to every vector within; a centroid whose nearest point is farther than another's
farthest is none of the block's. The centroids that are left are compared with the vectors, exactly. A block that has one
candidate left is counted whole, by its stored sums, and its vectors are not looked at.

All numbers are integers. Distances are sums in 64 bits, or in doubles where these are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import settled
from tidelog.llm.packed import pack, unpack
from tidelog.llm.topk_search import scaled

_BLOCK_ROWS = 256
_CURVE_BITS = 2
#: Components up to here have exact squared distances in 64 bits, and up to there in doubles (64 dimensions).
_MOST, _MOST_DOUBLE = 1 << 27, 1 << 21
_BLOCK = "ids binary, no_id binary, vectors binary, low binary, high binary, sums binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Position on the Hilbert curve through a grid with ``2**bits`` cells a side, as bytes that sort alike.

    Skilling, "Programming the Hilbert curve" (2004): undo the rotations from the highest bit down, then Gray-decode;
    the bits of all coordinates interleaved, highest first, are the position.
    """
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:
        below = level - 1
        for i in range(dims):
            turn = (x[i] & level) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turn, below, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = top
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    planes = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(dims)]
    return [row.tobytes() for row in np.packbits(np.array(planes, np.uint8).T, axis=1)]


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _ordered(rows: DataFrame, dims: int) -> DataFrame:
    """Rows in the order of the curve. Every dimension is cut into cells between its least and greatest value; the
    dimensions that vary most come first. Equal places on the curve are split by row number."""
    facts = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d")
    # A row for each dimension.
    facts = sorted(facts.agg(F.min("x"), F.max("x"), F.var_pop(F.col("x").cast("double"))).collect(), key=lambda r: r[0])
    low = np.array([r[1] for r in facts], np.int64)
    wide = np.array([max(1, r[2] - r[1] + 1) for r in facts], np.float64)
    if max(max(abs(r[1]), abs(r[2])) for r in facts) >= _MOST:
        raise ArithmeticError(f"components of {_MOST} or more have distances beyond 64 bits")
    first = np.argsort([-r[3] for r in facts], kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor((_matrix(batch.column(2), dims) - low) / wide * (1 << _CURVE_BITS)).astype(np.int64)
                keys = hilbert_keys(cells[:, first], _CURVE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], names=["place", "row", "id", "v"])

    placed = rows.select("row", "id", "v").mapInArrow(run, "place binary, row bigint, id bigint, v array<bigint>")
    return placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row")


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(at, _BLOCK_ROWS)
                v = _matrix(part.column(1), dims)
                no_id = part.column(0).is_null().to_numpy(zero_copy_only=False)
                columns = [part.column(0).fill_null(0).to_numpy(), no_id.astype(np.int8), v, v.min(0), v.max(0), v.sum(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack(c)], pa.binary()) for c in columns], names=[c.split()[0] for c in _BLOCK.split(", ")]
                )

    return settled(rows.select("id", "v").mapInArrow(run, _BLOCK))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector in the box, ascending. No other can, nor tie."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    return np.flatnonzero((outside**2).sum(1) <= (farthest**2).sum(1).min())


def nearest(v: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``numbers`` to each vector and its squared distance; ties go to the smaller number."""
    some = centroids[numbers]
    if max(np.abs(v).max(initial=0), np.abs(some).max(initial=0)) < _MOST_DOUBLE:
        x, c = v.astype(np.float64), some.astype(np.float64)
        squared = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        squared = np.stack([((v.astype(np.int64) - c) ** 2).sum(1) for c in some], axis=1)
    best = squared.argmin(1)
    return numbers[best], squared[np.arange(len(v)), best]


def _summing(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number of vectors and sum of every dimension for each centroid, one set of rows for a task."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared, whole = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0, 0
        for batch in batches:
            for low, high, total, vectors in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                numbers = candidates(unpack(low), unpack(high), centroids)
                v = unpack(vectors).reshape(-1, dims)
                if len(numbers) == 1:
                    whole += len(v)
                    counts[numbers[0]] += len(v)
                    sums[numbers[0]] += unpack(total)
                    continue
                compared += len(v) * len(numbers)
                of, _ = nearest(v, centroids, numbers)
                counts += np.bincount(of, minlength=k)
                for c in np.unique(of):
                    sums[c] += v[of == c].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": np.repeat(np.arange(k, dtype=np.int32), dims),
                "d": np.tile(np.arange(dims, dtype=np.int32), k),
                "n": np.repeat(counts, dims),
                "x": sums.ravel(),
            }
        )

    return run


def _assigning(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, no_id, vectors, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                of, squared = nearest(unpack(vectors).reshape(-1, dims), centroids, candidates(unpack(low), unpack(high), centroids))
                id_ = pa.array(unpack(ids).astype(np.int64), mask=unpack(no_id) == 1)
                yield pa.RecordBatch.from_arrays([id_, pa.array(of.astype(np.int32)), pa.array(squared)], names=["id", "cluster", "distance"])

    return run


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; of one id's vectors the smallest. Rows without an id come last."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Assign vectors to ``k`` centroids after ``rounds`` rounds: ``(id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256)``, a row for each row whose vector has ``dims`` components, all of them finite; others are left out.

    Components are ``floor(scale * x)``. A round assigns every vector to the nearest centroid, the smaller number if
    two are as near, and moves a centroid to the floor of its vectors' mean; without vectors it stays. With fewer
    than ``k`` vectors there are as many centroids. Repeated rows and ids are rows like all others, a NULL id stays NULL.
    Components of 2**27 or more after scaling are an error. Other columns are not read. What goes through the
    driver is a sum for each centroid and dimension.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), scaled(vector_col, scale).alias("v")).where(f"size(v) = {dims}")
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    centroids = _first(rows, k, seed)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        made = "cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING"
        return spark.createDataFrame([], f"`{id_col}` {kind}, {made}")
    blocks = _blocks(_ordered(rows, dims), dims)
    for _ in range(rounds):
        sums = blocks.select("low", "high", "sums", "vectors").mapInArrow(_summing(centroids), "cluster int, d int, n bigint, x bigint")
        for r in sums.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            if r.n:
                centroids[r.cluster, r.d] = int(r.x) // r.n
    assigned = blocks.select("ids", "no_id", "vectors", "low", "high")
    assigned = settled(assigned.mapInArrow(_assigning(centroids), "id bigint, cluster int, distance bigint"))
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return assigned.select(
        F.col("id").cast(kind).alias(id_col),
        "cluster",
        "distance",
        per_cluster([inertia.get(c, 0) for c in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        per_cluster(digests).alias("centroid_sha256"),
    )
