"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms (its places) and integer weights. Candidates are dealt into shards, each an
inverted file: for every term the positions and weights of the rows that have it. Queries come in blocks. For a
block and a shard, every term of a query scatters its weighted postings into a dense array of scores, one score for
each row of the shard; partition selection then leaves the ``k`` best of each query, and Spark merges what
the shards left.

Every block meets every shard: that is the task, a stated query set against all rows. Both are packed, a row for
thousands of vectors, so Spark pairs a few large rows. It sends the blocks to all tasks if they are
smaller than its own threshold and otherwise pairs partitions, with no shuffle in either case. Only the ``k`` best per
query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import settled
from tidelog.llm.packed import pack, unpack

_SHARD_ROWS = 4_096
_BLOCK_ROWS = 256
_NONE = np.iinfo(np.int64).min
_PACKED = "row binary, id binary, no_id binary, terms binary, starts binary, places binary, weights binary"


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component as a double; NULL for a vector that is NULL or holds a NULL or a
    component that is not finite."""
    whole = f"forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return F.expr(f"IF({whole}, transform(`{vector}`, x -> floor({scale} * CAST(x AS double))), NULL)")


def _packing(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (row, id, weights) to inverted files of ``rows`` rows at most, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield _inverted(batch.slice(at, rows))

    return run


def _inverted(batch: pa.RecordBatch) -> pa.RecordBatch:
    row, given = batch.column(0).to_numpy(), batch.column(1)
    id_, no_id = given.fill_null(0).to_numpy(), given.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((row, id_, no_id))
    lengths = batch.column(2).value_lengths().to_numpy()
    flat = batch.column(2).flatten().to_numpy()
    # Where each weight stands: the place of its row in that order, and its term.
    place = np.empty(len(row), np.int64)
    place[order] = np.arange(len(row))
    owner = np.repeat(place, lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = np.flatnonzero(flat)
    used = used[np.lexsort((owner[used], term[used]))]
    terms, starts = np.unique(term[used], return_index=True)
    columns = [row[order], id_[order], no_id[order].astype(np.int8), terms, np.append(starts, len(used)), owner[used], flat[used]]
    return pa.RecordBatch.from_arrays(
        [pa.array([pack(c)], pa.binary()) for c in columns], names=[c.split()[0] for c in _PACKED.split(", ")]
    )


def _scores(shard: list[np.ndarray], block: list[np.ndarray]) -> np.ndarray:
    """Inner products, a row for each row of the shard and a column for each query. Sums of 64 bits are exact, or an error."""
    _, ids, _, terms, starts, places, weights = shard
    _, queries, _, q_terms, q_starts, q_places, q_weights = block
    largest = [max(abs(int(w.max())), abs(int(w.min()))) if w.size else 0 for w in (weights, q_weights)]
    most = largest[0] * largest[1] * max(1, min(len(terms), len(q_terms)))
    if most >= 1 << 63:
        raise ArithmeticError("inner products of these weights can be beyond 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    scores = np.zeros((len(ids), len(queries)), kind)
    for _, i, j in zip(*np.intersect1d(terms, q_terms, assume_unique=True, return_indices=True), strict=True):
        of, weight = places[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]].astype(kind)
        by = q_places[q_starts[j] : q_starts[j + 1]]
        spread = np.zeros(len(queries), kind)
        spread[by] = q_weights[q_starts[j] : q_starts[j + 1]]
        if len(of) == len(ids):
            scores += np.multiply.outer(weight, spread)
        else:
            scores[of] += np.multiply.outer(weight, spread)
    return scores


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries of the ``k`` highest scores of each query, of equal ones those further up."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        query, row = np.nonzero((scores >= least).T)
    else:
        query, row = np.nonzero(np.ones(scores.shape, bool).T)
    order = np.lexsort((row, -scores[row, query].astype(np.int64), query))
    query, row = query[order], row[order]
    first = np.searchsorted(query, np.arange(scores.shape[1]))
    kept = np.arange(len(query)) - first[query] < k
    return row[kept], query[kept]


def _pairs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pairs of a shard and a block to the ``k`` best rows of the shard for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(_PACKED.split(", "))
        for batch in batches:
            for i in range(batch.num_rows):
                both = [unpack(c[i].as_py()) for c in batch.columns]
                shard, block = both[:width], both[width:]
                scores = _scores(shard, block)
                row, query = _best(_without_own(scores, shard[0], block[0]), k)
                value = scores[row, query].astype(np.int64)
                own = shard[0][row] == block[0][query]
                row, query, value = row[~own], query[~own], value[~own]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query": pa.array(block[0][query].astype(np.int64)),
                        "query_id": pa.array(block[1][query].astype(np.int64), mask=block[2][query] == 1),
                        "row": pa.array(shard[0][row].astype(np.int64)),
                        "vec_id": pa.array(shard[1][row].astype(np.int64), mask=shard[2][row] == 1),
                        "score": pa.array(value),
                    }
                )

    return run


def _without_own(scores: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The scores, with a query's own row below all others."""
    _, at, of = np.intersect1d(rows, queries, assume_unique=True, return_indices=True)
    if not len(at):
        return scores
    scores = scores.astype(np.int64)
    scores[at, of] = _NONE + 1
    return scores


def exact_top_k(
    vectors: DataFrame, queries: Column, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row of ``vectors`` that meets ``queries`` the ``k`` other rows with the highest inner product of
    ``floor(scale * x)``: ``(query_id, rank, vec_id, score)``, all others if they are fewer.

    Ties go to the smaller id, those without an id last. Rows are told apart by a stored row number: repeated rows
    are found like any others, and a repeated id is a query once for each of its rows. Vectors that are NULL or
    hold NULL, NaN or an infinite component are neither queries nor found. Vectors of different lengths are sparse rows, so what
    one lacks counts as 0, and an empty one scores 0. Scores beyond 64 bits are an error. Other columns are not read.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), scaled(vector_col, scale).alias("weights"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).where("weights IS NOT NULL")
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    columns = ["row", "id", "weights"]
    shards = settled(rows.select(*columns).mapInArrow(_packing(_SHARD_ROWS), _PACKED))
    blocks = settled(rows.where("asks").select(*columns).mapInArrow(_packing(_BLOCK_ROWS), _PACKED))
    pairs = shards.crossJoin(blocks.toDF(*[f"q_{c}" for c in blocks.columns]))
    found = pairs.mapInArrow(_pairs(k), "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
