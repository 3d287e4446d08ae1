"""Ranked lexical search: Block-Max MaxScore over a sharded inverted index.

:func:`index` deals documents into shards and writes the posting lists of each as blocks of at most 128 postings, in
few bytes, beside what bounds a block without unpacking it: its last document, greatest frequency and shortest document.
A score grows with the frequency and falls with the length, so these two bound every score in the block, whatever the
corpus' counts turn out to be: the texts are read once, and counts of the whole corpus come out of the index.

:func:`search` brings the lists of the queries' terms together by shard. Within a shard a query sorts its lists by their
bound. The lists whose bounds together cannot beat the worst of the best so far are not essential: a document
in none but these cannot win. Candidates come from the essential lists alone. For the other lists, from the
strongest down, the bound of the block a candidate falls in decides whether it can still win; blocks without such a candidate are
not unpacked. Each shard ends with its best documents per query, and Spark merges these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import settled
from tidelog.llm.packed import pack, unpack

#: Every byte that is in no term becomes a space, A-Z become a-z. Bytes of other characters are in terms.
_FOLD = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_POSTINGS = 128
_SHARD_BYTES, _SHARD_DOCS = 6 << 20, 1 << 14
_DOCS = b""  # the "term" of the rows that hold a shard's documents
_BLOCK_ITEMS = 1_024
_GROUPS_PER_TASK = 4
_INDEX = "shard bigint, term binary, last int, postings int, tf int, n bigint, data binary, ids binary"


def _widths(numbers: np.ndarray) -> np.ndarray:
    """Bytes that hold each number: 1, 2, 4 or 8."""
    return np.select([numbers < 1 << 8, numbers < 1 << 16, numbers < 1 << 32], [1, 2, 4], 8)


def _blocks(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of postings that come sorted by term and document. ``data`` are the bytes of all blocks, cut at ``ends``:
    two widths, then the distances between documents, then the frequencies."""
    new = np.append(True, term[1:] != term[:-1])
    first = np.flatnonzero(new)
    in_list = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    starts = np.flatnonzero(in_list % _POSTINGS == 0)
    sizes = np.diff(np.append(starts, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    of = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(term)) - starts[of]
    wide_gap, wide_tf = _widths(np.maximum.reduceat(gap, starts)), _widths(np.maximum.reduceat(tf, starts))
    ends = np.cumsum(2 + sizes * (wide_gap + wide_tf))
    at = ends - (2 + sizes * (wide_gap + wide_tf))
    data = np.zeros(ends[-1], np.uint8)
    data[at], data[at + 1] = wide_gap, wide_tf
    for numbers, wide, begin in ((gap, wide_gap, at + 2), (tf, wide_tf, at + 2 + sizes * wide_gap)):
        for size in np.unique(wide):
            some = np.flatnonzero(wide[of] == size)
            where = begin[of[some]] + place[some] * size
            for byte in range(size):
                data[where + byte] = numbers[some] >> 8 * byte & 0xFF
    return {
        "term": term[starts],
        "last": doc[starts + sizes - 1],
        "postings": sizes,
        "tf": np.maximum.reduceat(tf, starts),
        "n": np.minimum.reduceat(length[doc], starts),
        "data": data,
        "ends": ends,
    }


def unpacked(data: bytes, postings: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of a block."""
    gap, tf = data[0], data[1]
    docs = np.cumsum(np.frombuffer(data, f"<u{gap}", postings, 2).astype(np.int64))
    return docs, np.frombuffer(data, f"<u{tf}", postings, 2 + postings * gap).astype(np.int64)


def _shard(number: int, ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard, and a row with its documents: ids in ascending order and lengths."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    # All texts in one buffer, each term with the space behind it: the terms are what lies between their starts.
    joined = np.frombuffer(b"".join([b" ", *[texts[i] + b" " for i in order]]), np.uint8)
    inside = joined != 0x20
    edge = np.append(0, np.cumsum([len(texts[i]) + 1 for i in order]))
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    began = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    doc = np.searchsorted(edge, began - 1, side="right") - 1
    length = np.bincount(doc, minlength=len(ids))
    given = pa.array([ids[i] or 0 for i in order], pa.int64()).to_numpy()
    lost = np.array([ids[i] is None for i in order], np.int8)
    facts = pack(given), pack(lost), pack(length)
    about = b"".join([len(f).to_bytes(8, "little") + f for f in facts])
    rows = {"last": [len(ids)], "postings": [int((length > 0).sum())], "tf": [0], "n": [int(length.sum())]}
    yield _rows(number, pa.array([_DOCS], pa.binary()), rows, pa.array([b""], pa.binary()), pa.array([about], pa.binary()))
    if not len(began):
        return
    offsets = np.append((np.cumsum(keep) - 1)[began], keep.sum()).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(began), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined[keep].tobytes())]
    ).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    posting, tf = np.unique(code * len(ids) + doc, return_counts=True)
    made = _blocks(posting // len(ids), posting % len(ids), tf, length)
    data = pa.Array.from_buffers(
        pa.large_binary(), len(made["ends"]), [None, pa.py_buffer(np.append(0, made["ends"]).astype(np.int64).tobytes()), pa.py_buffer(made["data"].tobytes())]
    )
    spaced = words.dictionary.take(pa.array(made["term"]))
    terms = pc.binary_slice(spaced.cast(pa.binary()), 0, -1)
    yield _rows(number, terms, made, data.cast(pa.binary()), pa.nulls(len(terms), pa.binary()))


def _rows(number: int, terms: pa.Array, made: dict, data: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    narrow = [pa.array(made[c], pa.int32()) for c in ("last", "postings", "tf")]
    arrays = [pa.array(np.full(len(terms), number)), terms, *narrow, pa.array(made["n"], pa.int64()), data, ids]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _INDEX.split(", ")])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored inverted index over all terms of all rows. NULL and empty texts are documents without a term; rows with
    a NULL or repeated id are documents of their own. A shard ends with 2**14 documents or 6 MB of text, so a very
    long text ends one; it has to fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(id_)
                texts.append((text or b"").translate(_FOLD))
                size += len(texts[-1])
                if len(ids) == _SHARD_DOCS or size >= _SHARD_BYTES:
                    yield from _shard(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from _shard(number, ids, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return settled(rows.mapInArrow(run, _INDEX), compression="snappy")


def _impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a frequency in a text of ``n`` terms is worth, before the term's weight."""
    m = 10 + 90 * n * docs // total
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


class _List:
    """A term's postings in a shard: bounds of its blocks, and the blocks themselves, unpacked when asked for."""

    def __init__(self, blocks: pd.DataFrame, lengths: np.ndarray, docs: int, total: int) -> None:
        blocks = blocks.sort_values("last")
        self.last = blocks["last"].to_numpy(np.int64)
        self.weight = int(blocks["w"].iloc[0])
        self.bounds = self.weight * _impact(blocks["tf"].to_numpy(np.int64), blocks["n"].to_numpy(np.int64), docs, total)
        self.bound = int(self.bounds.max())
        self._data, self._sizes = blocks["data"].tolist(), blocks["postings"].tolist()
        self._lengths, self._docs, self._total = lengths, docs, total
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their scores."""
        if b not in self._open:
            found, tf = unpacked(self._data[b], self._sizes[b])
            self._open[b] = found, self.weight * _impact(tf, self._lengths[found], self._docs, self._total)
        return self._open[b]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of documents from ``low`` up to below ``high``, block by block."""
        for b in range(int(np.searchsorted(self.last, low)), len(self.last)):
            found, scores = self.block(b)
            a, z = np.searchsorted(found, [low, high])
            if a < z:
                yield found[a:z], scores[a:z]
            if self.last[b] >= high - 1:
                return


def best_of_shard(lists: list[_List], size: int, k: int, first_range: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents with the highest sums over the lists, best first, equal ones by number; and the sums.

    Documents are taken in ranges, from the lowest number up, so one that only equals the worst of the best so far
    comes behind it and is out: a candidate must beat that score.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.append(0, np.cumsum([x.bound for x in lists]))
    best, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    low, width = 0, first_range
    while low < size:
        high = min(size, low + width)
        worst = int(sums[-1]) if len(sums) == k else 0
        # The first `rest` lists together cannot beat the worst: they are not essential.
        rest = int(np.searchsorted(below[1:], worst, side="right"))
        if rest == len(lists):
            break
        dense = np.zeros(high - low, np.int64)
        for postings in lists[rest:]:
            for found, scores in postings.between(low, high):
                dense[found - low] += scores
        doc = np.flatnonzero(dense)
        score = dense[doc]
        doc += low
        for i in range(rest - 1, -1, -1):
            some = score + below[i + 1] > worst
            doc, score = doc[some], score[some]
            if not len(doc):
                break
            postings = lists[i]
            b = np.searchsorted(postings.last, doc)
            bound = np.append(postings.bounds, 0)[b]
            alive = score + bound + below[i] > worst
            doc, score, b = doc[alive], score[alive], b[alive]
            for one in np.unique(b[b < len(postings.last)]):
                mine = np.flatnonzero(b == one)
                found, scores = postings.block(int(one))
                at = np.minimum(np.searchsorted(found, doc[mine]), len(found) - 1)
                score[mine] += np.where(found[at] == doc[mine], scores[at], 0)
        best, sums = np.concatenate([best, doc[score > worst]]), np.concatenate([sums, score[score > worst]])
        order = np.lexsort((best, -sums))[:k]
        best, sums = best[order], sums[order]
        low, width = high, width * 4
    return best, sums


def _searching(k: int, docs: int, total: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All queries of a block against one shard."""
        about = group.loc[group["term"].map(len) == 0, "ids"].iloc[0]
        facts = []
        while about:
            size = int.from_bytes(about[:8], "little")
            facts.append(unpack(about[8 : 8 + size]))
            about = about[8 + size :]
        ids, lost, lengths = facts[0], facts[1], facts[2].astype(np.int64)
        asked: dict[int, list[_List]] = {}
        for _, blocks in group[group["term"].map(len) > 0].groupby("term", sort=False):
            postings = _List(blocks, lengths, docs, total)
            if postings.bound > 0:
                for item in blocks["items"].iloc[0]:
                    asked.setdefault(item, []).append(postings)
        found = []
        for item, lists in asked.items():
            best, sums = best_of_shard(lists, len(ids), k)
            doc_ids = pd.array(ids[best].astype(np.int64), dtype="Int64")
            doc_ids[lost[best] == 1] = pd.NA
            found.append(pd.DataFrame({"item": item, "doc_id": doc_ids, "place": best, "score": sums}))
        made = pd.concat(found) if found else pd.DataFrame({"item": [], "doc_id": [], "place": [], "score": []})
        return made.assign(shard=group["shard"].iloc[0])

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each row of ``items``: ``(item_id, rank, doc_id, score)``.

    Scores are integers. Equal ones go to the smaller id, documents without an id last. A term counts once for an item,
    whatever its number there. An item that is NULL or has no term, and all items if no document has one,
    find nothing. Rows with a repeated id, on either side, are rows like all others. Texts are read whole. Items are taken in blocks
    of about 1,024, so neither their number nor the corpus is held anywhere; one item's terms and one shard are.
    """
    stored = index(docs, doc_col, text_col)
    facts = stored.where(F.col("term") == F.lit(_DOCS)).agg(F.sum("postings"), F.sum("n"), F.count("*")).first()
    with_terms, total, shards = int(facts[0] or 0), int(facts[1] or 0), facts[2]
    kind, doc_kind = items.schema[item_col].dataType.simpleString(), docs.schema[doc_col].dataType.simpleString()
    if not total:
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank INT, `{doc_col}` {doc_kind}, score BIGINT")
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    asked = settled(asked.withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // _BLOCK_ITEMS))
    words = asked.select("item", F.explode(_distinct_terms("text")).alias("term"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    wanted = words.select(F.col("term").cast("binary").alias("term"), "item", block).groupBy("term", "block")
    wanted = settled(wanted.agg(F.collect_list("item").alias("items")))
    lists = stored.join(wanted.select("term").distinct(), "term")
    weights = lists.groupBy("term").agg(F.sum("postings").alias("df"))
    ratio = F.lit(2 * with_terms + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = weights.select("term", F.floor(1000 * F.log(ratio)).alias("w"))
    wanted = settled(wanted.join(weights, "term"))
    lists = stored.join(wanted, "term").select("shard", "block", "term", "last", "postings", "tf", "n", "data", "ids", "w", "items")
    about = stored.where(F.col("term") == F.lit(_DOCS)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    about = about.withColumns({"w": F.lit(0).cast("bigint"), "items": F.lit(None).cast("array<bigint>")}).select(*lists.columns)
    # A few shards to a task, however many there are: searching is long work on few bytes, by which Spark would deal tasks.
    dealt = lists.unionByName(about).repartition(-(-shards * blocks // _GROUPS_PER_TASK), "shard", "block")
    found = dealt.groupBy("shard", "block").applyInPandas(
        _searching(k, with_terms, total), "item bigint, doc_id bigint, place bigint, score bigint, shard bigint"
    )
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_col), "rank", F.col("doc_id").cast(doc_kind).alias(doc_col), "score"
    )


def _distinct_terms(text: str) -> Column:
    """The terms of a text, each once: runs of letters and digits of ASCII and of any other characters."""
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
