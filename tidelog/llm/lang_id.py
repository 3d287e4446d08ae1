"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes, counted on lower-cased text. A byte costs
``-log2(count / (n + q))`` bits in the longest context that has seen it, n being the context's total and q
its distinct bytes, plus the escape ``-log2(q / (n + q))`` of every longer known context that has not
(method C); a byte no context knows costs 8 bits. Statistics are frozen after training, so a text's code
length is a sum of table entries: all escapes are resolved in advance. The language with the shortest
code wins.

Training takes a bounded sample: ``sample_docs`` labelled documents of each language, of any length. Of the three-byte contexts of each
language the ``max_contexts`` most frequent are kept; others fall back to two bytes. So each language has a model of its own, of a
size that depends neither on the corpus nor on the other languages: 12 MB at most.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import held_out, map_batches, map_texts

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LEAD = b"\n\n\n"
_PIECE = 1 << 16


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(_LEAD + text.lower().encode(), np.uint8)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct four-byte strings of a text, as numbers, and their counts, piece by piece."""
    data, found, times = _bytes(text), np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(3, len(data), _PIECE):
        b = data[start - 3 : start + _PIECE].astype(np.int64)
        more, n = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)
        found, inverse = np.unique(np.concatenate([found, more]), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([times, n])).astype(np.int64)
    return found, times


@dataclass(frozen=True)
class ContextTree:
    """``costs[node * 256 + byte]`` has the bits of a byte. A node is found by the last three bytes: ``pairs`` numbers the
    first two, ``deep`` has the node of a numbered pair and the third byte, or -1, and then ``shallow`` has that of the last two
    bytes."""

    pairs: np.ndarray
    deep: np.ndarray
    shallow: np.ndarray
    costs: np.ndarray


@dataclass(frozen=True)
class ContextTrees:
    langs: list[str]
    trees: list[ContextTree]

    def bits(self, text: str) -> np.ndarray:
        """Code length of a text in every language."""
        data = _bytes(text)
        total = np.zeros(len(self.langs))
        for start in range(3, len(data), _PIECE):
            b = data[start - 3 : start + _PIECE].astype(np.int32)
            first, last, third, byte = b[:-3] << 8 | b[1:-2], b[1:-2] << 8 | b[2:-1], b[2:-1], b[3:]
            for i, tree in enumerate(self.trees):
                node = tree.deep[tree.pairs[first] << 8 | third]
                node = np.where(node < 0, tree.shallow[last], node)
                total[i] += tree.costs[node << 8 | byte].sum(dtype=np.float64)
        return total


def build_tree(keys: np.ndarray, counts: np.ndarray, max_contexts: int) -> ContextTree:
    """The tree of a language from its four-byte strings (as big-endian numbers) and their counts."""
    contexts, inverse = np.unique(keys >> 8, return_inverse=True)
    often = np.bincount(inverse, counts)
    kept = np.sort(contexts[np.lexsort((contexts, -often))[:max_contexts]])
    two = np.unique(keys >> 8 & 0xFFFF)
    # Nodes: 0 to 255 the one-byte contexts, then two-byte ones, then three-byte ones.
    shallow = np.tile(np.arange(256, dtype=np.int32), 256)
    shallow[two] = 256 + np.arange(len(two))
    pairs, firsts = np.zeros(1 << 16, np.int32), np.unique(kept >> 8)
    pairs[firsts] = 1 + np.arange(len(firsts))
    deep = np.full((len(firsts) + 1) << 8, -1, np.int32)
    deep[pairs[kept >> 8] << 8 | kept & 0xFF] = 256 + len(two) + np.arange(len(kept))

    def resolved(contexts: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
        """Costs of every byte in each context, given those in the contexts one byte shorter."""
        at = np.full(1 << 8 * order, -1, np.int64)
        at[contexts] = np.arange(len(contexts))
        row = at[keys >> 8 & (1 << 8 * order) - 1]
        seen = np.zeros((len(contexts), 256))
        np.add.at(seen, (row[row >= 0], (keys & 0xFF)[row >= 0]), counts[row >= 0])
        n, q = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(q / (n + q)), 0)
            return np.where(seen > 0, -np.log2(seen / (n + q)), escape + lower)

    zero = resolved(np.zeros(1, np.int64), 0, np.full((1, 256), 8.0))
    one = resolved(np.arange(256), 1, zero)
    below = np.concatenate([one, resolved(two, 2, one[two & 0xFF])])
    triple = resolved(kept, 3, below[shallow[kept & 0xFFFF]])
    return ContextTree(pairs, deep, shallow, np.concatenate([below, triple]).astype(np.float32).ravel())


def build_trees(grams: dict[str, tuple[np.ndarray, np.ndarray]], max_contexts: int) -> ContextTrees:
    langs = sorted(grams)
    return ContextTrees(langs, [build_tree(*grams[lang], max_contexts) for lang in langs])


def train(
    docs: DataFrame,
    usable: Column,
    sample_docs: int = 300,
    max_contexts: int = 8_192,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> ContextTrees:
    """Trees of all languages among the ``usable`` rows with an id, a text and a language."""
    rows = docs.where(usable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "hash")
    # Spark keeps the first rows of every task only, so a large language is no large shuffle. The result
    # has sample_docs rows a language at most, whatever the corpus, and can be broadcast.
    known = ["id", "lang", "hash"]
    sample = rows.select(*known).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
    texts = rows.join(F.broadcast(sample.select(*known).distinct()), known)
    # A row that is repeated counts once, however often it is there.
    texts = texts.groupBy(*known).agg(F.first("text").alias("text"))

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, times = _grams(text)
                langs += [lang] * len(found)
                grams.append(found)
                counts.append(times)
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(langs, pa.string()),
                    "gram": pa.array(np.concatenate([*grams, np.empty(0, np.int64)])),
                    "n": pa.array(np.concatenate([*counts, np.empty(0, np.int64)])),
                }
            )

        return apply

    counted = map_batches(texts.select("lang", "text"), start, "lang string, gram bigint, n bigint")
    # As many rows as the sample has distinct four-byte strings.
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (found.column(i).to_numpy() for i in range(3))
    return build_trees({x: (gram[lang == x], n[lang == x].astype(float)) for x in set(lang)}, max_contexts)


def predict(docs: DataFrame, trees: ContextTrees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``, row by row.

    ``score`` is the probability of the language given the code lengths, all languages being equally
    likely before. Ties go to the name that sorts first. A text that is NULL or has no letter, and every text
    if no language was learned, is ``und`` with score 0 and NULL bits. Only the text is looked at.
    """
    parts = [[t.pairs, t.deep, t.shallow, t.costs] for t in trees.trees]
    shared = docs.sparkSession.sparkContext.broadcast([trees.langs, parts])

    def start():
        langs, parts = shared.value
        trees = ContextTrees(langs, [ContextTree(*p) for p in parts])

        def one(text: str | None) -> tuple[str, float, float | None]:
            if not text or not trees.langs or not _LETTER.search(text):
                return UNKNOWN, 0.0, None
            bits = trees.bits(text)
            best = int(bits.argmin())
            return trees.langs[best], float(1 / np.exp2(bits[best] - bits).sum()), float(bits[best] / len(text.encode()))

        def apply(texts: list) -> dict[str, pa.Array]:
            lang, score, bits = zip(*map(one, texts), strict=True)
            return {
                "lang_pred": pa.array(lang, pa.string()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(bits, pa.float64()),
            }

        return apply

    return map_texts(docs, start, "lang_pred string, score double, bits_per_byte double", text_col, keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all: id, the columns of :func:`predict` and ``held_out``."""
    trees = train(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, trees, text_col, [id_col]).withColumn("held_out", held_out(id_col))
