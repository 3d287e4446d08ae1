"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

1. Every benchmark item has a SimHash of its words (64 bits, a word counts as often as it occurs).
2. A text's windows have the length of an item and lie where one of the item's shingles occurs at the same offset; a
   window without any shingle of an item has similarity 0 with it, so it is never needed. Shingles of texts pass a Bloom filter
   of bounded size in the scan, and those that pass are joined with the items' own, so the texts are read once whatever the
   size of the benchmark. Equal windows are one from here on, so a passage in many documents costs no more than in one.
3. Fingerprints of windows and of items are cut into blocks. Two that differ in ``radius`` bits at most differ in
   ``radius // blocks`` bits at most in one of the blocks, so items are entered under every value that near to their own in
   every block, and a window that looks up its blocks meets all items of its length within the radius.
4. Candidates within the radius are verified by their exact similarity of shingles weighted by how often they occur: the sum of
   smaller counts over the sum of larger ones.

Texts are not shuffled, only windows are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bloom import bloom_of
from tidelog.llm.common import settled


@dataclass(frozen=True)
class Decontam:
    """``radius`` in bits of 64, looked up by ``blocks``. A shingle of more than ``common`` items starts no window for an item
    that has rarer ones enough. ``filter_words`` bounds the Bloom filter, in words of 64 bits."""

    words: int = 5
    percent: int = 80
    radius: int = 18
    blocks: int = 5
    common: int = 64
    filter_words: int = 1 << 16


#: Scripts without spaces between words: each character is a word, with its marks.
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_WORD = rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+|[\p{{L}}\p{{N}}&&[{_UNSPACED}]]\p{{M}}*"


def _word_hashes(text: str) -> Column:
    """Hashes of the words, runs of letters and digits in lower case or single characters of unspaced scripts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.transform(F.coalesce(words, F.array()), lambda w: F.xxhash64(w))


def _shingles(words: str, k: int, least: int = 1) -> Column:
    """Hashes of k words in a row. Fewer words, but no fewer than ``least``, are one shingle: NULLs do not
    change a hash."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    found = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]))
    return F.when(F.size(words) >= least, found).otherwise(F.array().cast("array<bigint>"))


def _simhash(words: str) -> Column:
    """Bit b is set if more words have it set in their hash than not."""
    one = F.lit(1).cast("bigint")

    def vote(b: Column) -> Column:
        is_set = lambda w: F.call_function("shiftright", w, b).bitwiseAND(one) == 1
        return F.aggregate(words, F.lit(0), lambda votes, w: votes + F.when(is_set(w), 1).otherwise(-1))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda bits, b: bits.bitwiseOR(F.when(vote(b) > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0))),
    )


def _similarity(a: str, b: str) -> Column:
    times = lambda array, s: F.size(F.filter(array, lambda x: x == s))
    total = lambda pick: F.aggregate(
        F.array_union(a, b), F.lit(0), lambda sum_, s: sum_ + pick(times(a, s), times(b, s))
    )
    return total(F.least) / total(F.greatest)


def _cuts(spec: Decontam) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [64 * i // spec.blocks for i in range(spec.blocks + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def _block_values(hash_: str, spec: Decontam) -> Column:
    """The blocks of a fingerprint, in order."""
    return F.array(*[F.shiftrightunsigned(hash_, a).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) for a, width in _cuts(spec)])


def _near_values(hash_: str, spec: Decontam) -> Column:
    """For each block the values that differ from the fingerprint's in few enough bits."""

    def near(i: int, width: int) -> Column:
        flips = [x for x in range(1 << width) if x.bit_count() <= spec.radius // spec.blocks]
        return F.expr(f"transform(array({', '.join(f'{x}L' for x in flips)}), x -> x ^ _b[{i}])")

    return F.array(*[near(i, width) for i, (_, width) in enumerate(_cuts(spec))])


def _seeds(items: DataFrame, spec: Decontam) -> DataFrame:
    """``(shingle, length, offset)`` where windows start.

    A window of the wanted similarity has shingles in common with the item that weigh at least that share of the item's.
    So the most common shingles of an item can be left out, as long as they weigh less than that together.
    """
    places = items.select("item", "length", F.size("item_shingles").alias("n"), F.posexplode("item_shingles").alias("offset", "shingle"))
    owners = places.groupBy("shingle").agg(F.countDistinct("item").alias("owners"))
    hottest = Window.partitionBy("item").orderBy(F.desc("owners"), "shingle", "offset").rowsBetween(Window.unboundedPreceding, 0)
    ranked = places.join(owners, "shingle").withColumn("left_out", F.count("*").over(hottest))
    spared = (F.col("owners") > spec.common) & (F.col("left_out") * 100 < spec.percent * F.col("n"))
    return ranked.where(~spared).select("shingle", "length", "offset").distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    spec: Decontam = Decontam(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, item, start, n_words, hamming, similarity)``: for every text and item with a window of similarity
    ``percent`` or more whose fingerprint is within the radius, the best window (the first of equals), in words. Ids keep
    their names.

    NULL and empty texts match nothing, nor do items without a word. An item of fewer than ``words`` words is one
    shingle, found where all its words stand in a row. A window that would reach over an end of the text is moved inside, and is the whole
    text if that is shorter than the item. Long texts are looked at whole. Rows that repeat an id are looked at one by one and reported
    once; rows without an id are reported under NULL. Other columns are not read.
    """
    k = spec.words
    items = (
        benchmark.select(F.col(item_col).alias("item"), _word_hashes(item_text_col).alias("w"))
        .where(F.size("w") > 0)
        .select("item", "w", F.size("w").alias("length"), _shingles("w", k).alias("item_shingles"), _simhash("w").alias("item_hash"))
    )
    items = settled(items.withColumn("nth", F.monotonically_increasing_id()))
    seeds = settled(_seeds(items.drop("item").withColumnRenamed("nth", "item"), spec))
    passes = bloom_of(seeds.select("shingle").distinct(), spec.filter_words).passes("h")
    longest = items.agg(F.max("length")).first()[0] or 0
    short = sorted(row[0] for row in items.where(F.col("length") < k).select("length").distinct().collect())  # under k rows
    # The row number keeps the optimizer from moving a step into a function that runs per element, or a
    # filter below it: either would compute the words again for every element.
    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _word_hashes(text_col).alias("w"))
    texts = texts.select("id", "row", "w", _shingles("w", k, k).alias("s"), *[_shingles("w", n, n).alias(f"s{n}") for n in short])

    hit = "filter(transform({0}, (h, i) -> IF({1}{2}, struct(h AS shingle, i AS at), NULL)), x -> x IS NOT NULL)"
    # All windows of a short item are alike: the first is the best.
    first = [hit.format(f"s{n}", passes, f" AND array_position(s{n}, h) = i + 1") for n in short]
    hits = F.expr(f"concat({', '.join([hit.format('s', passes, ''), *first])})")
    found = texts.select("id", "row", "w", hits.alias("hits"))
    found = found.select("id", "row", "w", F.explode("hits").alias("hit"))
    # Around a hit as many words as any window there can have.
    low = F.greatest(F.col("hit.at") - longest, F.lit(0))
    found = found.select("id", "row", F.size("w").alias("n"), "hit.shingle", "hit.at", low.alias("low"), F.slice("w", low + 1, 2 * longest + k).alias("near"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("n") - F.col("length")))
    found = (
        found.join(seeds, "shingle")
        .select("id", "row", start.alias("start"), "length", F.slice("near", start - F.col("low") + 1, F.col("length")).alias("w"))
        .distinct()
    )
    found = settled(found)
    windows = settled(found.select("length", "w").distinct().withColumn("window", F.monotonically_increasing_id()))
    prints = settled(windows.select("window", "length", _simhash("w").alias("hash"), _shingles("w", k).alias("s")))

    looked_up = prints.select("window", "length", F.posexplode(_block_values("hash", spec)).alias("block", "value"))
    entered = items.select("nth", "length", "item_hash", _block_values("item_hash", spec).alias("_b"))
    entered = entered.select("nth", "length", F.posexplode(_near_values("item_hash", spec)).alias("block", "values"))
    # A table, as Spark would take the rows of an explode for as few as those before it, and broadcast them.
    entered = settled(entered.select("nth", "length", "block", F.explode("values").alias("value")))
    met = looked_up.join(entered, ["length", "block", "value"]).select("window", "nth").distinct()
    hamming = F.bit_count(F.col("hash").bitwiseXOR(F.col("item_hash")))
    candidates = met.join(prints.drop("length"), "window").join(items.select("nth", "item", "item_shingles", "item_hash"), "nth")
    candidates = candidates.withColumn("hamming", hamming).where(F.col("hamming") <= spec.radius)
    similar = candidates.select("window", "item", "hamming", _similarity("s", "item_shingles").alias("similarity"))
    similar = settled(similar.where(F.col("similarity") * 100 >= spec.percent))
    best = F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return (
        found.select("id", "start", "length", F.size("w").alias("n_words"), "w")
        .join(windows, ["length", "w"])
        .join(similar, "window")
        .groupBy("id", "item")
        .agg(best.alias("best"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*")
    )
