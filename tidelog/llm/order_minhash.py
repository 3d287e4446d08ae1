"""Document fingerprints by Order MinHash, in DataFrame operations only.

Marcais and others, "Locality-sensitive hashing for the edit distance" (2019). A text is a sequence of tokens
(a word of up to 16 characters with the white space behind it; of a longer run each character before the last 16),
its k-mers are ``k`` tokens in a row. Where tokens begin depends on the 16 characters ahead only, so an edit changes
none further on. Equal k-mers are told apart by their occurrence number. The numbered k-mers are put on a circle by
their hash, on which each of 64 slots has its own starting point; a slot selects the ``keep`` k-mers that come next from there, puts them
back in text order, and hashes them as a tuple. Two texts agree in a slot if they select the same k-mers in the same order, so
the share of equal slots falls with the edit distance, and moving passages lowers it as well.

Which k-mers come next from a point is as random as which have the smallest hashes under a function of the slot's own, so each slot agrees
with the same probability, whatever the length of the texts. One hash per k-mer serves all slots, though, instead of one
per k-mer and slot: slots of a short text often select the same k-mers, and its likeness varies more.

Hashes and positions are packed into numbers, so that sorting an array of numbers is all it takes to bring equal
k-mers together and to select the smallest: top bits decide, the lowest 28 bits are the position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import settled

_POSITION_BITS = 28
_SLOT_BITS = 6
_ROWS_PER_BLOCK = 256
_MOST_BLOCKS = 1 << 20
_QUANTILES = 64


@dataclass(frozen=True)
class OrderMinHash:
    k: int = 3
    keep: int = 2


def _sketch(df: DataFrame, text: str, out: str, spec: OrderMinHash) -> DataFrame:
    """``df`` with column ``out``: for each slot, slot number (upper half) and hash of its tuple; nothing for an empty text.

    Each step is a column of its own. The row number keeps the optimizer from merging steps: it would put one
    step inside a function that runs per element, and compute it for every element.
    """
    mask, k, keep = (1 << _POSITION_BITS) - 1, spec.k, spec.keep
    token = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(r"\S{1,16}+(?!\S)\s*|\S|\s+"), F.lit(0)), lambda t: F.xxhash64(t)
    )
    df = df.withColumn("_row", F.monotonically_increasing_id())
    own = df.columns
    df = df.select(*own, token.alias("_t"))
    too_long = F.raise_error(F.lit(f"a text of {1 << _POSITION_BITS} tokens or more has no fingerprint"))
    df = df.select(*own, F.when(F.size("_t") < 1 << _POSITION_BITS, F.col("_t")).otherwise(too_long.cast("array<bigint>")).alias("_t"))
    # A text of fewer than k tokens is one k-mer; an empty one has none.
    kmer = F.expr(f"transform(sequence(0, greatest(size(_t) - {k}, 0)), i -> xxhash64({', '.join(f'get(_t, i + {j})' for j in range(k))}))")
    df = df.select(*own, F.when(F.size("_t") > 0, kmer).otherwise(F.expr("CAST(array() AS array<bigint>)")).alias("_k"))
    runs = F.expr(f"transform(_k, (h, i) -> shiftleft(h, {_POSITION_BITS}) | i)")
    df = df.select(*own, "_k", F.sort_array(runs).alias("_s"))
    # Where the runs of equal k-mers begin, then the occurrence number of every sorted k-mer.
    same = f"shiftright(x, {_POSITION_BITS}) = shiftright(get(_s, i - 1), {_POSITION_BITS})"
    df = df.select(*own, "_k", "_s", F.expr(f"filter(transform(_s, (x, i) -> IF(i > 0 AND {same}, NULL, i)), i -> i IS NOT NULL)").alias("_r"))
    number = F.expr("flatten(transform(_r, (b, j) -> sequence(1, coalesce(get(_r, j + 1), size(_s)) - b)))")
    df = df.select(*own, "_k", "_s", number.alias("_n"))
    dealt = F.expr(
        f"zip_with(_s, _n, (x, n) -> (xxhash64(shiftright(x, {_POSITION_BITS}), n) & {~mask}L) | (x & {mask}L))"
    )
    df = df.select(*own, "_k", F.sort_array(dealt).alias("_d"))
    # The hashes are a circle, a slot starts at a point of it and selects the next ``keep`` from there on. Slots with no
    # hash of their own select what the next one does, so there are as many tuples as slots with one.
    slot = 64 - _SLOT_BITS
    first = f"i = 0 OR shiftright(get(_d, i - 1), {slot}) != shiftright(x, {slot})"
    df = df.select(*own, "_k", "_d", F.expr(f"filter(transform(_d, (x, i) -> IF({first}, i, NULL)), i -> i IS NOT NULL)").alias("_f"))
    selected = f"transform(sequence(0, least({keep}, size(_d)) - 1), j -> get(_d, (i + j) % size(_d)) & {mask}L)"
    value = f"xxhash64(transform(sort_array({selected}), p -> get(_k, CAST(p AS int)))) & 4294967295L"
    df = df.select(*own, "_d", "_f", F.expr(f"transform(_f, i -> {value})").alias("_v"))
    low, high = -(1 << _SLOT_BITS - 1), (1 << _SLOT_BITS - 1) - 1
    at = f"CAST(shiftright(get(_d, get(_f, {{}})), {slot}) AS int)"
    own_slots = f"flatten(transform(_v, (v, t) -> array_repeat(v, {at.format('t')} - coalesce({at.format('t - 1')}, {low - 1}))))"
    around = f"array_repeat(get(_v, 0), {high} - {at.format('size(_f) - 1')})"
    every = f"transform(concat({own_slots}, {around}), (v, j) -> shiftleft(CAST(j + {low} AS bigint), 32) | v)"
    sketch = F.expr(f"IF(size(_d) > 0, {every}, CAST(array() AS array<bigint>))")
    return df.select(*own, sketch.alias(out)).drop("_row")


def likeness(a: str, b: str) -> Column:
    """Share of equal slots; 1 if both texts are empty, 0 if one of them is."""
    used = F.size(F.expr(f"array_union(transform({a}, v -> shiftright(v, 32)), transform({b}, v -> shiftright(v, 32)))"))
    return F.when(used > 0, F.size(F.array_intersect(a, b)) / used).otherwise(F.lit(1.0))


def as_text(sketch: str) -> Column:
    """Ten hex digits per slot: two of the slot, eight of the tuple."""
    shift = (1 << (_SLOT_BITS - 1)) << 32  # slots are signed
    return F.expr(f"array_join(transform({sketch}, v -> lpad(lower(hex(v + {shift}L)), 10, '0')), '')")


def fingerprints(
    docs: DataFrame, spec: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, sketch array<bigint>)``, one row per row of ``docs``; NULL and empty texts have an empty sketch.

    Texts that are equal have equal sketches. Ids may be NULL or repeated; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _sketch(texts, "text", "sketch", spec).select(F.col("id").alias(id_col), "sketch")


def _block(rows: DataFrame, n: int) -> Column:
    """Number of a block of about _ROWS_PER_BLOCK of the ``n`` rows; never falls as their ``place`` rises.

    Quantiles of the places are joined by straight lines, so the blocks are even for any smooth
    distribution. The blocks are at most _MOST_BLOCKS, so a row for each can be broadcast.
    """
    place = F.col("place")
    blocks = min(_MOST_BLOCKS, max(1, -(-n // _ROWS_PER_BLOCK)))
    marks = sorted(set(rows.approxQuantile("place", [i / _QUANTILES for i in range(_QUANTILES + 1)], 0.002)))
    if blocks == 1 or len(marks) < 2:
        return F.lit(0).cast("bigint")
    per = max(1, -(-blocks // (len(marks) - 1)))
    number = F.lit(0).cast("bigint")
    for i, (low, high) in enumerate(zip(marks, marks[1:], strict=False)):
        inside = F.least(F.floor((place - low) / (high - low) * per), F.lit(per - 1))
        number = F.when(place >= low, i * per + F.greatest(inside, F.lit(0))).otherwise(number)
    return number


def with_next(docs: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``docs`` with ``next_<column>`` of the row with the next smaller key; after the smallest the largest.

    Equal keys are ordered by a hash of the first column, then by the columns; NULL keys come last. Rows are shuffled once, to
    their block of keys and hashes, so rows that share a key, or have none, are spread over blocks unless the first
    column is the same as well. A block's largest row is also sent to the block above it, as a guest that only serves as next row.
    """
    least, n = docs.agg(F.min(F.col(key).cast("bigint")), F.count("*")).first()
    # Up to here keys are exact as doubles, and hashes count beside them.
    exact = 1 << 53
    none = least - 1 if least is not None and least > -exact else -(2**63) if least is not None else 0
    rows = docs.withColumns({"key": F.coalesce(F.col(key).cast("bigint"), F.lit(none).cast("bigint")), "tie": F.xxhash64(columns[0])})
    beside = F.when(F.col("key").between(-exact, exact), F.col("tie").cast("double")).otherwise(F.lit(0.0))
    rows = rows.withColumn("place", F.col("key").cast("double") * 2.0**64 + beside)
    keys = rows.select("key", "tie", "place")
    block = _block(keys, n)
    head = F.max(F.struct("key", "tie")).alias("head")
    heads = settled(keys.groupBy(block.alias("block")).agg(head).select("block", "head.key", "head.tie"))
    # _MOST_BLOCKS rows at most, with three numbers each.
    order = Window.orderBy("block")
    above = heads.select(
        "key", "tie", F.coalesce(F.lead("block").over(order), F.min("block").over(order)).alias("above")
    )
    guests = F.broadcast(settled(above))
    placed = rows.withColumn("own", block).join(guests, ["key", "tie"], "left")
    homes = F.when(F.col("above").isNull(), F.array(F.struct(F.lit(False).alias("guest"), F.col("own").alias("block")))).otherwise(
        F.array(
            F.struct(F.lit(False).alias("guest"), F.col("own").alias("block")),
            F.struct(F.lit(True).alias("guest"), F.col("above").alias("block")),
        )
    )
    placed = placed.withColumn("home", F.explode(homes)).select(*docs.columns, "key", "tie", "home.guest", "home.block")
    down = Window.partitionBy("block").orderBy("guest", F.col("key").desc(), F.col("tie").desc(), *columns)
    ahead = [F.lead(c).over(down).alias(f"next_{c}") for c in columns]
    return placed.select(*docs.columns, "guest", *ahead).where("NOT guest").drop("guest")


def compare_edited(
    docs: DataFrame, spec: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of texts and of edited texts, whose second half (rounded down) is that much of the start of
    the next text in descending id. ``(id, n_chars, edited, sketch, edited_sketch, near_edited, near_next)``.

    A NULL text is an empty one. A single text is its own next one. Rows that share an id come in the order of a hash of their texts, rows without an
    id after all others.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(_sketch(texts, "text", "sketch", spec), ["text", "sketch"])
    half = F.expr("CAST(floor(length(text) / 2) AS int)")
    edited = F.expr("concat(substring(text, 1, _n - _h), substring(next_text, 1, _h))")
    rows = rows.select("id", "sketch", "next_sketch", "text", "next_text", F.length("text").alias("_n"), half.alias("_h"))
    rows = rows.select("id", "sketch", "next_sketch", F.col("_n").cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = _sketch(rows, "edited", "edited_sketch", spec)
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
