"""Exact top-k search, centroid clustering and ranked lexical search: against SQL on whole tables and against brute force
on awkward rows, and that each works by its method."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF_DIR
from tidelog.llm import lexical, topk_search
from tidelog.llm.centroids import candidates, cluster, hilbert_keys, nearest
from tidelog.llm.lexical import best_of_shard, search, unpacked
from tidelog.llm.oracles import ORACLES
from tidelog.llm.packed import pack, unpack
from tidelog.llm.queries import QUERIES
from tidelog.llm.topk_search import exact_top_k

VECTORS = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, id BIGINT, row STRING, score STRING, rank INT"


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_centroids", "op13_ranked_search"])
def test_whole_tables_agree_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = duck.execute(ORACLES[name])
    got = QUERIES[name](spark, SF_DIR)
    assert got.columns == [c[0] for c in cursor.description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(cursor.fetchall())


def test_numbers_survive_packing():
    for numbers in ([], [0, -1, 127], [-129, 5], [1 << 20], [-(1 << 62), 1 << 62]):
        data = pack(np.array(numbers, np.int64))
        assert unpack(data).tolist() == numbers
    assert len(pack(np.arange(100))) == 101


# Exact top-k search


def awkward_vectors(spark):
    """Ties, repeated rows and ids, missing ids and components, other lengths."""
    dice = random.Random(5)
    rows = [(i, [dice.choice([0.0, 0.0, 0.25, -0.5, 1 / 3, 7.0]) for _ in range(6)]) for i in range(1, 70)]
    rows += [(20, [1.0] * 6), (20, [1.0] * 6), (40, []), (41, [3.0]), (60, [0.5] * 9), (None, [2.0] * 6), (None, [2.0] * 6)]
    rows += [(80, None), (81, [1.0, None]), (100, [float("nan")] * 6), (101, [float("inf")] * 6), (120, [0.0] * 6), (140, [-1e-9] * 6)]
    return rows, spark.createDataFrame([(i, v, 1, 2, "r", "s", 3) for i, v in rows], VECTORS).repartition(5)


def brute_top_k(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = Counter()
    for at, (i, q) in enumerate(whole):
        if i is None or i % 20:
            continue
        others = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j) for n, (j, v) in enumerate(whole) if n != at]
        for rank, (score, _, j) in enumerate(sorted(others, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            expected[(i, rank, j, -score)] += 1
    return expected


@pytest.mark.parametrize("sizes", [(4096, 256), (7, 2)])
def test_top_k_agrees_with_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk_search, "_SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk_search, "_BLOCK_ROWS", sizes[1])
    rows, vectors = awkward_vectors(spark)
    asks = F.col("vec_id") % 20 == 0
    for k in (1, 5, 500):
        got = exact_top_k(vectors, asks, k)
        assert Counter(tuple(r) for r in got.collect()) == brute_top_k(rows, k)
    assert exact_top_k(vectors.limit(0), asks, 3).collect() == []
    assert exact_top_k(vectors, F.lit(False), 3).collect() == []


def test_top_k_of_large_numbers_is_exact_or_an_error(spark):
    rows = [(20, [2.0**24, 1.0]), (1, [2.0**24, 1 / 64]), (2, [2.0**24, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2, "r", "s", 3) for i, v in rows], VECTORS)
    got = exact_top_k(vectors, F.col("vec_id") % 20 == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**60 + 64), (2, 2**60)]
    huge = spark.createDataFrame([(i, [1e12, 1.0], 1, 2, "r", "s", 3) for i in (20, 21)], VECTORS)
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_top_k(huge, F.col("vec_id") % 20 == 0, 2).collect()


def test_every_block_meets_every_shard_without_a_shuffle(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    plan = exact_top_k(vectors, F.col("vec_id") % 20 == 0, 20)._jdf.queryExecution().executedPlan().toString()
    assert re.search("BroadcastNestedLoopJoin|CartesianProduct", plan) and "WindowGroupLimit" in plan
    assert plan.count("Exchange hashpartitioning") == 1


# Centroid clustering


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2), (7, 1)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(dims, bits):
    side = 1 << bits
    cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(side)] * dims, indexing="ij")], axis=1)
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == side**dims
    walked = cells[np.argsort(np.array(keys, dtype=object))]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_bounds_never_lose_the_nearest_centroid():
    dice = np.random.default_rng(1)
    pruned = 0
    for _ in range(300):
        centroids = dice.integers(-40, 40, (8, 3))
        if dice.random() < 0.3:
            centroids[5] = centroids[2]
        v = dice.integers(-40, 40, 3) + dice.integers(-4, 5, (20, 3))
        numbers = candidates(v.min(0), v.max(0), centroids)
        exact = ((v[:, None, :] - centroids) ** 2).sum(2)
        of, squared = nearest(v, centroids, numbers)
        assert of.tolist() == exact.argmin(1).tolist() and squared.tolist() == exact.min(1).tolist()
        pruned += 8 - len(numbers)
    assert pruned > 300


def test_distances_beyond_doubles_are_exact():
    v = np.array([[(1 << 26) + 1] * 64, [-(1 << 26)] * 64])
    of, squared = nearest(v, np.array([[0] * 64, [1 << 26] * 64]), np.arange(2))
    assert of.tolist() == [1, 0] and squared.tolist() == [64, 64 << 52]


def brute_clusters(rows, k, rounds, dims):
    def scaled(v):
        return [math.floor(1024 * x) for x in v]

    kept = [(i, scaled(v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]

    def assign():
        distances = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in distances]

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (x, _) in zip(kept, of, strict=True) if x == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = assign()
    sums = Counter()
    for c, d in of:
        sums[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, sums[c], sum(sums.values()), digest[c]) for (i, _), (c, d) in zip(kept, of, strict=True))


def test_clusters_agree_with_brute_force(spark):
    dice = random.Random(9)
    rows = [(i, [dice.gauss(3 * (i % 4), 1), dice.gauss(i % 3, 1), -0.5]) for i in range(400)]
    # A third of all rows is one vector; some ids are repeated or missing.
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)] + [(7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (None, [0.0, 0.0, 0.0])]
    rows += [(5000, None), (5001, [1.0]), (5002, [1.0, None, 2.0]), (5003, [float("inf")] * 3), (5004, [1.0] * 4)]
    vectors = spark.createDataFrame([(i, v, 1, 2, "r", "s", 3) for i, v in rows], VECTORS).repartition(4)
    got = cluster(vectors, k=5, rounds=6, dims=3)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 5, 6, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-4.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2, "r", "s", 3) for i, v in rows], VECTORS)
    assert Counter(tuple(r) for r in cluster(vectors, k=8, rounds=3, dims=2).collect()) == brute_clusters(rows, 8, 3, 2)
    none = cluster(vectors.limit(0), dims=2)
    assert none.collect() == [] and none.columns == cluster(vectors, dims=2).columns
    assert cluster(vectors, dims=64).collect() == []


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    expected = Counter()
    for item, text in items:
        scored = []
        for at, (i, c) in enumerate(held):
            score = 0
            for t in set(terms(text)) & set(c):
                m = 10 + 90 * sum(c.values()) * n_docs // total
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, at, i))
        for rank, (score, _, _, _, i) in enumerate(sorted(scored)[:k], 1):
            expected[(item, rank, i, -score)] += 1
    return expected


def awkward_texts():
    dice = random.Random(2)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = []
    for i in range(700):
        words = dice.choices(common, k=dice.randint(0, 30)) + dice.choices(rare, k=dice.randint(0, 4))
        dice.shuffle(words)
        docs.append((i // 2 if i % 50 == 0 else i, " ".join(words)))
    docs += [(9000 + i, "w1 w2 copied text w1") for i in range(250)]
    docs += [(None, "r1 w1 Straße ÉTÉ été"), (None, None), (9999, None), (9998, ""), (9997, " \t\n.,;!"), (9996, "W1,w2;R7-r7_r7 " * 3000)]
    docs += [(9995, "東京 タワー w3"), (9994, "été Straße STRASSE"), (9993, "\x7fr9\x00r9")]
    items = [(1, "w1 w2 r7"), (2, "R1 r1 ÉTÉ"), (3, "nothing here"), (4, None), (5, ""), (None, "東京 w3"), (6, "w1"), (6, "r9 w1 w1")]
    items += [(10 + i, " ".join(dice.choices(common + rare, k=20))) for i in range(20)]
    return docs, items


@pytest.mark.parametrize(("postings", "shard", "block"), [(128, 1 << 14, 1024), (4, 60, 5)])
def test_search_agrees_with_brute_force(spark, monkeypatch, postings, shard, block):
    monkeypatch.setattr(lexical, "_POSTINGS", postings)
    monkeypatch.setattr(lexical, "_SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "_BLOCK_ITEMS", block)
    docs, items = awkward_texts()
    stored = spark.createDataFrame([(i, t, "e", "s", 1, "i", 2) for i, t in docs], "doc_id BIGINT, text STRING, term STRING, shard STRING, item INT, id STRING, score INT")
    asked = spark.createDataFrame([(i, t, 3, "x") for i, t in items], "item_id BIGINT, text STRING, item INT, doc_id STRING")
    assert Counter(tuple(r) for r in search(stored.repartition(3), asked, k=10).collect()) == brute_search(docs, items, 10)
    assert search(stored.limit(0), asked).collect() == [] and search(stored, asked.limit(0)).collect() == []
    assert search(stored.where("text IS NULL"), asked).collect() == []


def made_lists(rows, lengths, docs, total):
    """Lists of a shard from rows of (weight, {document: frequency})."""
    lists = []
    for weight, held in rows:
        doc = np.array(sorted(held), np.int64)
        made = lexical._blocks(np.zeros(len(doc), np.int64), doc, np.array([held[d] for d in doc], np.int64), lengths)
        edges = np.append(0, made["ends"])
        data = [made["data"][a:z].tobytes() for a, z in zip(edges, edges[1:], strict=False)]
        frame = pd.DataFrame({c: made[c] for c in ("last", "postings", "tf", "n")}).assign(data=data, w=weight)
        lists.append(lexical._List(frame, lengths, docs, total))
    return lists


def test_blocks_come_back(monkeypatch):
    dice = np.random.default_rng(3)
    for most in (3, 300, 70_000, 1 << 34):
        doc = np.unique(dice.integers(0, 1 << 20, 1000))
        tf = dice.integers(1, most, len(doc))
        made = lexical._blocks(np.arange(len(doc)) // 300, doc, tf, np.arange((1 << 20) + 1))
        edges, at = np.append(0, made["ends"]), 0
        for a, z, size, last, high in zip(edges, edges[1:], made["postings"], made["last"], made["tf"], strict=False):
            got, times = unpacked(made["data"][a:z].tobytes(), size)
            assert got.tolist() == doc[at : at + size].tolist() and times.tolist() == tf[at : at + size].tolist()
            assert last == got[-1] and high == times.max() and size <= 128
            at += size


def test_best_of_shard_agrees_with_adding_up_everything():
    dice = np.random.default_rng(4)
    for trial in range(60):
        size = int(dice.integers(1, 4000))
        lengths = dice.integers(1, 200, size) if trial % 2 else np.full(size, 50)
        rows = []
        for _ in range(int(dice.integers(1, 9))):
            some = dice.choice(size, int(dice.integers(1, size + 1)), replace=False)
            rows.append((int(dice.integers(1, 9000)), {int(d): int(dice.integers(1, 4)) for d in some}))
        total = int(lengths.sum())
        exact = np.zeros(size, np.int64)
        for weight, held in rows:
            for d, tf in held.items():
                exact[d] += weight * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * int(lengths[d]) * size // total)))
        order = np.lexsort((np.arange(size), -exact))[:10]
        order = order[exact[order] > 0]
        best, sums = best_of_shard(made_lists(rows, lengths, size, total), size, 10, first_range=64)
        assert best.tolist() == order.tolist() and sums.tolist() == exact[order].tolist()


def test_blocks_that_cannot_win_stay_packed():
    """A rare strong term and a frequent weak one: once ten documents with the strong one are known, the weak list is
    no source of candidates, and only its blocks around those with the strong one are unpacked."""
    size = 20_000
    lengths = np.full(size, 50)
    strong = {d: 1 for d in [*range(0, 400, 20), 15_000]}
    rows = [(9000, strong), (10, {d: 1 for d in range(size)})]
    lists = made_lists(rows, lengths, size, int(lengths.sum()))
    best, _ = best_of_shard(lists, size, 10)
    assert best.tolist() == list(range(0, 200, 20))
    assert len(lists[1]._open) <= 4 < len(lists[1].last) == -(-size // 128)
