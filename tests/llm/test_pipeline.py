"""Stages of the corpus pipeline against plain Python on whole small tables."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF_DIR
from tests.llm.test_methods import WORDS
from tidelog.llm.lang_id import predict, train
from tidelog.llm.secret_scan import secrets

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_by_brute_force(rows: list[tuple[int, str]]) -> set[int]:
    """The smallest id of each component of texts whose sets of five words in a row are alike by 0.8 or more."""
    sets = {}
    for i, text in rows:
        words = SPACED.findall(ascii_lower(text or ""))
        sets[i] = {tuple(words[a : a + 5]) for a in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in ids if find(i) == i}


def test_one_document_of_each_group_stays(spark, documents):
    expected = kept_by_brute_force([(r.doc_id, r.text) for r in documents.collect()])
    kept = corpus_pipeline.near_dedup(spark, documents, SF_DIR)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and len(expected) < documents.count()


def test_documents_with_a_passage_of_the_benchmark_go(spark, documents):
    items = [Counter(zip(*[w[k:] for k in range(5)], strict=False)) for w in (WORDS.findall(r.text.lower()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect())]
    gone = set()
    for r in documents.collect():
        words = WORDS.findall((r.text or "").lower())
        shingles = list(zip(*[words[k:] for k in range(5)], strict=False))
        have = set(shingles)
        for item in items:
            if not have.isdisjoint(item):
                n = sum(item.values())
                windows = (Counter(shingles[a : a + n]) for a in range(max(len(shingles) - n, 0) + 1))
                if any(100 * sum((w & item).values()) >= 80 * sum((w | item).values()) for w in windows):
                    gone.add(r.doc_id)
                    break
    kept = corpus_pipeline.decontaminate(spark, documents, SF_DIR)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in documents.collect()} - {r.doc_id for r in kept.collect()} == gone and gone


def test_secrets_are_masked_and_nothing_else(spark, documents):
    def masked(text: str | None) -> str | None:
        out, at = [], 0
        for _, a, b in secrets(text)[1] if text else ():
            if a > at or not out:
                out += [text[at:a], corpus_pipeline.MASK]
            at = max(at, b)
        return text if not out else "".join([*out, text[at:]])

    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, documents, SF_DIR).collect()}
    expected = {r.doc_id: (masked(r.text), len(masked(r.text) or "")) for r in documents.collect()}
    assert got == expected and any(corpus_pipeline.MASK in (t or "") for t, _ in got.values())


def test_texts_of_no_known_language_go_and_the_others_are_named(spark, documents):
    trees = train(documents, F.lit(True))
    bits = {r.doc_id: (r.lang_pred, r.bits_per_byte) for r in predict(documents, trees, keep=["doc_id"]).collect()}
    expected = {i: lang for i, (lang, b) in bits.items() if lang != "und" and b < 8}
    got = corpus_pipeline.language(spark, documents, SF_DIR)
    assert got.columns == documents.columns and {r.doc_id: r.lang for r in got.collect()} == expected


def test_each_stage_works_on_what_the_one_before_kept(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), documents.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    by_hand = Counter((r.doc_id, r.lang, tuple(r.ids), r.decoded) for r in last.collect())
    assert Counter((r.doc_id, r.lang, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == by_hand
