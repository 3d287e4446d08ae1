"""Operators against brute force, libraries and held-out labels, and on awkward rows and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EDGES, SF_DIR
from tidelog.llm import order_minhash
from tidelog.llm.common import clear_scratch, settled
from tidelog.llm.decontam import contaminated
from tidelog.llm.lang_id import identify, train
from tidelog.llm.license_scan import TEMPLATES, license_spans
from tidelog.llm.near_dups import NearDups, near_duplicates
from tidelog.llm.oracles import ORACLES
from tidelog.llm.piece_codec import digests, encode
from tidelog.llm.quality import quality_scores
from tidelog.llm.queries import QUERIES
from tidelog.llm.secret_scan import secret_spans, secrets
from tidelog.llm.token_counts import token_counts
from tidelog.llm.warc import derivatives, plain_text, responses, write_warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts_of(df) -> list[tuple]:
    return [(row.doc_id, row.text) for row in df.select("doc_id", "text").collect()]


def labels_for(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 0), (4, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id BIGINT, quality INT, toxic INT")


def items_for(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, "too short"), (None, "")]
    return spark.createDataFrame(rows, "item_id BIGINT, text STRING")


OPERATORS = {
    "language": lambda spark, docs: identify(docs),
    "licenses": lambda spark, docs: license_spans(docs),
    "secrets": lambda spark, docs: secret_spans(docs, keep=["doc_id"]),
    "benchmark": lambda spark, docs: contaminated(docs, items_for(spark)),
    "near": lambda spark, docs: near_duplicates(docs),
    "tokens": lambda spark, docs: token_counts(docs, MODEL),
    "fingerprints": lambda spark, docs: order_minhash.compare_edited(docs),
    "quality": lambda spark, docs: quality_scores(docs, labels_for(spark)),
    "pieces": lambda spark, docs: digests(docs, MODEL, keep=["doc_id"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(spark, edges, name):
    rows = OPERATORS[name](spark, edges).collect()
    if name not in ("licenses", "benchmark"):
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in EDGES)
    assert OPERATORS[name](spark, edges.limit(0)).collect() == []
    by_id = {r.doc_id: r for r in rows}
    if name == "language":
        assert {by_id[i].lang_pred for i in (1, 2, 3, 9)} == {"und"} and by_id[5].lang_pred == "en"
    if name == "benchmark":
        assert {(r.doc_id, r.item_id, r.similarity) for r in rows} == {(5, 1, 1.0), (6, 1, 1.0)}
    if name == "near":
        assert (by_id[6].component_id, by_id[6].kept, by_id[5].kept) == (5, False, True)
        assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[4].n_shingles == 1
    if name == "fingerprints":
        assert by_id[5].sketch == by_id[6].sketch and by_id[1].sketch == []
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in rows)


def test_near_duplicates_agree_with_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    expected = duck.execute(ORACLES["op5_near_duplicates"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op5_near_duplicates"](spark, SF_DIR).collect()) == sorted(expected)


def test_near_duplicates_of_a_group_around_the_threshold(spark):
    """Copies with one to nine words changed: similarities lie on both sides of 0.8. Compared by brute force."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for j in range(1 + i % 9):
            words[(i * 37 + j * 11) % 100] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), NearDups(words=2))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in root}


def test_tokens_and_pieces_agree_with_the_library(spark, documents, edges):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for docs in (documents, edges):
        ids = [(i, model.encode(text or "")) for i, text in texts_of(docs)]
        counted = Counter((r.doc_id, r.n_tokens) for r in token_counts(docs, MODEL).collect())
        assert counted == Counter((i, len(x)) for i, x in ids)
        coded = Counter(tuple(r) for r in digests(docs, MODEL, keep=["doc_id"]).collect())
        assert coded == Counter((i, len(x), sha(",".join(map(str, x))), sha(model.decode(x))) for i, x in ids)
    decoded = {r.doc_id: r.decoded for r in encode(documents, MODEL, keep=["doc_id"]).collect()}
    assert decoded == dict(texts_of(documents))


def test_pieces_of_odd_characters_agree_with_the_library(spark):
    """Ids and decoded texts, where chunks hold markers, control and unknown characters, and what looks like a special piece."""
    dice = random.Random(8)
    parts = ["▁", " ", "  ", "a", "the", "<0x41>", "<unk>", "<s>", "\u2047", "\0", "\n", "\t", "é", "\U0001f600", "\u200b", "\ufeff", "東京", "\ue000", "𓀀", "ab"]
    texts = ["".join(dice.choices(parts, k=dice.randint(0, 12))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.ids, r.decoded) for r in encode(docs, MODEL, keep=["doc_id"]).collect()}
    assert got == {i: (ids := model.encode(text), model.decode(ids)) for i, text in enumerate(texts)}


def test_secrets_in_layers():
    plain = 'token = "abcdefghijkl123"'
    assert secrets(plain)[1] == [("assign", 0, 24)]
    assert secrets("token = short")[1] == []
    assert secrets("TOKEN:AKIA" + "A" * 14)[0] == [("assign", 0, 24), ("access", 6, 24)]
    for wrapped in (
        quote(plain, safe=""),
        quote(quote(plain, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in plain),
        base64.b64encode(plain.encode()).decode(),
        base64.b64encode(gzip.compress(plain.encode())).decode(),
        base64.b64encode(base64.b64encode(plain.encode())).decode(),
    ):
        base, found = secrets(f"before {wrapped} after")
        assert ("assign", 7, 7 + len(wrapped)) in found or any(k == "assign" and 7 <= a < b <= 7 + len(wrapped) for k, a, b in found)


def test_repeated_and_address_safe_layers():
    """A layer is found at every place it stands at, and in the alphabet made for addresses."""
    plain = 'token = "abcdefghijkl123"'
    coded = base64.b64encode(plain.encode()).decode()
    found = secrets(f"{coded} and {coded}")[1]
    assert found == [("assign", 0, len(coded)), ("assign", len(coded) + 5, 2 * len(coded) + 5)]
    url = base64.urlsafe_b64encode('~~~>>>???ÿ token = "abcdefghijkl123"'.encode()).decode()
    assert "-" in url or "_" in url
    assert secrets(f"x {url} y")[1] == [("assign", 2, 2 + len(url))]


def test_base64_over_several_lines():
    """Secrets in wrapped base64, plain and compressed, across a break or a character cut by one."""
    plain = "é" * 28 + 'token = "abcdefghijkl123"' + "é" * 60
    noise = "".join(hashlib.sha512(str(i).encode()).hexdigest()[:9] + "~" for i in range(40))
    for data in (plain.encode(), gzip.compress(f"{noise} {plain}".encode())):
        coded = base64.b64encode(data).decode()
        for width in (64, 76):
            for glue in ("\n", "\r\n", "\n    ", '"\n  "', "\\n"):
                wrapped = glue.join(coded[i : i + width] for i in range(0, len(coded), width))
                for before in ("before: ", "averyveryverylongword\n"):
                    found = secrets(f"{before}{wrapped}\n\nafter")[1]
                    assert ("assign", len(before), len(before) + len(wrapped)) in found, (width, glue, before)


def test_layers_that_are_not_plain_text(monkeypatch):
    """One odd character, another encoding, several members or a great length do not hide a layer's secrets."""
    plain = 'token = "abcdefghijkl123"'
    cases = [f"{odd} {plain}".encode() for odd in ("\ufeff", "\u200d", "\u00ad", "\0", "\x1b", "\ue000")]
    cases += [plain.encode("utf-16-le"), plain.encode("utf-16"), plain.encode("utf-16-be"), b"x" + f"é {plain}".encode("utf-16-le"), f"é {plain}".encode("latin-1")]
    pack = [gzip.compress, zlib.compress, zstandard.compress]
    cases += [f(b"nothing here, ") + f(plain.encode()) for f in pack] + [gzip.compress(b"nothing") + plain.encode()]
    cases += [f(g(b"nothing") + g(plain.encode())) for f in pack for g in pack]
    for data in cases:
        coded = base64.b64encode(data).decode()
        assert ("assign", 2, 2 + len(coded)) in secrets(f"x {coded} y")[1], data
    for data in (f"é {plain}".encode("latin-1"), plain.encode("utf-16-le")):
        coded = quote(data, safe="")
        assert any(kind == "assign" for kind, _, _ in secrets(f"x {coded} y")[1]), data
    monkeypatch.setattr("tidelog.llm.secret_scan.LONGEST_LAYER", 1 << 20)
    for n in (3 << 20, (1 << 20) - 12, (3 << 20) - 12):
        for filler in ("(a word) ", "a"):
            text = (filler * n)[:n] + " " + plain + (filler * n)[:n]
            for f in pack:
                coded = base64.b64encode(f(text.encode())).decode()
                assert ("assign", 2, 2 + len(coded)) in secrets(f"x {coded} y")[1], (n, filler, f)


def test_base_findings_agree_with_plain_patterns(spark, documents):
    kinds = {
        "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        "access": (r"AKIA[A-Z0-9]+", 18, 0),
        "hex": (r"[0-9a-f]+", 16, 0),
    }
    got = {r.doc_id: [tuple(s) for s in r.base] for r in secret_spans(documents, keep=["doc_id"]).collect()}
    for i, text in texts_of(documents):
        found = [(k, *m.span()) for k, (p, n, g) in kinds.items() for m in re.finditer(p, text) if len(m[g]) >= n]
        assert got[i] == sorted(found, key=lambda x: (x[1], list(kinds).index(x[0])))


def test_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in identify(documents).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [r for r in QUERIES["op8_quality_scores"](spark, big).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_languages_of_long_and_missing_texts_are_learned(spark):
    """A language is learned from long texts, and from what there is behind many rows without a text."""
    rows = [(1, "le renard brun saute par dessus le chien " * 2500, "fr"), (2, "the quick brown fox jumps over the dog", "en")]
    rows += [(i, None, "de") for i in range(3, 1500)] + [(1500, "der schnelle braune fuchs springt", "de")]
    trees = train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), F.lit(True))
    assert trees.langs == ["de", "en", "fr"]


def test_every_verbatim_passage_is_found(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    words = lambda text: f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
    expected = {(i, item.item_id) for i, text in texts_of(documents) for item in items if words(item.text) in words(text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_contaminated_documents"](spark, SF_DIR).collect()}
    assert expected and expected <= got


def test_edited_passages_agree_with_brute_force(spark):
    """Passages with words replaced at the ends are found as long as their similarity is 0.8, however far
    their fingerprints are apart."""
    items = [[f"w{i}x{j}" for j in range(15 + i % 45)] for i in range(120)]
    texts, expected = [], set()
    for i, words in enumerate(items):
        for out in range(1, 5):
            for at in (0, out):
                n = len(words)
                edited = [f"e{i}x{j}" if j < at or j >= n - out + at else w for j, w in enumerate(words)]
                texts.append((len(texts), " ".join(["before", *edited, "after"])))
                a, b = (Counter(zip(*[x[j:] for j in range(5)], strict=False)) for x in (edited, words))
                if (a & b).total() * 100 >= 80 * (a | b).total():
                    expected.add((len(texts) - 1, i))
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    rows = contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id BIGINT, text STRING")).collect()
    assert len(expected) > 400 and {(r.doc_id, r.item_id) for r in rows} == expected
    assert max(r.hamming for r in rows) > 11


def test_short_items_and_scripts_without_spaces(spark):
    """Items of fewer words than a shingle, and of characters without spaces, are found where they are quoted."""
    items = ["What is the capital?", "Paris", "中国的首都是哪里", "東京です", "เมืองหลวงคือที่ไหน", "one two three four five six"]
    docs = [f"before {x} after it, {x} again" for x in items[:2]] + [f"前後{x}前後" for x in items[2:5]]
    docs += ["the capital is what", "中国首都的是哪里", "東京", "one two three four", None, ""]
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} BIGINT, text STRING")
    rows = contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in rows) == [
        (0, 0, 1, 1.0), (1, 1, 1, 1.0), (2, 2, 2, 1.0), (3, 3, 2, 1.0), (4, 4, 2, 1.0)
    ]


def test_edited_texts(spark, documents):
    rows = sorted(texts_of(documents), reverse=True)
    after = dict(zip([r[0] for r in rows], rows[1:] + rows[:1], strict=True))
    got = {r.doc_id: r for r in order_minhash.compare_edited(documents).collect()}
    for i, text in rows:
        half = len(text) // 2
        assert got[i].edited == text[: len(text) - half] + after[i][1][:half] and got[i].n_chars == len(text)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)


def test_order_counts(spark):
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words[:199] + ["other"])]
    sketch = order_minhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    a, moved, edited = (sketch.where(f"doc_id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in range(3))
    row = a.join(moved).join(edited).select(order_minhash.likeness("s0", "s1").alias("m"), order_minhash.likeness("s0", "s2").alias("e")).first()
    assert row.m < 0.8 < row.e


def test_edits_of_text_without_spaces(spark):
    """One character more at the front or in the middle leaves most of a fingerprint, one moved half does not."""
    digits = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(30))
    long = [base64.b64encode(bytes.fromhex(digits)).decode(), "".join(chr(0x4E00 + int(digits[i : i + 3], 16)) for i in range(0, 3000, 3))]
    texts = [t for x in long for t in (x, "y" + x, x[:500] + "y" + x[500:], x[500:] + x[:500])]
    sketch = order_minhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    pairs = sketch.alias("a").join(sketch.alias("b"), F.expr("a.doc_id % 4 = 0 AND b.doc_id - a.doc_id BETWEEN 1 AND 3"))
    rows = pairs.select(F.expr("b.doc_id % 4").alias("edit"), order_minhash.likeness("a.sketch", "b.sketch").alias("near")).collect()
    assert len(rows) == 6 and all(r.near > 0.8 for r in rows if r.edit < 3), rows
    assert all(r.near < 0.8 for r in rows if r.edit == 3), rows


def test_licenses(spark):
    texts = ["x y z. Released under the MIT License. more", "Licensed under the Apache Licence, Version 2.0. And Licensed under CC BY-NC 4.0.", "the license"]
    got = license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    found = {(r.doc_id, r.license): texts[r.doc_id][r.start : r.end] for r in got}
    assert found[0, "MIT"] == "Released under the MIT License"
    assert found[1, "CC-BY-NC-4.0"] == "Licensed under CC BY-NC 4.0"
    assert {k for i, k in found if i == 1} >= {"Apache-2.0"} and not [i for i, _ in found if i == 2]


def test_licenses_that_follow_each_other(spark):
    """Every one of many notices in a row is a place of its own, without words of its neighbours."""
    line, other = "Released under the MIT License.", "Released under the MIT Licence."
    texts = ["\n".join([line] * 50), f"{line} {other} {line} x {line}", " ".join([TEMPLATES["MPL-2.0-header"]] * 7)]
    got = license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    places = lambda i, name: sorted((r.start, r.end) for r in got if (r.doc_id, r.license) == (i, name))
    step = len(line) + 1
    assert places(0, "MIT") == [(i * step, i * step + len(line) - 1) for i in range(50)]
    assert [texts[1][a:b] for a, b in places(1, "MIT")] == [line[:-1], other[:-9], line[:-1], line[:-1]]
    step = len(TEMPLATES["MPL-2.0-header"])
    assert [(a, b) for a, b in places(2, "MPL-2.0-header")] == [(i * (step + 1), i * (step + 1) + step - 2) for i in range(7)]


def test_warc_records(spark, tmp_path):
    rows = [(1, "http://a/b", '<html lang="EN"><title>T &amp; U</title><p>One<b>two</b><script>x</script><p>é'), (None, None, None), (2, "u", "")]
    made = derivatives(responses(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")))
    records = made.collect()
    assert len(records) == 6 and {r.type for r in records} == {"metadata", "conversion"}
    first = {r.type: r for r in records if r.page_id == 1}
    assert first["conversion"].block == "T & U\nOnetwo\né" == plain_text(rows[0][2])
    assert first["metadata"].refers_to == first["conversion"].refers_to and "language: en" in first["metadata"].block
    for r in records:
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers
        assert f"Content-Length: {len(r.block.encode())}\r\n" in r.headers
        assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
    write_warc(made.coalesce(1), str(tmp_path / "w"))
    written = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part*"))
    assert written.count(b"WARC/1.1\r\n") == 6 and written.endswith(b"\r\n\r\n")


def test_pipeline_looks_at_rows_not_ids(spark, documents):
    """A missing or repeated id neither takes a clean row along nor keeps a copy."""
    bad = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in ("ape", "bee", "cat", "dog"))
    frame = lambda rows: spark.createDataFrame([(*r, "en", "s", 1) for r in rows], documents.schema)
    kept = lambda stage, rows: Counter(texts_of(stage(spark, frame(rows), SF_DIR)))
    clean = [(None, a), (7, b), (None, None), (7, None), (8, c)]
    assert kept(corpus_pipeline.decontaminate, [*clean, (None, bad), (7, bad)]) == Counter(clean)
    rows = [(None, a), (None, a), (3, b), (3, b), (3, c), (9, d), (2, d), (None, d), (None, None), (None, None), (3, "")]
    expected = [(None, a), (3, b), (3, c), (2, d), (None, None), (None, None), (3, "")]
    assert kept(corpus_pipeline.near_dedup, rows) == Counter(expected)


def test_pipeline_keeps_clean_documents(spark, documents, edges):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, settled(stage(spark, docs, SF_DIR))
        assert docs.columns == columns and docs.count() >= 0.8 * before.count() > 0, name
    texts = dict(texts_of(docs))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t) for i, t in texts.items()}
    assert all(secrets(t)[1] == [] for t in texts.values())
    assert contaminated(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).count() == 0
    assert near_duplicates(docs).where("NOT kept").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edges, SF_DIR).collect()
        assert stage(spark, edges.limit(0), SF_DIR).count() == 0
    clear_scratch(spark)
