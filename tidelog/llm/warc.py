"""WARC derivatives: metadata and plain-text conversion records made from response records.

A response is ``(record_id, target_uri, date, http_headers, payload)`` and, if it comes from a WARC file, ``warc_headers``,
``source_digest`` and ``digest_matches``. It gives two records that refer to it:
``metadata`` (application/warc-fields: what the source says about itself) and ``conversion`` (the text of the
page). Both keep the response's identifier in WARC-Refers-To and its target and date; the metadata carries the
source's HTTP and WARC headers and its payload digest on, with the outcome of checking it; the conversion has digests of its own. Identifiers are
name-based (UUID version 5 of the response's identifier and the record type), so a task that is run again
makes the same records.

:func:`read_responses` reads response records of WARC files, plain or compressed, and :func:`write_warc` writes records, both with
Spark's text source. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import map_batches

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
# The rest of a tag: a sign for its end may stand in a quoted attribute. A quote mark without a second one is a character.
_REST = r"""(?:[^>"']|"[^"]*+"|'[^']*+'|["'])*+"""
_DROPPED = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b{_REST}>.*?(?:</\1\s*>|\Z)", re.S | re.I)
# Elements that start a line of their own.
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|"
    r"html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b" + _REST + ">",
    re.I,
)
_TAG = re.compile(rf"<[A-Za-z/!?]{_REST}(?:>|\Z)")
_TITLE = re.compile(rf"<title\b{_REST}>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_BETWEEN = "\r\n\r\nWARC/"  # what ends a record and starts the next
# Header fields that a derived record has of its own.
_OWN = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length", "content-type", "warc-block-digest"}


def plain_text(page: str) -> str:
    """The text of a page: a line for every block, white space reduced, entities resolved."""
    body = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def derive(
    record_id: str, target: str, date: str, http_headers: str, payload: str, warc_headers: str = "", source_digest: str = "", matches: bool | None = None
) -> list[tuple]:
    """The metadata and the conversion record of a response, as ``(type, record_id, content_type, digest, headers,
    block)``. A digest that came with the response is passed on as it is, with whether it ``matches``."""
    data = payload.encode()
    title, lang = _TITLE.search(payload), _LANG.search(payload)
    fields = {
        "payload-digest": source_digest or digest(data),
        "payload-digest-matches": "" if matches is None else str(matches).lower(),
        "payload-length": str(len(data)),
        "title": _one_line(html.unescape(title[1])) if title else "",
        "language": lang[1].lower() if lang else "",
    }
    source = [line for line in http_headers.splitlines() if ":" in line]
    kept = [line for line in warc_headers.splitlines() if ":" in line and line.partition(":")[0].strip().lower() not in _OWN]
    about = [f"{k}: {v}" for k, v in fields.items() if v] + [f"http-{line}" for line in source] + [f"source-{line}" for line in kept]
    made = (
        ("metadata", "application/warc-fields", "".join(f"{line}\r\n" for line in about)),
        ("conversion", "text/plain; charset=utf-8", plain_text(payload)),
    )
    out = []
    for kind, content_type, block in made:
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{record_id} {kind}')}>"
        head = {
            "WARC-Type": kind,
            "WARC-Record-ID": own,
            "WARC-Refers-To": record_id,
            "WARC-Target-URI": _one_line(target),
            "WARC-Date": date,
            "WARC-Block-Digest": digest(block.encode()),
            "Content-Type": content_type,
            "Content-Length": str(len(block.encode())),
        }
        headers = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
        out.append((kind, own, content_type, head["WARC-Block-Digest"], headers, block))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table ``(page_id, url, html)``. The identifier is made of id and address.

    NULL addresses and pages become empty ones, a NULL id the empty name; ``page_id`` is passed on.
    """
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    d = F.sha1(name)
    urn = F.concat(
        F.lit("<urn:uuid:"), d.substr(1, 8), F.lit("-"), d.substr(9, 4), F.lit("-5"), d.substr(14, 3),
        F.lit("-a"), d.substr(18, 3), F.lit("-"), d.substr(21, 12), F.lit(">"),
    )
    return pages.select(
        "page_id",
        urn.alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("Content-Type: text/html; charset=utf-8").alias("http_headers"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of each; lines that go on are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _dechunked(body: bytes) -> bytes:
    """A body sent in chunks, put together, as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9A-Fa-f]+)", body[at:end])
        if not size or not (n := int(size[1], 16)):
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def _decompressed(body: bytes, coding: str) -> bytes:
    """A body without its content coding; one that is damaged as far as it goes, one of another coding as it is."""
    if coding not in ("gzip", "x-gzip", "deflate"):
        return body
    for bits in (47, -15):  # gzip and zlib tell themselves apart, bare deflate data has no head
        unpack = zlib.decompressobj(bits)
        try:
            return unpack.decompress(body)
        except zlib.error:
            continue
    return body


def parse_response(block: bytes, digest_given: str) -> tuple[str, str, bool | None]:
    """HTTP headers, text and, if a digest was given, whether it is that of the body as sent or as put together."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = _fields(head)
    whole = _dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body
    matches = None
    if digest_given:
        name, _, value = digest_given.partition(":")
        try:
            found = [hashlib.new(name.strip().lower(), x).digest() for x in (body, whole)]
        except ValueError:
            found = []
        matches = any(value.strip().lower() in (base64.b32encode(f).decode().lower(), f.hex()) for f in found)
    data = _decompressed(whole, fields.get("content-encoding", "").lower())
    named = _CHARSET.search(fields.get("content-type", "").encode()) or _CHARSET.search(data[:1024])
    try:
        text = data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = data.decode("utf-8", "replace")
    return head.decode("utf-8", "replace"), text, matches


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: ``(type, record_id, target_uri, date, warc_headers, block binary, truncated)``.

    A large plain file is read by several tasks, a compressed one by one. Records are told apart by what stands between
    them; where that stands within a block, Content-Length says so, and the block is put together again. A record that is
    shorter than it says, as where a crawl broke off, is marked as truncated. Records of any type are read.
    """
    raw = spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(data: bytes) -> dict | None:
            head, _, block = data.partition(b"\r\n\r\n")
            fields = _fields(head)
            if "warc-type" not in fields:
                return None
            size = int(n) if (n := fields.get("content-length", "")).isdigit() else len(block)
            lines = "\n".join(line for line in head.decode("utf-8", "replace").splitlines()[1:])
            about = [fields.get(f, "") for f in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")]
            return dict(zip(names, [*about, lines, block[:size], len(block) < size], strict=True)) | {"size": size}

        names = ["type", "record_id", "target_uri", "date", "warc_headers", "block", "truncated"]
        kinds = [*[pa.string()] * 5, pa.binary(), pa.bool_()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        held = None
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                inside = _BETWEEN.encode() + data
                if held and held["truncated"] and len(held["block"]) + len(inside) <= held["size"]:
                    held["block"] += inside
                    held["truncated"] = len(held["block"]) < held["size"]
                    continue
                if held:
                    yield pa.RecordBatch.from_pylist([{n: held[n] for n in names}], schema)
                held = record(data.removeprefix(b"WARC/"))
        if held:
            yield pa.RecordBatch.from_pylist([{n: held[n] for n in names}], schema)

    made = "type string, record_id string, target_uri string, date string, warc_headers string, block binary, truncated boolean"
    return raw.mapInArrow(run, made)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses in WARC files, in the form :func:`derivatives` takes, with ``truncated``: bodies put together and unpacked, text by
    the character set that header or page name, and the source's own headers and payload digest."""

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            headers, blocks = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            given = [_fields(h.encode()).get("warc-payload-digest", "") for h in headers]
            parsed = [parse_response(b, g) for b, g in zip(blocks, given, strict=True)]
            http, payload, matches = zip(*parsed, strict=True) if parsed else ((), (), ())
            made = {"http_headers": pa.array(http, pa.string()), "payload": pa.array(payload, pa.string()), "source_digest": pa.array(given, pa.string()), "digest_matches": pa.array(matches, pa.bool_())}
            kept = {n: batch.column(i) for i, n in ((1, "record_id"), (2, "target_uri"), (3, "date"), (4, "warc_headers"), (6, "truncated"))}
            return pa.RecordBatch.from_pydict(kept | made)

        return apply

    schema = (
        "record_id string, target_uri string, date string, warc_headers string, truncated boolean, "
        "http_headers string, payload string, source_digest string, digest_matches boolean"
    )
    found = map_batches(read_records(spark, path).where("type = 'response'"), start, schema)
    return found.withColumn("page_id", F.col("record_id"))


def derivatives(source: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, type, record_id, refers_to, target_uri, content_type, digest, headers, block)``: two rows for
    every response, of the columns named in the module's text and ``key``, which is passed on.

    Responses of :func:`read_responses` bring their WARC headers and digests along; a table without these columns is as good. NULL in
    any of the columns counts as empty; an empty page gives metadata and an empty conversion, so that
    every response can be accounted for. Responses that are repeated give their records again, with the same
    identifiers. Other columns are not read.
    """
    kind = source.schema[key].dataType.simpleString()
    names = ["record_id", "target_uri", "date", "http_headers", "payload", "warc_headers", "source_digest"]
    text = [F.coalesce(F.col(f"`{c}`").cast("string") if c in source.columns else F.lit(None), F.lit("")).alias(c) for c in names]
    matches = F.col("digest_matches") if "digest_matches" in source.columns else F.lit(None)
    text.append(matches.cast("boolean").alias("matches"))

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, refers, targets, made = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 9)]
            for i, response in enumerate(zip(*columns, strict=True)):
                for record in derive(*response):
                    rows.append(i)
                    refers.append(response[0])
                    targets.append(response[1])
                    made.append(record)
            kinds, ids, types, digests, headers, blocks = zip(*made, strict=True) if made else ((),) * 6
            texts = {"type": kinds, "record_id": ids, "refers_to": refers, "target_uri": targets, "content_type": types, "digest": digests, "headers": headers, "block": blocks}
            return pa.RecordBatch.from_pydict(
                {"key": batch.column(0).take(pa.array(rows, pa.int64()))}
                | {name: pa.array(values, pa.string()) for name, values in texts.items()}
            )

        return apply

    names = "type record_id refers_to target_uri content_type digest headers block".split()
    schema = f"key {kind}, " + ", ".join(f"{n} string" for n in names)
    return map_batches(source.select(F.col(key).alias("key"), *text), start, schema).withColumnRenamed("key", key)


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Write records as WARC files, one per task. With ``compression="gzip"`` a file is one gzip member, as Spark's text writer makes it;
    a member for each record is beyond it."""
    record = F.concat("headers", F.lit("\r\n"), "block")
    writer = records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n")
    (writer.option("compression", compression) if compression else writer).text(path)
