"""SentencePiece encoding and decoding by a table of distinct chunks.

Every distinct chunk of marked text (see :mod:`tidelog.llm.chunks`) is segmented once, with its ids and the
text they decode to; a document is the list of its chunks' entries by position. Tasks work alone, without
a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.chunks import MARK, ChunkTable, chunks_of, load
from tidelog.llm.common import map_texts


def _entry(model):
    """Ids of a chunk as text, their number, and what they decode to. Bytes of one character never lie
    in two chunks, so decoding by chunk is decoding the whole; only a text's first marker is dropped."""
    lead = [model.piece_to_id(MARK), model.piece_to_id("a")]

    def derive(ids: list[int]) -> tuple[str, int, str]:
        return ",".join(map(str, ids)), len(ids), model.decode(lead + ids)[1:]

    return derive


def _compact(model):
    """Ids of a chunk as bytes. What they decode to is kept only where it is not the chunk itself with spaces for markers."""
    lead = [model.piece_to_id(MARK), model.piece_to_id("a")]

    def derive(ids: list[int]) -> bytes | tuple[bytes, str]:
        packed, decoded = np.array(ids, np.int32).tobytes(), model.decode(lead + ids)[1:]
        plain = "".join([model.id_to_piece(i) for i in ids]).replace(MARK, " ")
        return packed if plain == decoded else (packed, decoded)

    return derive


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``ids array<int>`` and ``decoded``, row by row.

    NULL and empty texts have no ids and decode to the empty text. Long texts are held as their ids and their chunks.
    """

    def start():
        model = load(model_path)
        table = ChunkTable(model, _compact(model))

        def one(text: str | None) -> tuple[bytes, str]:
            chunks = chunks_of(text)
            entries = [table[c] for c in chunks]
            if all([type(e) is bytes for e in entries]):
                return b"".join(entries), (text or "").replace(MARK, " ")
            parts = [(e, c.replace(MARK, " ")) if type(e) is bytes else e for e, c in zip(entries, chunks, strict=True)]
            return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]

        def apply(texts: list) -> dict[str, pa.Array]:
            packed, decoded = zip(*map(one, texts), strict=True)
            ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            return {"ids": ids, "decoded": pa.array(decoded, pa.string())}

        return apply

    return map_texts(docs, start, "ids array<int>, decoded string", text_col, keep)


def digests(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: what :func:`encode`
    gives, as digests made in the same tasks. The digest of the ids is that of their decimal digits, joined
    by commas."""

    def sha256(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def make(rows: list[list[tuple]]) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([sum([e[1] for e in row]) for row in rows], pa.int64()),
            "ids_sha256": pa.array([sha256(",".join([e[0] for e in row])) for row in rows], pa.string()),
            "decoded_sha256": pa.array([sha256(_decoded(row)) for row in rows], pa.string()),
        }

    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, _segmenting(model_path, make), made, text_col, keep)


def _decoded(row: list[tuple]) -> str:
    return "".join([e[2] for e in row])[1:]


def _segmenting(model_path: str, make):
    """A task's function from texts to columns, through lists of table entries."""

    def start():
        model = load(model_path)
        table = ChunkTable(model, _entry(model))
        return lambda texts: make([[table[c] for c in chunks_of(text)] for text in texts])

    return start
