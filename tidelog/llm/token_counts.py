"""Token counts: pieces are counted once per distinct pre-token and summed over frequencies.

Pre-tokens are the marked chunks of :mod:`tidelog.llm.chunks`. Of every Arrow batch the pre-tokens get
codes; the pieces of each code are looked up once, and the (document, code) frequencies are joined to them
by code and summed. Ids are dropped as soon as they are counted.

This happens inside the tasks that read the texts, with no shuffle. A join across the cluster would have to
move a row for every document and distinct pre-token, which is more than the texts themselves: most
words occur once in a document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.chunks import ChunkTable, chunks_of, load
from tidelog.llm.common import map_batches


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``; the id keeps its name.

    ``n_bytes`` are those of UTF-8. NULL and empty texts have no bytes and no tokens. Ids are
    passed on as they are, NULL and repeated ones too; other columns are not read. ``model_path`` must
    be readable on every executor, as installed packages are.
    """

    def start():
        table = ChunkTable(load(model_path), len)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes: dict[str, int] = {}
            doc, code, times = [], [], []
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                frequencies = Counter(chunks_of(text))
                doc.append(np.full(len(frequencies), i))
                code.append(
                    np.fromiter((codes.setdefault(c, len(codes)) for c in frequencies), np.int64, len(frequencies))
                )
                times.append(np.fromiter(frequencies.values(), np.int64, len(frequencies)))
            pieces = np.fromiter((table[c] for c in codes), np.int64, len(codes))
            sums = np.zeros(len(texts), np.int64)
            np.add.at(sums, np.concatenate(doc), np.concatenate(times) * pieces[np.concatenate(code)])
            return pa.RecordBatch.from_pydict(
                {"id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(sums)}
            )

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes"))
    return map_batches(texts, start, f"id {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
