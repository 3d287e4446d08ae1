"""Content hash of an event, and the total order built on it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.config import EntitySpec

# They decide which of two events with the same time wins.
SEPARATOR = "||"
NULL_TEXT = "<null>"
HASH_BITS = 256


def content_text(columns: Iterable[str]) -> Column:
    """The columns as one text, in name order, so that neither feed nor file order matters.

    Strings holding the separator or the NULL text can make two different rows read the same.
    Nothing is lost by it: duplicates are compared by column, and :func:`total_order` goes on to
    the text columns when hashes agree.
    """
    texts = F.array(*[F.col(name).cast("string") for name in sorted(columns)])
    return F.array_join(texts, SEPARATOR, NULL_TEXT)


def content_hash(columns: Iterable[str]) -> Column:
    return F.sha2(content_text(columns), HASH_BITS)


def total_order(spec: EntitySpec, newest_first: bool = False) -> list[Column]:
    """Event time, then hash. The same order, both ways round, drives fill and collapse."""
    names = [spec.event_time, spec.fingerprint, *spec.text_columns]
    return [F.desc(name) if newest_first else F.asc(name) for name in names]
