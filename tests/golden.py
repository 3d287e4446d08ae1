"""The change-log rows and golden results, read from FIXTURES.md so that they exist once."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from pathlib import Path

TEXT = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text(encoding="utf-8")


def feeds() -> dict[str, str]:
    """Feed name to CSV text, header included."""
    return dict(re.findall(r"^`(\w+)` \([^\n]*\)\n\n```csv\n(.*?)```", TEXT, re.M | re.S))


def table(after: str) -> list[dict[str, str | None]]:
    """The first Markdown table below the given phrase, as rows of text."""
    lines = TEXT[TEXT.index(after):].splitlines()
    start = next(i for i, line in enumerate(lines) if line.startswith("|"))
    cells = []
    for line in lines[start:]:
        if not line.startswith("|"):
            break
        cells.append([cell.strip() for cell in line.strip("|").split("|")])
    header, _, *rows = cells
    return [
        {name: None if value == "NULL" else value for name, value in zip(header, row, strict=True)}
        for row in rows
    ]


def text(value: object) -> str | None:
    """A result value the way the tables print it."""
    if value is None:
        return None
    if isinstance(value, list):
        return "+".join(value)
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, Decimal):
        return f"{value:.2f}"
    return str(value)


def printed(rows: list, columns: list[str]) -> list[tuple]:
    return [tuple(text(row[column]) for column in columns) for row in rows]
