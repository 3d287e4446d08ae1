"""Tables of distinct marked chunks, for vocabularies whose pieces do not cross white-space markers.

The library writes a space as the marker U+2581 and puts one before the text. If no piece of the
vocabulary has a marker after another character, no merge can join the end of one chunk (markers, then
other characters) to the start of the next, so each chunk is segmented alone and once.

A table belongs to a task. It holds ``most`` short chunks; when it is full it starts anew, so memory is
bounded and nothing is left out. Chunks longer than ``longest`` are segmented where they occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import sentencepiece

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def load(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if chunks can be taken apart; a model where they can't is refused."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a white-space marker")
    if model.encode(" a  b ", out_type=str) != model.encode(f"{MARK}a{MARK}{MARK}b{MARK}", out_type=str):
        raise ValueError("the model changes white space")
    return model


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text with its leading marker; together they are the marked text."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkTable(dict):
    """Chunk to whatever ``derive`` makes of its ids."""

    def __init__(
        self, model: sentencepiece.SentencePieceProcessor, derive: Callable[[list[int]], object], most: int = 200_000, longest: int = 48
    ) -> None:
        super().__init__()
        self.model, self.derive, self.most, self.longest = model, derive, most, longest

    def __missing__(self, chunk: str) -> object:
        # The library puts a marker before a text, but makes nothing of an empty one.
        value = self.derive(self.model.encode(chunk[1:]) if len(chunk) > 1 else [self.model.piece_to_id(MARK)])
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value
