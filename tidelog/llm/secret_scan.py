"""Secret scans by a recursive decoding worklist.

A text is scanned as it is. Then encoded layers are unwrapped and put on a worklist: percent-encoding and
Unicode or HTML escapes in place, so that a key before the encoded part still stands before it; base64 runs,
also over several lines, and compressed data inside them as layers of their own. Every layer is scanned and unwrapped again until
none is left. A layer whose content was seen before at the same place is not taken up again, so cycles end, while
what is repeated is found at each of its places. Each character of a layer knows the part of the original text
it came from, so all spans are those of the original.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import html
import io
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_texts

# The kinds in their order, their patterns, and the characters that make a finding.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_LEAST = 12
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z]{2,8};")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
_BASE64_URL = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
# One line break with indentation, quote marks and the like; also one that is escaped.
_BREAK = r"""(?:["'][\x20\t]*+\+)?[\x20\t"',]*+(?:\\?(?:\r\n?|\n)|(?:\\r)?\\n)[\x20\t"'>#*]*+"""
# Nothing is given back and runs start at their first character only, so the time is in proportion to the text.
_WRAPPED, _WRAPPED_URL = (
    re.compile(rf"(?<!{c}){c}{{16,}}+(?:{_BREAK}{c}{{16,}}+)*+(?:{_BREAK}{c}++)?={{0,2}}") for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]")
)
_BREAKS = re.compile(_BREAK)
_WORD = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+")
_WIDE = re.compile(r"(?:[\x20-\x7e]\0+){8}")
LONGEST_LAYER = 1 << 26
_NULS = re.compile(r"\0+")
_CHUNK = 1 << 20
# A byte that is part of no finding and no encoded run, so that a layer can be cut behind it.
_CUT = re.compile(rb"[!$()?@\[\]^`|~\x01-\x08\x0e-\x1f\x7f-\xff]")
_OVERLAP = 1 << 16


@dataclass(frozen=True)
class Layer:
    """Decoded text; character i comes from ``[starts[i], ends[i])`` of the original. None: from itself, or all
    from ``run``."""

    text: str
    starts: array | None = None
    ends: array | None = None
    run: tuple[int, int] | None = None

    @property
    def place(self) -> tuple[int, int]:
        return self.span(0, len(self.text)) if self.text else (0, 0)

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.run is not None:
            return self.run
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])


def scan(text: str) -> list[tuple[str, int, int]]:
    """Findings of one layer, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _repeated(position: int, times: int) -> array:
    return array("q", [position]) * times


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match decoded, if one decodes to something else."""
    out, starts, ends, at, changed = [], array("q"), array("q"), 0, False

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        if layer.run is not None:
            return
        starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
        ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        changed = True
        keep(at, m.start())
        out.append(new)
        if layer.run is None:
            a, b = layer.span(*m.span())
            starts.extend(_repeated(a, len(new)))
            ends.extend(_repeated(b, len(new)))
        at = m.end()
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(out), starts, ends) if layer.run is None else Layer("".join(out), run=layer.run)


def _percent(run: str) -> str:
    return unquote_to_bytes(run).decode(errors="replace")


def _escape(run: str) -> str | None:
    if run[0] == "&":
        new = html.unescape(run)
        return new if new.isprintable() or new.isspace() else None
    if run.startswith("\\u{"):
        code = int(run[3:-1], 16)
        return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else None
    if run.startswith("\\x"):
        return chr(int(run[2:], 16))
    units = b"".join(int(x, 16).to_bytes(2, "big") for x in run.split("\\u")[1:])
    return units.decode("utf-16-be", errors="replace")


class _Parts(io.RawIOBase):
    """Bytes of an iterator as a file."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.rest = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.rest:
            if (part := next(self.parts, None)) is None:
                return 0
            self.rest = memoryview(part)
        n = min(len(room), len(self.rest))
        room[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _packed(head: bytes) -> int | None:
    """Window bits of a gzip or zlib head, 0 of zstd."""
    if head[:2] == b"\x1f\x8b":
        return 31
    if len(head) > 2 and head[0] & 0x0F == 8 and int.from_bytes(head[:2], "big") % 31 == 0:
        return 15
    return 0 if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _inflated(data: io.BufferedIOBase) -> Iterator[bytes]:
    """Unpacked data of all members or frames in a row, as far as they are intact, and what stands behind."""
    rest = data.read(_CHUNK)
    while (bits := _packed(rest)) is not None:
        if bits:
            unpack = zlib.decompressobj(bits)
        else:
            unpack = zstandard.ZstdDecompressor().decompressobj()
        try:
            # zstd has no bound on the output of a call, so it gets little at a time: 128 KB a block of four bytes.
            while not unpack.eof and rest:
                step = rest if bits else rest[:256]
                yield unpack.decompress(step, _CHUNK) if bits else unpack.decompress(step)
                rest = (unpack.unconsumed_tail if bits else rest[256:]) or (b"" if unpack.eof else data.read(_CHUNK))
        except (zlib.error, zstandard.ZstdError):
            return
        rest = unpack.unused_data + (rest if not bits else b"")
        if len(rest) < 4:
            rest += data.read(_CHUNK)
        rest = rest.lstrip(b"\0")
    while rest:
        yield rest
        rest = data.read(_CHUNK)


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes as one piece or, beyond LONGEST_LAYER, in pieces cut where no finding and no encoded run can be. Only
    where no such place is for LONGEST_LAYER do pieces overlap instead."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size <= LONGEST_LAYER:
            continue
        data = b"".join(held)
        back = data[::-1]
        cut = len(data) - at.start() if (at := _CUT.search(back)) else 0
        yield data[:cut] or data
        held = [data[cut:] if cut else data[-_OVERLAP:]]
        size = len(held[0])
    yield b"".join(held)


def _readings(data: bytes) -> Iterator[str]:
    """Bytes as text that has ASCII right in any case, in UTF-16 of both orders as well."""
    text = data.decode(errors="replace")
    yield text
    if "\0" in text and _WIDE.search(text):
        yield data.decode("utf-16-le", errors="replace")
        yield data[1:].decode("utf-16-le", errors="replace")


def _unpacked(run: str) -> Iterator[str]:
    """Texts inside a base64 run, and in any compressed layers right below it."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:  # the last character is half a byte at most
        body = body[:-1]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return
    yield from _readings(data)
    seen, below = set(), lambda: io.BytesIO(data)
    while _packed(below().read(4)) is not None:
        # Layers that are long are unpacked anew for each use, so that none is held whole.
        inner = lambda outer=below: io.BufferedReader(_Parts(_inflated(outer())))
        digest = hashlib.sha256()
        for part in _inflated(below()):
            digest.update(part)
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        for piece in _pieces(_inflated(below())):
            yield from _readings(piece)
        below = inner


def _base64_runs(text: str):
    """Start, end and contents of base64 runs, first of those with signs of the alphabet for addresses. A part
    of such a run is no run of its own."""
    taken = []
    if "-" in text or "_" in text:
        for m in _BASE64_URL.finditer(text):
            if "-" in m[0] or "_" in m[0]:
                taken.append(m.span())
                for new in _unpacked(m[0]):
                    yield *m.span(), new
    for m in _BASE64.finditer(text):
        if _WORD.fullmatch(m[0]):  # a word in one case, or capitalised
            continue
        before = bisect.bisect_right(taken, m.start(), key=lambda span: span[0])
        if before and m.end() <= taken[before - 1][1]:
            continue
        for new in _unpacked(m[0]):
            yield *m.span(), new


def _wrapped_runs(text: str):
    """Start, end and contents of base64 runs over several lines. A run is also tried from its second line on, as a
    long word may stand at the end of the line before it."""
    patterns = [_WRAPPED, _WRAPPED_URL] if "-" in text or "_" in text else [_WRAPPED]
    for m in (m for pattern in patterns for m in pattern.finditer(text)):
        if not (first := _BREAKS.search(m[0])):
            continue
        for start in (0, first.end()):
            run = _BREAKS.sub("", m[0][start:])
            if len(run.rstrip("=")) >= 16:
                for new in _unpacked(run):
                    yield m.start() + start, m.end(), new


def _decoded_in_place(layer: Layer) -> list[Layer]:
    """The layer with one kind of encoding resolved, for each kind it has."""
    text, made = layer.text, []
    if "%" in text:
        made.append(_in_place(layer, _PERCENT, _percent))
    if "\0" in text and _WIDE.search(text):
        made.append(_in_place(layer, _NULS, lambda _: ""))
    if "\\" in text or "&" in text:
        made.append(_in_place(layer, _ESCAPE, _escape))
    return [new for new in made if new]


def _runs(layer: Layer) -> Iterator[Layer]:
    """The layers inside encoded runs. A generator: of a long layer's pieces only one is held at a time."""
    text = layer.text
    for start, end, new in chain(_base64_runs(text), _wrapped_runs(text) if "\n" in text or "\r" in text or "\\n" in text else ()):
        yield Layer(new, run=layer.span(start, end))


def _sorted(found: set[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _known(layer: Layer) -> tuple[bytes, tuple[int, int]]:
    return hashlib.sha256(layer.text.encode(errors="surrogatepass")).digest(), layer.place


def secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Findings in the text itself, and all findings with those of decoded layers."""
    base = scan(text or "")
    first = Layer(text or "")
    found, seen = set(base), {_known(first)}
    # Layers to be scanned, and generators of more. What a layer becomes in place waits below its runs, and the layer
    # goes when these are done: of encodings nested in place only one level is held at a time.
    work: list[Layer | Iterator[Layer]] = [first]

    def take_up(layer: Layer) -> None:
        if (known := _known(layer)) not in seen:
            seen.add(known)
            work.append(layer)

    while work:
        if isinstance(top := work.pop(), Layer):
            if top is not first:
                found.update((kind, *top.span(a, b)) for kind, a, b in scan(top.text))
            for new in _decoded_in_place(top):
                take_up(new)
            work.append(_runs(top))
        elif (layer := next(top, None)) is not None:
            work.append(top)
            take_up(layer)
    return _sorted(set(base)), _sorted(found)


def secret_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``base`` and ``spans``, row by row: arrays of ``(kind, start, end)`` in
    code points, end exclusive, by start, then kind as listed in KINDS, then end.

    ``base`` are findings in the text as it stands, ``spans`` these and findings in decoded layers, each
    once. NULL and empty texts have none.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def start():
        def apply(texts: list) -> dict[str, pa.Array]:
            made = [secrets(text) for text in texts]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in both] for both in made]
            return {name: pa.array([r[i] for r in rows], pa.list_(span)) for i, name in enumerate(("base", "spans"))}

        return apply

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, start, f"base {kind}, spans {kind}", text_col, keep)


def redacted(docs: DataFrame, mask: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; spans that touch or overlap are one. NULL stays NULL."""

    def hide(text: str | None) -> str | None:
        out, at = [], 0
        for _, a, b in secrets(text)[1] if text else ():
            if a > at or not out:
                out += [text[at:a], mask]
            at = max(at, b)
        return text if not out else "".join([*out, text[at:]])

    def start():
        return lambda texts: {text_col: pa.array(map(hide, texts), pa.string())}

    return map_texts(docs, start, f"{text_col} string", text_col)


def span_text(spans) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
