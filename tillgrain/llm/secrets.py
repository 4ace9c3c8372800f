"""Secret scans through nested encodings.

A worklist holds layers of a text. Each layer is scanned with the base patterns; its encoded
segments (percent escapes, Unicode escapes and character references, base64, compressed data)
are decoded and join the worklist, until nothing new appears. Texts already seen are not
visited again, which ends cycles. Spans found in a layer are mapped back to the text: escapes
character by character, base64 by groups of four characters, compressed data as a whole.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import documents, slices

# fixed values: kinds in their order, patterns and least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

ESCAPES = re.compile(
    r"%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]{1,7};"
)
# both begin where a run begins, or a long run would be tried from each of its characters
ESCAPED = re.compile(rf"(?<![^\s%\\&])(?:[^\s%\\&]*(?:{ESCAPES.pattern}))+[^\s%\\&]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
COMPRESSED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
PRINTABLE = re.compile(rb"[\x20-\x7e]{12}")
#: compressed layers are scanned in windows of so many bytes that overlap by so many; a layer in
#: them that is longer than the overlap may be cut in two
WINDOW, OVERLAP = 4_000_000, 500_000
#: compressed bytes fed at once
FED = 1 << 16

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those too short are dropped, not retried."""
    found = [
        ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _mapped(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[str, list[int], list[int]]:
    """Bytes as text, given the source of each byte; what is not UTF-8 stays as escaped bytes."""
    text = data.decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    sizes[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    after = np.cumsum(sizes)
    return text, begins[after - sizes].tolist(), ends[after - 1].tolist()


def _unescape(segment: str) -> tuple[str, list[int], list[int]] | None:
    """The segment without escapes; of each character the begin and end of its source."""
    raw, begins, ends, at = bytearray(), [], [], 0

    def plain(begin: int, end: int) -> None:
        for i in range(begin, end):
            data = segment[i].encode("utf-8", "surrogateescape")
            raw.extend(data)
            begins.extend([i] * len(data))
            ends.extend([i + 1] * len(data))

    for match in ESCAPES.finditer(segment):
        plain(at, match.start())
        token = match.group()
        if token[0] == "%" or token[1] == "x":
            data = bytes([int(token[-2:], 16)])
        elif token[0] == "&":
            data = html.unescape(token).encode("utf-8", "replace")
        else:
            point = int(token[2:].strip("{}"), 16)
            data = chr(point).encode("utf-8", "surrogatepass") if point < 0x110000 else token.encode()
        raw.extend(data)
        begins.extend([match.start()] * len(data))
        ends.extend([match.end()] * len(data))
        at = match.end()
    if not at:
        return None
    plain(at, len(segment))
    found = _mapped(bytes(raw), np.array(begins, np.int64), np.array(ends, np.int64))
    return None if found[0] == segment else found


class _Member:
    """One compressed member that begins with a mark: its content in pieces, and how far it reaches.

    A piece is no longer than a window, or what a few blocks hold, whatever the data claims. Data
    that ends early gives what it has; ``failed`` says that it went wrong.
    """

    def __init__(self, data: memoryview):
        self.data, self.size, self.failed = data, 0, False

    def __iter__(self) -> Iterator[bytes]:
        head = bytes(self.data[:6])
        try:
            if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
                yield from self._zlib(zlib.decompressobj(31 if head[0] == 0x1F else 15))
            elif head[:3] == b"BZh":
                yield from self._blocks(bz2.BZ2Decompressor())
            elif head == b"\xfd7zXZ\0":
                yield from self._blocks(lzma.LZMADecompressor())
            else:
                yield from self._frame(zstandard.ZstdDecompressor().decompressobj())
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
            self.failed = True

    def _zlib(self, tool) -> Iterator[bytes]:
        while not tool.eof and self.size < len(self.data):
            part = self.data[self.size : self.size + FED]
            piece = tool.decompress(part, WINDOW)
            self.size += len(part) - len(tool.unused_data if tool.eof else tool.unconsumed_tail)
            yield piece
        while not tool.eof and (piece := tool.decompress(b"", WINDOW)):
            yield piece

    def _blocks(self, tool) -> Iterator[bytes]:
        while not tool.eof and self.size < len(self.data):
            part = self.data[self.size : self.size + FED]
            yield tool.decompress(part, WINDOW)
            while not tool.eof and not tool.needs_input:
                yield tool.decompress(b"", WINDOW)
            self.size += len(part) - len(tool.unused_data)

    def _frame(self, tool) -> Iterator[bytes]:
        while not tool.eof and self.size < len(self.data):
            part = self.data[self.size : self.size + 64]  # at most some twenty blocks of 128 KB
            piece = tool.decompress(part)
            self.size += len(part) - len(tool.unused_data)
            yield piece


def _inflated(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Begin, end and content of compressed data anywhere in ``data``; adjacent members are one.

    A content longer than a window comes in windows that overlap, made in a second run when the
    first has found where the data ends; only one is held. What goes wrong within its first window
    was no compressed data.
    """
    view, at = memoryview(data), 0
    while mark := COMPRESSED.search(data, at):
        begin = end = mark.start()
        held, size = [], 0
        while COMPRESSED.match(data, end):
            member, own, before = _Member(view[end:]), 0, len(held)
            for piece in member:
                own += len(piece)
                if size + own <= WINDOW:
                    held.append(piece)
            if member.failed and own <= WINDOW:
                del held[before:]
                break
            size += own
            end += member.size
            if member.failed or not member.size:
                break
        if 0 < size <= WINDOW:
            yield begin, end, b"".join(held)
        elif size:
            held = []
            for window in _windows(view, begin, end):
                yield begin, end, window
        at = max(end, begin + 1)


def _windows(view: memoryview, at: int, end: int) -> Iterator[bytes]:
    """The content of the members between two places in windows that overlap."""
    window = bytearray()
    while at < end:
        member = _Member(view[at:])
        for piece in member:
            window += piece
            while len(window) >= WINDOW:
                yield bytes(window[:WINDOW])
                del window[: WINDOW - OVERLAP]
        at += max(member.size, 1)
    if len(window) > OVERLAP:
        yield bytes(window)


def _debase(segment: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Base64 data read from each of four offsets, with the source of each character.

    The segment may begin before the data, and may have line breaks. Data without a run of
    printable characters or the mark of a compressed format has no secret.
    """
    places = np.array([i for i, c in enumerate(segment) if c not in "\r\n\t =" ], np.int64)
    whole = "".join(segment.split()).rstrip("=").translate({45: 43, 95: 47})
    for offset in range(4):
        core = whole[offset:]
        core = core[: len(core) - (len(core) % 4 == 1)]
        data = base64.b64decode(core + "=" * (-len(core) % 4))
        if data and (PRINTABLE.search(data) or COMPRESSED.search(data)):
            at = np.arange(len(data)) // 3 * 4 + offset
            until = np.minimum(at + 3, offset + len(core) - 1)
            yield _mapped(data, places[at], places[until] + 1)


class _Same:
    """The one place that all characters of a layer come from."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, _: int) -> int:
        return self.place


Places = list[int] | _Same


def _through(outer: Places, inner: Places, step: int = 0) -> Places:
    """Places of a layer within the text, given those within the layer around it."""
    if isinstance(outer, _Same):
        return outer
    if isinstance(inner, _Same):
        return _Same(outer[inner.place - step])
    return [outer[i - step] for i in inner]


def layers(text: str, decoded: bool = True) -> Iterator[tuple[str, Places, Places, list[Span]]]:
    """Decoded segments of one layer, the source interval of each of their characters, and their spans.

    Escapes are taken out of the whole layer, where spans count that touch one, and out of each
    segment with escapes by itself, where what precedes it cannot hide a span.
    """
    if ("%" in text or "\\" in text or "&#" in text) and (part := _unescape(text)):
        inner, first, last = part
        yield *part, [x for x in base_spans(inner) if any(last[i] - first[i] > 1 for i in range(x[1], x[2]))]
        for match in ESCAPED.finditer(text):
            if part := _unescape(match.group()):
                begin = match.start()
                yield part[0], [b + begin for b in part[1]], [e + begin for e in part[2]], base_spans(part[0])
    for pattern in (BASE64, BASE64_LINES):
        for match in pattern.finditer(text):
            begin = match.start()
            for inner, first, last in _debase(match.group()):
                yield inner, [b + begin for b in first], [e + begin for e in last], base_spans(inner)
    if decoded:
        data = text.encode("utf-8", "surrogateescape")
        for begin, end, content in _inflated(data):
            first = len(data[:begin].decode("utf-8", "surrogateescape"))
            last = max(first + 1, len(text) - len(data[end:].decode("utf-8", "surrogateescape")))
            inner = content.decode("utf-8", "surrogateescape")
            yield inner, _Same(first), _Same(last), base_spans(inner)


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """Base spans and those of decoded layers, as intervals of ``text``."""
    found = list(base)
    seen = {(_digest(text), 0)}
    # depth first, so that one window of each layer is held and not all of them
    work = [(None, None, layers(text, False))]
    while work:
        begins, ends, parts = work[-1]
        part = next(parts, None)
        if part is None:
            work.pop()
            continue
        inner, first, last, spans = part
        if not inner:
            continue
        if begins is not None:
            first, last = _through(begins, first), _through(ends, last, 1)
        mark = (_digest(inner), first[0])
        if mark in seen:
            continue
        seen.add(mark)
        found += [(kind, first[s], last[e - 1]) for kind, s, e in spans]
        work.append((first, last, layers(inner)))
    return in_order(found)


def _digest(text: str) -> int:
    return xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            text = text or ""
            base = base_spans(text)
            kinds = [kind for kind, _, _ in base]
            for kind in KINDS:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(all_spans(text, base)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)],
            ],
            names=["doc_id", *out],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and all spans of each document.

    Null counts as empty; empty texts have no spans. Every row is scanned by itself. Only doc_id
    and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        _scan,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )


def op6_layered_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(documents(spark, folder))
