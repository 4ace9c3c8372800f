"""Token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as bit-planes: plane 0 has the highest bit of
every id in order, and each further plane has the next bit after a stable partition by the one
before. Planes are stored in compressed blocks with the number of ones before each, so access,
counting and the search for occurrences read a few blocks per plane. Documents lie in ascending
doc_id order within and across shards.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillgrain.llm.common import documents, slices, texts_of, width
from tillgrain.session import Scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 16
CACHED_WORDS = 1_000_000
MAGIC = b"WMTX0001"
HEADER = struct.Struct("<8sIIQQQI")  # magic, part, number, tokens, documents, block bits, planes


class Cache(dict):
    """What ``make`` gives for each key, made on demand and emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class WordIds(Cache):
    """Ids of white-space-delimited words.

    The tokenizer's rules never look across ASCII white space, so a text's ids are its words'
    ids in order. Words of Latin letters, digits and signs are lower-cased and split here by the
    tokenizer's own pattern; their pieces, which far fewer words share, go straight to its model.
    All other words, and those with one of its added tokens, take its whole way.
    """

    def __init__(self, vocabulary: str):
        super().__init__(self.ids, CACHED_WORDS)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        # fixed values: the pattern of the vocabulary's pre-tokenizer, with the letters and numbers
        # that lower-cased Latin-1 has, and the byte alphabet
        letter, number = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
        self.splits = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.plain = re.compile(r"[\x21-\x7e¡-ÿ]+").fullmatch
        added = [re.escape(token.content.lower()) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)").search
        self.pieces = Cache(self.piece, CACHED_WORDS)

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return np.array([token.id for token in self.model.tokenize(shown)], "<u2").tobytes()

    def ids(self, word: bytes) -> bytes:
        text = word.decode()
        lowered = text.lower()
        if self.plain(text) and not self.added(lowered):
            return b"".join(map(self.pieces.__getitem__, self.splits(lowered)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@functools.cache
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def encode(text: bytes, vocabulary: str) -> np.ndarray:
    """Ids of a whole text; they fit 16 bits."""
    found = word_ids(vocabulary)
    return np.frombuffer(b"".join(map(found.__getitem__, text.split())), "<u2")


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, part: int, number: int) -> bytes:
    """The shard file of ``ids``, which are the documents' ids one after another."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    body, directory = [], []
    order = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes):
        ones = (order >> order.dtype.type(planes - 1 - plane)) & order.dtype.type(1) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        before = 0
        rows = []
        for at in range(0, len(packed), BLOCK_BITS // 8):
            block = packed[at : at + BLOCK_BITS // 8]
            small = squeeze(block)
            rows.append((before, len(small)))
            before += int(np.bitwise_count(np.frombuffer(block, np.uint8)).sum())
            body.append(small)
        directory.append(np.array(rows, "<u8").reshape(-1, 2))
        order = np.concatenate((order[~ones], order[ones]))
    lists = [
        squeeze(np.asarray(doc_ids, "<i8").tobytes()),
        squeeze(np.asarray(counts, "<u8").tobytes()),
        squeeze(b"".join(d.tobytes() for d in directory)),
    ]
    head = HEADER.pack(MAGIC, part, number, len(ids), len(doc_ids), BLOCK_BITS, planes)
    return b"".join([head, struct.pack("<3Q", *map(len, lists)), *lists, *body])


class Shard:
    """Random access to one shard file; ``data`` may be a memory map."""

    def __init__(self, data: bytes):
        self.data = data
        magic, self.part, self.number, self.size, docs, self.block, self.planes = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEADER.size + 24
        lists = []
        for length in struct.unpack_from("<3Q", data, HEADER.size):
            lists.append(zstandard.decompress(data[at : at + length]))
            at += length
        self.doc_ids = np.frombuffer(lists[0], "<i8")
        self.ends = np.cumsum(np.frombuffer(lists[1], "<u8").astype(np.int64))
        table = np.frombuffer(lists[2], "<u8").astype(np.int64).reshape(self.planes, -1, 2)
        self.before = table[:, :, 0]
        self.place = at + np.append(0, np.cumsum(table[:, :, 1].ravel()))
        self._cached: dict[int, np.ndarray] = {}
        self.zeros = [self.size - self._ones(p, self.size) for p in range(self.planes)]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        at = plane * self.before.shape[1] + block
        if at not in self._cached:
            if len(self._cached) > 64:
                self._cached.clear()
            packed = zstandard.decompress(self.data[self.place[at] : self.place[at + 1]])
            count = min(self.block, self.size - block * self.block)
            self._cached[at] = np.unpackbits(np.frombuffer(packed, np.uint8), count=count, bitorder="little")
        return self._cached[at]

    def _ones(self, plane: int, end: int) -> int:
        """Ones of a plane before ``end``."""
        if not end:
            return 0
        block = (end - 1) // self.block
        return int(self.before[plane, block]) + int(self._bits(plane, block)[: end - block * self.block].sum())

    def _find(self, plane: int, bit: int, rank: int) -> int:
        """Place of the ``rank``-th bit of that kind."""
        before = self.before[plane] if bit else np.arange(self.before.shape[1]) * self.block - self.before[plane]
        block = int(np.searchsorted(before, rank, side="right")) - 1
        inside = np.flatnonzero(self._bits(plane, block) == bit)
        return block * self.block + int(inside[rank - int(before[block])])

    def access(self, place: int) -> int:
        """The id at a place."""
        value = 0
        for plane in range(self.planes):
            bit = int(self._bits(plane, place // self.block)[place % self.block])
            value = value * 2 + bit
            ones = self._ones(plane, place)
            place = self.zeros[plane] + ones if bit else place - ones
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            low, high = self._ones(plane, begin), self._ones(plane, end)
            if token >> (self.planes - 1 - plane) & 1:
                begin, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of an id within [begin, end), as far as there are places."""
        last = self.size if end is None else min(end, self.size)
        low, high = self._range(token, min(begin, last), last)
        return high - low

    def occurrence(self, token: int, rank: int) -> int:
        """Place of the ``rank``-th occurrence of an id, from 0."""
        low, high = self._range(token, 0, self.size)
        if not 0 <= rank < high - low:
            raise IndexError(rank)
        place = low + rank
        for plane in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - plane) & 1
            place = self._find(plane, bit, place - self.zeros[plane] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.size, kind)
        blocks = self.before.shape[1]
        for plane in reversed(range(self.planes)):
            packed = b"".join(
                zstandard.decompress(self.data[self.place[at] : self.place[at + 1]])
                for at in range(plane * blocks, (plane + 1) * blocks)
            )
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.size, bitorder="little").astype(bool)
            up = np.empty(self.size, kind)
            up[ones] = values[self.zeros[plane] :] | kind(1 << (self.planes - 1 - plane))
            up[~ones] = values[: self.zeros[plane]]
            values = up
        return values


def _store(folder: str, name: str, data: bytes) -> str:
    """Write a file under its final name only when it is whole, so that a retried task may repeat it."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    context = TaskContext.get()
    draft = f"{root}/.{name}.{context.taskAttemptId() if context else 0}"
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, f"{root}/{name}")
    return f"{folder}/{name}"


def _shards(folder: str, vocabulary: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, np.ndarray]] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            counts = np.array([len(x) for _, x in held])
            doc_ids = np.array([i for i, _ in held])
            data = write_shard(ids, doc_ids, counts, part, number)
            path = _store(folder, f"shard-{part:05d}-{number:06d}.wmx", data)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "path": path, "tokens": len(ids), "bytes": len(data)}],
                schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("bytes", pa.int64())]),
            )

        end = np.array([end_id], np.uint16)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, texts_of(batch), strict=True):
                found = np.concatenate((encode(text, vocabulary), end))
                held.append((doc_id, found))
                size += len(found)
                if size >= most:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def write_shards(
    docs: DataFrame, scratch: Scratch, folder: str | None = None, vocabulary: str = VOCABULARY,
    end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all documents as shards and return their list.

    One row per file: part, number, path, tokens, bytes. Documents are range-partitioned by
    doc_id and sorted; rows that share a doc_id go by their text, and rows without one come
    first, as the smallest number. Null texts count as empty. A shard ends after the document
    that fills it. ``folder`` must be writable from all executors.
    """
    folder = folder or scratch.folder()
    first = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    ranged = (
        docs.select(first.alias("doc_id"), "text")
        .repartitionByRange(width(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return scratch.write(
        ranged.mapInArrow(
            _shards(folder, vocabulary, end_id, shard_tokens),
            "part int, number int, path string, tokens bigint, bytes bigint",
        )
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            files, place = fs.FileSystem.from_uri(path)
            with files.open_input_file(place) as source:
                shard = Shard(source.read())
            ids = shard.ids().astype("<u4")
            starts = np.append(0, shard.ends[:-1])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, shard.ends, strict=True)]
            size = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, shard.part, np.int32)),
                    pa.array(np.full(size, shard.number, np.int32)),
                    pa.array(shard.doc_ids),
                    pa.array(starts),
                    pa.array(shard.ends - starts),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("held"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    placed = shards.select(
        "part", "number", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside")
    ).join(offsets, "part")
    found = (
        shards.select("path")
        .repartition(width(shards.sparkSession))
        .mapInArrow(_read, "part int, number int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    )
    none = F.when(F.col("doc_id") > -(2**63), F.col("doc_id"))
    # what the files hold is far more than the list of files lets Spark expect: no broadcast
    return found.join(placed.hint("merge"), ["part", "number"]).select(
        none.alias("doc_id"),
        (F.col("offset") + F.col("inside") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def op1_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    return read_shards(write_shards(documents(spark, folder), scratch))
