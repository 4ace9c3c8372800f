"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into chunks that overlap. All chunks are pre-tokenised in parallel; where the
pre-token boundaries of two neighbours agree inside their overlap they have resynchronised, and
the text is cut there. The pieces between cuts are encoded in parallel and joined in order.
Texts of one chunk, and the rare ones without a common boundary, are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import documents, released, slices, with_digest
from tillgrain.session import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: characters of a chunk and of the overlap on either side of each chunk border
CHUNK = 16_384
OVERLAP = 512
#: a boundary this near a chunk's end may still depend on what follows: the longest contraction
TAIL = 3



@functools.cache
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode(text: str, ranks: str, pattern: str) -> np.ndarray:
    return np.array(encoding(ranks, pattern).encode_ordinary(text), np.uint32)


def boundaries(text: str, pattern: str, begin: int, end: int, last: bool) -> list[int]:
    """Pre-token starts within [begin, end) that no text behind this chunk can move."""
    safe = len(text) + 1 if last else len(text) - TAIL
    found = []
    for match in splitter(pattern).finditer(text):
        at = match.start()
        if at >= end or at > safe:
            break
        if at >= begin:
            found.append(at)
    return found


def chunk_rows(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk: its number, where its slice begins, and the slice with both overlaps."""
    size = F.char_length("text")
    count = F.ceil(size / chunk).cast("int")
    place = F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk")
    begin = F.greatest(F.col("chunk") * chunk - overlap, F.lit(0))
    end = F.least((F.col("chunk") + 1) * chunk + overlap, F.col("size"))
    return (
        long.select("doc_id", "text_key", "text", size.alias("size"), count.alias("chunks"), place)
        .withColumn("begin", begin)
        .select(
            "doc_id", "text_key", "chunk", "chunks", "size", "begin",
            F.col("text").substr(F.col("begin") + 1, end - F.col("begin")).alias("text"),
        )
    )


def _edges(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = [], []
            rows = batch.select(["chunk", "chunks", "begin", "text"]).to_pylist()
            for row in rows:
                number, begin = row["chunk"], row["begin"]
                last = number == row["chunks"] - 1
                for side, border in ((left, number), (right, number + 1)):
                    zone = border * chunk
                    found = []
                    if 0 < border < row["chunks"]:
                        found = boundaries(row["text"], pattern, zone - overlap - begin, zone + overlap - begin, last)
                    side.append([at + begin for at in found])
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(left, whole), pa.array(right, whole)],
                names=[*batch.schema.names, "left", "right"],
            )

    return run


def _encode(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = [encode(t or "", ranks, pattern).astype("<u4").tobytes() for t in texts]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(ids, pa.binary())], names=[*keep, "ids"]
            )

    return run


def encode_documents(
    docs: DataFrame,
    scratch: Scratch,
    ranks: str = RANKS,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, text_key and ids (little-endian unsigned 32-bit) of each row.

    Null counts as empty and has no ids. Rows that repeat doc_id and text give one row each.
    The file at ``ranks`` must be present on every executor.
    """
    keyed = with_digest(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    key = "doc_id bigint, text_key bigint"
    is_long = F.char_length("text") > chunk
    short = keyed.filter(~is_long).mapInArrow(released(_encode(ranks, pattern)), f"{key}, ids binary")

    pieces = scratch.write(
        chunk_rows(keyed.filter(is_long), chunk, overlap)
        .repartition("doc_id", "text_key", "chunk")
        .mapInArrow(
            _edges(pattern, chunk, overlap),
            f"{key}, chunk int, chunks int, size int, begin int, text string, left array<bigint>, right array<bigint>",
        ),
        compression="zstd",
    ).dropDuplicates(["doc_id", "text_key", "chunk"])
    same = ["doc_id", "text_key", "chunk"]
    borders = pieces.select("doc_id", "text_key", F.col("chunk"), "left").join(
        pieces.select("doc_id", "text_key", (F.col("chunk") + 1).alias("chunk"), "right"), same
    )
    cuts = scratch.write(
        borders.select(*same, F.array_min(F.array_intersect("left", "right")).alias("cut"))
    )
    broken = cuts.filter("cut is null").select("doc_id", "text_key").distinct()
    from_ = cuts.withColumnRenamed("cut", "from")
    to = cuts.select("doc_id", "text_key", (F.col("chunk") - 1).alias("chunk"), F.col("cut").alias("to"))
    first, after = F.coalesce("from", F.lit(0)), F.coalesce("to", F.col("size"))
    stitched = (
        pieces.join(broken, ["doc_id", "text_key"], "left_anti")
        .join(from_, same, "left")
        .join(to, same, "left")
        .select(
            "doc_id", "text_key", "chunk",
            F.col("text").substr((first - F.col("begin") + 1).cast("int"), (after - first).cast("int")).alias("text"),
        )
        .mapInArrow(released(_encode(ranks, pattern)), f"{key}, chunk int, ids binary")
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
        .select("doc_id", "text_key", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex"))
        .select("doc_id", "text_key", F.unhex("hex").alias("ids"))
    )
    rest = (
        keyed.filter(is_long)
        .join(broken, ["doc_id", "text_key"], "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .mapInArrow(released(_encode(ranks, pattern)), f"{key}, ids binary")
    )
    times = keyed.filter(is_long).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).cast("int").alias("times"))
    long = stitched.unionByName(rest).join(times, ["doc_id", "text_key"])
    repeated = long.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "text_key", "ids")
    return short.unionByName(repeated)


def _decode(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = encoding(ranks, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            out = {"n_tokens": [], "ids_sha256": [], "decoded": []}
            for packed in column.to_pylist():
                ids = np.frombuffer(packed, "<u4")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded"].append(decoder.decode_bytes(ids.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(out["n_tokens"], pa.int64()),
                    pa.array(out["ids_sha256"], pa.string()),
                    column,
                    pa.array(out["decoded"], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "ids", "decoded"],
            )

    return run


def decode_documents(encoded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, ids and the decoded bytes: raw token bytes, concatenated."""
    return encoded.select("doc_id", "ids").mapInArrow(
        _decode(ranks, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, ids binary, decoded binary"
    )


def tokens(docs: DataFrame, scratch: Scratch) -> DataFrame:
    decoded = decode_documents(encode_documents(docs, scratch))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(documents(spark, folder), Scratch(spark))
