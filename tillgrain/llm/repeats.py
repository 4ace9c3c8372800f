"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Tasks hash all windows of their documents and pack the hashes by bucket; a shuffle brings equal
windows together; each bucket tells, per document, which windows start somewhere earlier too.
Those windows merge into maximal removal intervals.

A window is known by 64 bits of one polynomial and, through its bucket, by further bits of
another, so with B buckets two different windows agree with probability 2^-64 / B.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import documents, mix, slices, texts_of, width, word_hashes

WINDOW = 20
#: bytes of text whose windows are compared with each other before anything is shuffled
SLICE = 12_000_000
#: bytes of text whose windows, five times as large, are compared with each other in one group
BUCKET_TEXT = 24_000_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

PACKED = "bucket int, hashes binary, gaps binary, doc_ids binary, text_keys binary, bases binary, counts binary, known boolean"
REPLY = "part int, doc_ids binary, text_keys binary, counts binary, starts binary"
FOUND = "doc_id bigint, text_key int, begins array<bigint>, ends array<bigint>"


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) % 2**64)


def rolling(values: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of each run of ``window`` values.

    Doubling: the hash of 2n values follows from two hashes of n, so a window costs a few
    passes over the array whatever its length.
    """
    if len(values) < window:
        return np.zeros(0, np.uint64)
    result, done = None, 0
    part, size, power = values, 1, base
    left = window
    while left:
        if left & 1:
            if result is None:
                result, done, shift = part, size, power
            else:
                count = len(values) - done - size + 1
                result = part[:count] * shift + result[size : size + count]
                done, shift = done + size, _times(shift, power)
        left >>= 1
        if left:
            count = len(part) - size
            part = part[:count] * power + part[size : size + count]
            size, power = size * 2, _times(power, power)
    return result


def pack(window: int, buckets: int):
    """Windows of each slice of documents, packed by bucket; repeats within the slice are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PACKED.split(", ")]
        for batch in slices(batches, SLICE):
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            keys = batch.column(batch.schema.get_field_index("text_key")).to_numpy(zero_copy_only=False)
            texts = texts_of(batch)
            order = np.lexsort((keys, ids))
            fresh = np.ones(len(order), bool)  # rows that repeat doc_id and text are one document
            fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
            order = order[fresh]
            ids, keys = ids[order], keys[order]
            per_doc = [word_hashes(texts[i].split()) for i in order]
            lengths = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
            begins = np.cumsum(lengths) - lengths
            values = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint64)
            windows = np.maximum(lengths - window + 1, 0)
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), windows)
            starts = np.arange(len(owner)) + (begins - (np.cumsum(windows) - windows))[owner]
            first = rolling(values, window, BASES[0])[starts] if len(starts) else np.zeros(0, np.uint64)
            second = mix(rolling(values, window, BASES[1])[starts]) if len(starts) else first
            bucket = ((second >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            repeat = _seen_before(first, second)
            for known in (False, True):
                chosen = np.flatnonzero(repeat == known)
                # what is known already only passes through: spread by document
                into = owner[chosen] % buckets if known else bucket[chosen]
                chosen = chosen[np.argsort(into, kind="stable")]
                into = np.sort(into)
                edges = np.flatnonzero(np.diff(into, prepend=-1, append=buckets + 1))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    part = chosen[low:high]
                    docs, counts = np.unique(owner[part], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(into[low])], pa.int32()),
                            pa.array([b"" if known else first[part].tobytes()], pa.binary()),
                            pa.array([_gaps(starts[part])], pa.binary()),
                            pa.array([_gaps(ids[docs])], pa.binary()),
                            pa.array([keys[docs].tobytes()], pa.binary()),
                            pa.array([_gaps(begins[docs])], pa.binary()),
                            pa.array([_narrow(counts)], pa.binary()),
                            pa.array([known], pa.bool_()),
                        ],
                        names=names,
                    )

    return run


def _seen_before(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which hash pairs occur at a smaller index."""
    order = np.argsort(first)
    heads = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1])) if len(order) else order
    leader = np.minimum.reduceat(order, heads) if len(order) else order
    leader = np.repeat(leader, np.diff(np.append(heads, len(order))))
    again = np.zeros(len(order), bool)
    again[order] = (leader != order) & (second[leader] == second[order])
    return again


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest type that holds them, after a byte that names it."""
    most = int(values.max(initial=0))
    kind = np.dtype(np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def _gaps(places: np.ndarray) -> bytes:
    """Ascending numbers as the first one and the gaps."""
    return int(places[0]).to_bytes(8, "little", signed=True) + _narrow(np.diff(places).astype(np.uint64))


def _places(packed: bytes) -> np.ndarray:
    gaps = np.append(int.from_bytes(packed[:8], "little", signed=True), _wide(packed[8:]))
    return np.cumsum(gaps.astype(np.int64))


def later(parts: int):
    """Of one bucket: the windows that start earlier too, packed by part of the documents.

    Order is (doc_id, text key, start). Each pack holds a window at most once.
    """

    def run(table: pa.Table) -> pa.Table:
        packs = []
        for row in table.to_pylist():
            counts = _wide(row["counts"])
            packs.append(
                (
                    np.frombuffer(row["hashes"], np.uint64),
                    _places(row["gaps"]) - np.repeat(_places(row["bases"]), counts),
                    np.repeat(_places(row["doc_ids"]), counts),
                    np.repeat(np.frombuffer(row["text_keys"], np.int32), counts),
                    np.full(counts.sum(), row["known"]),
                )
            )
        hashes, starts, ids, keys, known = (np.concatenate(x) for x in zip(*packs, strict=True))
        del packs
        open_ = np.flatnonzero(~known)
        # only hashes that occur twice need their full order
        by_hash = np.argsort(hashes)
        same = hashes[by_hash][1:] == hashes[by_hash][:-1]
        twice = np.zeros(len(by_hash), bool)
        twice[1:] |= same
        twice[:-1] |= same
        rows = by_hash[twice]
        places = open_[rows]
        full = np.lexsort((starts[places], keys[places], ids[places], hashes[rows]))
        rows, places = rows[full], places[full]
        fresh = np.append(True, hashes[rows][1:] != hashes[rows][:-1]) if len(rows) else np.zeros(0, bool)
        head = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        itself = (ids[places] == ids[head]) & (keys[places] == keys[head]) & (starts[places] == starts[head])
        removed = np.concatenate((places[~itself], np.flatnonzero(known)))
        part = (mix(ids[removed].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((starts[removed], keys[removed], ids[removed], part))
        removed, part = removed[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
        replies = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            at = removed[low:high]
            heads = _heads(ids[at], keys[at])
            replies.append(
                (
                    int(part[low]),
                    _gaps(ids[at][heads]),
                    keys[at][heads].tobytes(),
                    _narrow(np.diff(np.append(heads, len(at)))),
                    _narrow(starts[at]),
                )
            )
        columns = list(zip(*replies, strict=True)) if replies else [[]] * 5
        kinds = [pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in REPLY.split(", ")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def _heads(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return np.flatnonzero(fresh)


def merged(window: int):
    """Of one part of the documents: removal intervals per document."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, starts = [], [], []
        for row in table.to_pylist():
            counts = _wide(row["counts"])
            ids.append(np.repeat(_places(row["doc_ids"]), counts))
            keys.append(np.repeat(np.frombuffer(row["text_keys"], np.int32), counts))
            starts.append(_wide(row["starts"]))
        ids, keys, starts = (np.concatenate(x) for x in (ids, keys, starts))
        order = np.lexsort((starts, keys, ids))
        ids, keys, starts = ids[order], keys[order], starts[order]
        heads = _heads(ids, keys)
        # an interval ends where the next start lies beyond the window or in another document
        opens = np.ones(len(starts), bool)
        opens[1:] = np.diff(starts) > window
        opens[heads] = True
        begins = np.flatnonzero(opens)
        ends = starts[np.append(begins[1:], len(starts)) - 1] + window
        lists = np.append(np.searchsorted(begins, heads), len(begins)).astype(np.int32)
        return pa.table(
            {
                "doc_id": pa.array(ids[heads]),
                "text_key": pa.array(keys[heads]),
                "begins": pa.ListArray.from_arrays(lists, starts[begins]),
                "ends": pa.ListArray.from_arrays(lists, ends),
            }
        )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the word intervals covered by windows of ``window`` words that start earlier too.

    One row (doc_id, text_key, begins, ends) for each document that has such windows. Earlier
    means a smaller doc_id or, in one document, a smaller start; rows that share a doc_id go by
    their text keys, and rows that share both are one document.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a partition's bucket does not outgrow a task with the corpus
    buckets = max(width(docs.sparkSession), -(-size // BUCKET_TEXT))
    packed = docs.select("doc_id", "text_key", "text").mapInArrow(pack(window, buckets), PACKED)
    replies = packed.groupBy("bucket").applyInArrow(later(buckets), REPLY)
    return replies.groupBy("part").applyInArrow(merged(window), FOUND)


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = {"n_words": [], "n_removed": [], "kept_text": []}
        begins, ends = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("begins", "ends"))
        for text, opened, closed in zip(texts_of(batch), begins, ends, strict=True):
            words = text.split()
            kept = words
            if opened:
                edges = zip([0, *closed], [*opened, len(words)], strict=True)
                kept = [word for a, b in edges for word in words[a:b]]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["kept_text"], pa.string()),
                batch.column(batch.schema.get_field_index("begins")),
                batch.column(batch.schema.get_field_index("ends")),
            ],
            names=["doc_id", *out, "begins", "ends"],
        )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed word intervals of each document.

    Null and empty texts have no words. Documents of fewer words than a window are kept whole.
    Rows that repeat doc_id and text count as one document and get equal results; rows without
    a doc_id come first. Only doc_id and text are read.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("real_id"), "text").select(
        "real_id",
        F.coalesce("real_id", F.lit(-(2**63))).alias("doc_id"),
        F.hash(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )
    found = repeated_windows(keyed, window)
    joined = keyed.join(found, ["doc_id", "text_key"], "left")
    return joined.select(F.col("real_id").alias("doc_id"), "text", "begins", "ends").mapInArrow(
        _trim,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, begins array<bigint>, ends array<bigint>",
    )


def op9_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(documents(spark, folder))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
