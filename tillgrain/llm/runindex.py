"""Suffix-array dedup with run-length compressed Burrows-Wheeler indexes.

A string of ``length`` bytes can only repeat where its anchor does: the smallest hash among its
grams of ``gram`` bytes. All string starts that share one anchor are neighbours and form a
segment, so the strings of a document are split among its segments, and equal strings lie in
segments with equal anchors. Spark counts anchors and segments. A segment that occurs twice in
full is removed in full. Of the others with a repeated anchor, one copy each is gathered, by
anchor, into indexes of bounded size. An index is the Burrows-Wheeler transform of its
segments, run-compressed, with suffixes sampled at run ends; matching statistics against all
other suffixes stream from those samples, and strings matched over the full length are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import cover, documents, mix, slices, spans_of, texts_of, width
from tillgrain.llm.repeats import BASES, rolling
from tillgrain.session import Scratch

LENGTH = 400
GRAM = 100
#: bytes of segments in one index, and beyond which one anchor's segments are counted by window
INDEX_BYTES = 2_000_000
CROWDED_BYTES = 4_000_000

SEGMENTS = "doc_id bigint, text_key bigint, begin int, last int, anchor bigint, content bigint"


def minimizers(values: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a run of ``length`` values, the place of its smallest gram; gram hashes.

    Hashes are compared by 40 bits and equal ones by place, so the answer depends on nothing
    but the run itself.
    """
    hashes = mix(rolling(values, gram, BASES[0]))
    keyed = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    reach = length - gram + 1
    rows = -(-len(keyed) // reach)
    padded = np.full(rows * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(rows, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(values) - length + 1
    best = np.minimum(behind[:starts], ahead[reach - 1 : reach - 1 + starts])
    return (best & np.uint64(0xFFFFFF)).astype(np.int64), hashes


def segments(length: int, gram: int):
    """Segments of each document: first and last string start, anchor hash, content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SEGMENTS.split(", ")]
        for batch in slices(batches, 4_000_000):
            texts = texts_of(batch)
            found = []
            for part, offset in _pieces(texts, length):
                data = np.frombuffer(part[0], np.uint8).astype(np.uint64) + np.uint64(1)
                owner, starts = part[1], part[2]
                if not len(starts):
                    continue
                places, hashes = minimizers(data, length, gram)
                places = places[starts]
                fresh = np.ones(len(starts), bool)
                fresh[1:] = (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(starts)) - 1
                view = memoryview(part[0])
                contents = np.fromiter(
                    (
                        xxhash.xxh3_64_intdigest(view[a : b + length])
                        for a, b in zip(starts[heads].tolist(), starts[tails].tolist(), strict=True)
                    ),
                    np.uint64,
                    len(heads),
                )
                base = part[3][owner[heads]] - offset
                found.append(
                    (
                        owner[heads],
                        (starts[heads] - base).astype(np.int32),
                        (starts[tails] - base).astype(np.int32),
                        hashes[places[heads]].astype(np.int64),
                        contents.astype(np.int64),
                    )
                )
            if not found:
                continue
            owner, begin, last, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).take(take),
                    batch.column(batch.schema.get_field_index("text_key")).take(take),
                    pa.array(begin),
                    pa.array(last),
                    pa.array(anchor),
                    pa.array(content),
                ],
                names=names,
            )

    return run


def _pieces(texts: list[bytes], length: int):
    """Joined texts with, for every valid string start, its document; long texts come in parts.

    Places fit 24 bits. A part of a long text begins well before the first start it answers
    for, so that a segment is cut nowhere but at part ends; a segment cut in two stays right,
    as each of its strings still belongs to one segment with the same anchor.
    """
    most = 8_000_000
    short = [i for i, t in enumerate(texts) if length <= len(t) <= most]
    if short:
        sizes = np.array([len(texts[i]) for i in short])
        begins = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.array(short), counts)
        starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
        base = np.zeros(len(texts), np.int64)
        base[short] = begins
        joined = b"".join(texts[i] for i in short)
        yield (joined, owner, starts, base), 0
    for i, text in enumerate(texts):
        if len(text) > most:
            for at in range(0, len(text) - length + 1, most):
                part = text[at : at + most + length - 1]
                count = len(part) - length + 1
                base = np.zeros(len(texts), np.int64)
                yield (part, np.full(count, i), np.arange(count), base), at


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a list of strings, each with its own end.

    ``run_heads`` are the ranks at which the transform changes, ``run_bytes`` its bytes there
    and ``head_suffixes`` the suffixes at those ranks. ``matched`` gives for each place of the
    joined strings how far it matches the suffix that is nearest in order, up to the end of
    its string.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        order = self._suffix_order(sizes)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        before = self.text[order - 1].astype(np.int16)
        edge = np.zeros(len(self.text) + 1, bool)
        edge[self.begins] = True
        before[edge[order]] = -1  # a string's first suffix continues nothing
        change = np.ones(len(order), bool)
        change[1:] = (before[1:] != before[:-1]) | (before[1:] == -1)
        self.run_heads = np.flatnonzero(change)
        self.run_bytes = before[self.run_heads]
        self.head_suffixes = order[self.run_heads]
        self._stream(order)

    def _suffix_order(self, sizes: np.ndarray) -> np.ndarray:
        """Suffixes in order, by prefix doubling over those whose place is still open."""
        n, m = len(self.text), len(sizes)
        symbol = self.text.astype(np.int64) + m
        symbol[self.ends] = np.arange(m)
        rank = symbol
        order, size = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank[order], order)
        open_ = np.arange(n)
        while True:
            ordered = np.sort(rank[open_])
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if not len(twice):
                break
            tied = np.zeros(n + 1, bool)
            tied[twice] = True
            open_ = open_[tied[rank[open_]]]
            # equal over ``size`` symbols means that neither reaches its end before
            key = rank[open_] * (n + 1) + rank[np.minimum(open_ + size, n - 1)]
            by = np.argsort(key)
            key, places = key[by], open_[by]
            group = np.append(True, rank[places][1:] != rank[places][:-1])
            index = np.arange(len(places))
            start = np.maximum.accumulate(np.where(group, index, 0))
            fresh = np.append(True, key[1:] != key[:-1])
            place = np.maximum.accumulate(np.where(fresh, index, 0))
            rank[places] += place - start
            size *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order

    @staticmethod
    def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        return rank

    def _stream(self, order: np.ndarray, step: int = 200_000) -> None:
        """Match lengths from the run heads.

        Within a run, the suffix one byte earlier has the neighbour one byte earlier, so its
        match is one longer. Only at run heads are bytes compared.
        """
        n = len(self.text)
        left = np.repeat(self.ends, self.ends - self.begins + 1) - np.arange(n)
        heads = self.run_heads[self.run_heads > 0]
        a, b = order[heads], order[heads - 1]
        depth = np.minimum(left[a], left[b])
        agreed = np.zeros(len(heads), np.int64)
        alive = np.arange(len(heads))
        width_ = 16
        padded = np.append(self.text, np.zeros(64, np.uint8))
        while len(alive):
            size = agreed[alive]
            span = np.arange(width_)
            same = np.empty(len(alive), np.int64)
            for at in range(0, len(alive), step):
                part = slice(at, at + step)
                x = padded[(a[alive[part]] + size[part])[:, None] + span] != padded[(b[alive[part]] + size[part])[:, None] + span]
                same[part] = np.where(x.any(axis=1), x.argmax(axis=1), width_)
            agreed[alive] = np.minimum(size + same, depth[alive])
            alive = alive[(same == width_) & (agreed[alive] < depth[alive])]
        known = np.full(n, -1, np.int64)
        known[order[0]] = 0
        known[a] = agreed
        at = np.maximum.accumulate(np.where(known >= 0, np.arange(n), 0))
        before = known[at] - (np.arange(n) - at)
        after = np.zeros(n, np.int64)
        after[order[:-1]] = before[order[1:]]
        self.matched = np.maximum(before, after)


def _marks(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids, keys, begins, alone = (table.column(c).to_numpy() for c in ("doc_id", "text_key", "begin", "alone"))
        index = RunIndex(table.column("bytes").to_pylist())
        out = {"doc_id": [], "text_key": [], "begin": [], "end": []}
        hits = index.matched >= length
        for i in np.flatnonzero(alone):
            # starts of one string's suffixes, then the bytes they cover
            for a, b in zip(*spans_of(hits[index.begins[i] : index.ends[i]]), strict=True):
                out["doc_id"].append(ids[i])
                out["text_key"].append(keys[i])
                out["begin"].append(begins[i] + a)
                out["end"].append(begins[i] + b - 1 + length)
        kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "begin": pa.int64(), "end": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def _fetch(length: int, crowded: bool):
    """The bytes of the asked segments; of crowded anchors, the hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4_000_000):
            texts = texts_of(batch)
            wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            keys = batch.column(batch.schema.get_field_index("text_key")).to_pylist()
            rows = [
                (i, k, w["begin"], w["bucket"], w["alone"], t[w["begin"] : w["last"] + length])
                for i, k, t, ws in zip(ids, keys, texts, wanted, strict=True)
                for w in ws
                if w["crowded"] == crowded
            ]
            if not rows:
                continue
            if not crowded:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                names = ["doc_id", "text_key", "begin", "bucket", "alone", "bytes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )
                continue
            for i, k, begin, _, alone, data in rows:
                values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
                first, second = (mix(rolling(values, length, base)) for base in BASES)
                count = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, i), pa.int64()),
                        pa.array(np.full(count, k), pa.int64()),
                        pa.array(begin + np.arange(count), pa.int64()),
                        pa.array(np.full(count, alone), pa.bool_()),
                        pa.array(first.astype(np.int64)),
                        pa.array(second.astype(np.int64)),
                    ],
                    names=["doc_id", "text_key", "begin", "alone", "first", "second"],
                )

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, begin, end): intervals covered by strings that start elsewhere too."""
    spark = docs.sparkSession
    found = scratch.write(
        docs.select("doc_id", "text_key", "text").mapInArrow(segments(length, gram), SEGMENTS),
        compression="zstd",
    )
    shared = scratch.write(
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("mixed"))
        .filter("n > 1")
        .drop("n")
    )
    alive = scratch.write(found.join(shared, "anchor"), compression="zstd")
    scratch.drop(found)
    place = F.struct("doc_id", "text_key", "begin", "last")
    classes = scratch.write(
        alive.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.first("mixed").alias("mixed")
        ),
        compression="zstd",
    )
    twice = classes.filter("n > 1").select("anchor", "content")
    full = alive.join(twice, ["anchor", "content"], "left_semi").select(
        "doc_id", "text_key", F.col("begin").cast("bigint"), (F.col("last") + length).cast("bigint").alias("end")
    )
    mixed = classes.filter("mixed")
    size = F.col("at.last") - F.col("at.begin") + length
    heavy = mixed.groupBy("anchor").agg(F.sum(size).alias("held")).filter(F.col("held") > CROWDED_BYTES)
    total = mixed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(width(spark), total // INDEX_BYTES + 1)
    asked = (
        mixed.join(heavy.select("anchor", F.lit(True).alias("crowded")), "anchor", "left")
        .select(
            "at.doc_id",
            "at.text_key",
            F.struct(
                "at.begin",
                "at.last",
                F.pmod("anchor", F.lit(buckets)).cast("int").alias("bucket"),
                (F.col("n") == 1).alias("alone"),
                F.coalesce("crowded", F.lit(False)).alias("crowded"),
            ).alias("one"),
        )
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list("one").alias("wanted"))
    )
    texts = docs.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted")
    indexed = (
        texts.mapInArrow(
            _fetch(length, False),
            "doc_id bigint, text_key bigint, begin bigint, bucket int, alone boolean, bytes binary",
        )
        .groupBy("bucket")
        .applyInArrow(_marks(length), "doc_id bigint, text_key bigint, begin bigint, end bigint")
    )
    marks = full.unionByName(indexed)
    if not heavy.isEmpty():
        strings = scratch.write(
            texts.mapInArrow(
                _fetch(length, True),
                "doc_id bigint, text_key bigint, begin bigint, alone boolean, first bigint, second bigint",
            )
        )
        again = strings.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        marks = marks.unionByName(
            strings.filter("alone")
            .join(again, ["first", "second"], "left_semi")
            .select("doc_id", "text_key", "begin", (F.col("begin") + length).alias("end"))
        )
    return marks


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        marks = batch.column(batch.schema.get_field_index("marks")).to_pylist()
        for text, spans in zip(texts_of(batch), marks, strict=True):
            kept, count = text, 0
            if spans:
                begins = np.array([s["begin"] for s in spans])
                ends = np.array([s["end"] for s in spans])
                a, b = spans_of(cover(len(text), begins, ends))
                count = len(a)
                edges = zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)
                kept = b"".join(text[x:y] for x, y in edges)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(count)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)],
            ],
            names=["doc_id", *out],
        )


def without_long_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each document.

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole; a removal may
    split a character, so what is kept is binary. Rows that repeat doc_id and text each count as
    an occurrence and so lose all their strings. Only doc_id and text are read.
    """
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("real_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )
    marks = (
        repeated_spans(keyed.drop("real_id"), scratch, length, gram)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    )
    joined = keyed.join(marks, ["doc_id", "text_key"], "left")
    return joined.select(F.col("real_id").alias("doc_id"), "text", "marks").mapInArrow(
        _cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )


def op4_run_length_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_long_repeats(documents(spark, folder), Scratch(spark))
    return found.drop("kept")
