"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

Tasks cut their documents into blocks and keep, per block, which documents hold which of the asked
terms and how often. With document frequencies known, each block answers every item: the postings
of the item's terms set one bit each in a mask per document; documents of one mask share an upper
bound, the sum of the largest contributions of its terms in the block; masks are evaluated by
descending bound until the bound falls below the item's k-th score. A task carries the best
documents of each item from block to block, so that later blocks finish sooner.

Items are asked in blocks of a bounded number of terms, which every task gets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.llm.common import LOWER, UPPER, documents, slices, texts_of
from tillgrain.session import Scratch

# fixed values: a term is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50

#: distinct terms, summed over items, that are asked at once; one item with more is asked alone
MOST_TERMS = 200_000
#: bytes of text in a block of documents
BLOCK = 8_000_000

_KEEP = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
_FOLD = bytes(c if c in _KEEP else 32 for c in bytes(range(256)).lower())

PACKED = "doc_ids array<bigint>, sizes binary, terms binary, ends binary, docs binary, times binary"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = [sorted(set(terms_of(text))) for text in texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("item_id")), pa.array(kept, pa.list_(pa.binary()))],
            names=["item_id", "terms"],
        )


def item_blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, distinct terms) in lists of at most ``most_terms`` terms, read one partition at a time."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    block, held = [], 0
    for row in rows.mapInArrow(_item_terms, "item_id bigint, terms array<binary>").toLocalIterator():
        if block and held + len(row.terms) > most_terms:
            yield block
            block, held = [], 0
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        held += len(row.terms)
    if block:
        yield block


def _packed(vocabulary):
    """Blocks of documents with the postings of the asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in slices(batches, BLOCK):
            sizes = np.zeros(batch.num_rows, np.int64)
            terms, docs, times = [], [], []
            for i, text in enumerate(texts_of(batch)):
                words = terms_of(text)
                sizes[i] = len(words)
                known = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                found, counts = np.unique(known[known >= 0], return_counts=True)
                terms.append(found)
                times.append(counts.astype(np.uint32))
                docs.append(np.full(len(found), i, np.int32))
            terms, docs, times = (np.concatenate(x) for x in (terms, docs, times))
            order = np.argsort(terms, kind="stable")
            terms, docs, times = terms[order], docs[order], times[order]
            heads = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else order
            ends = np.append(heads[1:], len(terms)) if len(terms) else order
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            arrays = (sizes, terms[heads], ends.astype(np.int64), docs, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]],
                names=[c.split()[0] for c in PACKED.split(", ")],
            )

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term; under -1 documents with a term, under -2 terms in all."""
    for batch in batches:
        for sizes, terms, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sizes, terms, ends = np.frombuffer(sizes, np.int64), np.frombuffer(terms, np.int32), np.frombuffer(ends, np.int64)
            counts = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(terms, [-1, -2]).astype(np.int32)), pa.array(np.append(counts, [(sizes > 0).sum(), sizes.sum()]).astype(np.int64))],
                names=["term", "n"],
            )


def weight(documents_: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents_ + 2) / (2 * holding + 1)))


def _lengths(sizes: np.ndarray, documents_: int, total: int) -> np.ndarray:
    """m of each document, in exact integers whatever the corpus holds."""
    kinds, at = np.unique(sizes, return_inverse=True)
    return np.array([50 + 50 * int(n) * documents_ // max(total, 1) for n in kinds], np.int64)[at]


class Leaders:
    """The best documents of one item so far."""

    def __init__(self, most: int):
        self.most = most
        self.scores, self.ids, self.bare = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bar(self) -> int:
        """What a document must reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, bare: np.ndarray) -> None:
        scores, ids, bare = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.bare, bare)))
        order = np.lexsort((ids, bare, -scores))[: self.most]
        self.scores, self.ids, self.bare = scores[order], ids[order], bare[order]


def answer(postings: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, bare: np.ndarray, best: Leaders) -> int:
    """Let one item's documents of a block compete; returns how many were scored.

    ``postings`` has, per term, the block's documents that hold it and their contributions.
    """
    count = len(ids)
    masks = np.zeros((count, max(1, -(-len(postings) // 64))), np.uint64)
    for bit, (docs, _) in enumerate(postings):
        masks[docs, bit // 64] |= np.uint64(1 << bit % 64)
    held = np.flatnonzero(masks.any(axis=1))
    if masks.shape[1] == 1:
        kinds, kind = np.unique(masks[held, 0], return_inverse=True)
        kinds = kinds[:, None]
    else:
        kinds, kind = np.unique(masks[held], axis=0, return_inverse=True)
    bounds = np.zeros(len(kinds), np.int64)
    for bit, (_, gains) in enumerate(postings):
        bounds += (kinds[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) * gains.max()
    order = np.argsort(-bounds, kind="stable")
    members = np.bincount(kind, minlength=len(kinds))[order]
    held = held[np.argsort(np.argsort(order)[kind], kind="stable")]  # documents by the bound of their mask
    ends = np.cumsum(members)
    bounds = bounds[order]
    scored, batch, place = 0, best.most, np.full(count, -1, np.int64)
    while scored < len(held):
        first = int(np.searchsorted(ends, scored, side="right"))
        if bounds[first] < best.bar():
            break
        # whole masks, of at least so many documents and none below the bar
        last = min(int(np.searchsorted(ends, scored + batch)), len(ends) - 1)
        last = max(first, min(last, int(np.searchsorted(-bounds, -best.bar(), side="right")) - 1))
        chosen = held[scored : ends[last]]
        place[chosen] = np.arange(len(chosen))
        sums = np.zeros(len(chosen), np.int64)
        for docs, gains in postings:
            at = place[docs]
            hit = at >= 0
            sums[at[hit]] += gains[hit]
        place[chosen] = -1
        good = sums >= best.bar()
        best.add(sums[good], ids[chosen[good]], bare[chosen[good]])
        scored, batch = int(ends[last]), batch * 4
    return scored


def _answers(asked, known, most: int):
    """The best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (documents_, total, weights) = asked.value, known.value
        leaders = [Leaders(most) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                sizes, terms, ends, docs, times = (
                    np.frombuffer(row[name], kind)
                    for name, kind in (("sizes", np.int64), ("terms", np.int32), ("ends", np.int64), ("docs", np.int32), ("times", np.uint32))
                )
                bare = np.array([i is None for i in row["doc_ids"]], bool)
                ids = np.array([i or 0 for i in row["doc_ids"]], np.int64)
                times = times.astype(np.int64)
                spans = np.diff(ends, prepend=0)
                lengths = _lengths(sizes, documents_, total)[docs]
                gains = np.repeat(weights[terms], spans) * (1_000_000_000 * times // (1000 * times + 20 * lengths))
                place = np.full(len(weights), -1, np.int64)
                place[terms] = np.arange(len(terms))
                for wanted, best in zip(items, leaders, strict=True):
                    at = place[wanted]
                    at = at[at >= 0]
                    postings = [(docs[ends[i] - spans[i] : ends[i]], gains[ends[i] - spans[i] : ends[i]]) for i in at if weights[terms[i]] > 0]
                    if postings:
                        answer(postings, ids, bare, best)
        for item, best in enumerate(leaders):
            if len(best.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.ids), item, np.int32)), pa.array(best.ids, mask=best.bare), pa.array(best.scores)],
                    names=["item", "doc_id", "score"],
                )

    return run


def _asked(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], best: int, scratch: Scratch) -> DataFrame:
    """item_id, rank, doc_id, score of one block of items."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, terms in block for t in terms}))}
    packed = scratch.write(docs.select("doc_id", "text").mapInArrow(_packed(context.broadcast(vocabulary)), PACKED))
    counted = packed.select("sizes", "terms", "ends").mapInArrow(_statistics, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    # a row per asked term and two more, so no more than the block has
    counts = {row.term: row.n for row in counted.collect()}
    with_terms, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(with_terms, counts.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    asked = context.broadcast([np.array([vocabulary[t] for t in terms], np.int64) for _, terms in block])
    known = context.broadcast((with_terms, total, weights))
    found = packed.mapInArrow(_answers(asked, known, best), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    done = scratch.write(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    scratch.drop(packed)
    return done


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, best: int = BEST, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0.

    ``docs`` gives doc_id and text, ``items`` item_id and text; other columns are not read. Null
    and empty texts have no terms, so such items have no rows and such documents no rank. Rows of
    ``docs`` that repeat are documents of their own; rows of ``items`` that repeat are asked once,
    and rows with one item_id but different texts are ranked apart. Equal scores go by doc_id, rows
    without one last. An empty table gives an empty result.
    """
    result = None
    for block in item_blocks(items, most_terms):
        part = _asked(docs, block, best, scratch)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def op12_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each benchmark item; see ``ranked_search``."""
    return ranked_search(documents(spark, folder), benchmark(spark, folder), Scratch(spark))


OP12_SQL = f"""
WITH items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_SQL}')) AS term
  FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS d, doc_id, translate(text, '{UPPER}', '{LOWER}') AS text FROM documents
), words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(text, '{TERM_SQL}')) AS term FROM numbered
), lengths AS (
  SELECT d, count(*) AS n FROM words GROUP BY d
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths
), postings AS (
  SELECT d, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY d, doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, whole GROUP BY term
), gains AS (
  SELECT p.d, p.doc_id, p.term,
         w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS gain
  FROM postings p JOIN weights USING (term) JOIN lengths USING (d), whole
), scored AS (
  SELECT item_id, d, doc_id, sum(gain)::BIGINT AS score FROM items JOIN gains USING (term) GROUP BY item_id, d, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
