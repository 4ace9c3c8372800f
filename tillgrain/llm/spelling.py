"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters fall into groups; a word is the vector of its counts per group, and a trie arranges the
vectors count by count. One edit raises at most one count by one and lowers at most one by one, so
a depth-first search may spend one surplus and one deficit on its way to the leaves. Words of the
leaves it reaches are verified letter by letter.

The trie is spread over the cluster by its upper levels: counts over four coarse bundles of groups
name a cell. A word is stored in its own cell and sent as a probe to those neighbouring cells that
a surplus and a deficit can reach and that are greater, so each pair of words meets once. A cell
with too many letters is opened by the next group, probes carrying what is left of their budget,
until it fits a task. A cell that is still too large after all groups holds words of equal counts;
these are dealt by halves, since one edit leaves one half of a word as it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import ASCII_LOWER, documents, slices, texts_of
from tillgrain.session import Scratch

# fixed values of the word definition
RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST = 7
DROP = 31
LEAST = 2
FORM_TIMES = 10

#: levels of the trie; a letter's group is its code point modulo this
GROUPS = 16
#: neighbouring groups counted together by the key of a cell
BUNDLE = 4
#: letters of the words in one cell, stored or sent there
MOST_LETTERS = 400_000
#: entries of the search, or bytes of compared words, held at a time
BATCH = 250_000

LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]


def _letters(groups: Iterable[int]) -> str:
    wanted = set(groups)
    return "".join(c for c in LETTERS if ord(c) % GROUPS in wanted)


def _count(word: Column, groups: Iterable[int]) -> Column:
    """How many letters of a word lie in some groups."""
    return F.length(word) - F.length(F.translate(word, _letters(groups), ""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each slice of documents with their occurrences there."""
    for batch in slices(batches, 16_000_000):
        total: Counter[str] = Counter()
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for doc_id, text in zip(ids, texts_of(batch), strict=True):
            runs = Counter(RUN.findall(text.translate(ASCII_LOWER).decode()))
            head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, times in runs.items():
                if len(run) < SHORTEST:
                    continue
                h = zlib.crc32(run.encode(), head)
                if h % DROP == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < SHORTEST:
                        continue
                total[run] += times
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters of all documents, one letter of every 31st (document, run) deleted.

    Only A-Z is lower-cased. Words of fewer than ``SHORTEST`` code points or ``LEAST`` occurrences
    are left out. A null text has no words; a null doc_id is written as nothing before the colon.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def group_counts(codes: np.ndarray) -> np.ndarray:
    """Per row of letter codes (0 pads) the number of letters in each group."""
    groups = np.where(codes > 0, codes % GROUPS, GROUPS).astype(np.uint8)
    return np.stack([(groups == g).sum(axis=1) for g in range(GROUPS)], axis=1)


class CountTrie:
    """A trie over rows of counts; each level keeps its nodes as sorted (parent, count) keys."""

    def __init__(self, vectors: np.ndarray):
        self.depth = vectors.shape[1]
        self.order = np.lexsort(vectors.T[::-1])
        rows = vectors[self.order]
        self.span = int(vectors.max(initial=0)) + 3
        node = np.zeros(len(rows), np.int64)
        self.levels = []
        for level in range(self.depth):
            keys = node * self.span + rows[:, level] + 1
            fresh = np.append(True, keys[1:] != keys[:-1])
            self.levels.append(keys[fresh])
            node = np.cumsum(fresh) - 1
        self.begins = np.searchsorted(node, np.arange(node[-1] + 2))

    def reach(self, vectors: np.ndarray, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, leaf) pairs within a surplus and a deficit of one.

        Depth first over batches of (probe, node, spent): a batch that grows beyond its size is
        split, so what is held follows the depth and not the number of probes.
        """
        every = np.arange(len(vectors))
        stack = [(0, part, np.zeros(len(part), np.int64), np.zeros(len(part), np.int8)) for part in np.array_split(every, len(every) // batch + 1)]
        while stack:
            level, probe, node, spent = stack.pop()
            if level == self.depth:
                yield probe, node
                continue
            if len(probe) > batch:
                half = len(probe) // 2
                stack += [(level, x, y, z) for x, y, z in ((probe[:half], node[:half], spent[:half]), (probe[half:], node[half:], spent[half:]))]
                continue
            keys, found = self.levels[level], []
            wanted = node * self.span + vectors[probe, level] + 1
            for step, bit in ((0, 0), (1, 1), (-1, 2)):
                open_ = np.flatnonzero(spent & bit == 0) if bit else slice(None)
                key = wanted[open_] + step
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                found.append((probe[open_][hit], at[hit], spent[open_][hit] | np.int8(bit)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))


def one_edit(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether rows of letter codes, padded with at least one 0, differ by exactly one edit."""
    longer = a_sizes > b_sizes
    a, b = np.where(longer[:, None], b, a), np.where(longer[:, None], a, b)
    gap = np.abs(a_sizes - b_sizes)
    differ = a != b
    first = differ.argmax(axis=1)
    replaced = (gap == 0) & (differ.sum(axis=1) == 1)
    shorter = np.where(np.arange(a.shape[1] - 1) < first[:, None], b[:, :-1], b[:, 1:])
    return replaced | ((gap == 1) & (a[:, :-1] == shorter).all(axis=1))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(sizes.max(initial=0)) + 1
    flat = "".join(w.ljust(wide, "\0") for w in words).encode("latin-1")
    return np.frombuffer(flat, np.uint8).reshape(len(words), wide), sizes


CELL = "cell string, word string, n bigint, stored boolean"
NEAR = "word string, n_near bigint, near_n bigint, near string"


def _cell(table: pa.Table) -> pa.Table:
    """Of one cell: per word its near words there, their number and the most frequent."""
    name = table.column("cell")[0].as_py().split("\t")
    table = table.sort_by([("stored", "descending"), ("word", "ascending")])
    words = table.column("word").to_pylist()
    times = table.column("n").to_numpy()
    held = int(pa.compute.sum(table.column("stored")).as_py() or 0)
    codes, sizes = _codes(words)
    pairs = []
    if held:
        vectors = group_counts(codes)
        trie = CountTrie(vectors[:held])
        for probe, leaf in trie.reach(vectors):
            pairs += _verified(trie, probe, leaf, codes, sizes, held, name)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    word, other = np.concatenate((a, b)), np.concatenate((b, a))
    # words by code point, so that of equally frequent ones the smallest comes first
    place = np.argsort(np.argsort(np.array(words, object), kind="stable"), kind="stable")
    order = np.lexsort((place[other], -times[other], word))
    word, other = word[order], other[order]
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
    best = other[heads]
    pick = lambda at: pa.array([words[i] for i in at], pa.string())
    return pa.table(
        {
            "word": pick(word[heads]),
            "n_near": pa.array(np.diff(np.append(heads, len(word))), pa.int64()),
            "near_n": pa.array(times[best], pa.int64()),
            "near": pick(best),
        }
    )


def _verified(trie: CountTrie, probe: np.ndarray, leaf: np.ndarray, codes: np.ndarray, sizes: np.ndarray, held: int, name: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (stored, probe) one edit apart among the words of the leaves that probes reached."""
    out = []
    counts = trie.begins[leaf + 1] - trie.begins[leaf]
    most = max(1, BATCH * 16 // codes.shape[1])
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, most):
        k = np.arange(low, min(low + most, total))
        entry = np.searchsorted(ends, k, side="right")
        right = probe[entry]
        left = trie.order[trie.begins[leaf[entry]] + k - (ends[entry] - counts[entry])]
        fresh = left < right  # stored words come first and meet each other once
        left, right = left[fresh], right[fresh]
        near = one_edit(codes[left], codes[right], sizes[left], sizes[right])
        if len(name) > 2:  # dealt by halves
            half, short = name[1], int(name[2])
            near &= np.minimum(sizes[left], sizes[right]) == short
            if half == "last":  # pairs with the same first half meet there
                near &= (codes[left, : short // 2] != codes[right, : short // 2]).any(axis=1)
        out.append((left[near], right[near]))
    return out


def _first_cells(words: DataFrame) -> DataFrame:
    """Each word stored in the cell of its coarse counts and sent to the greater ones nearby."""
    size = GROUPS // BUNDLE
    coarse = [_count(F.col("word"), range(i, i + BUNDLE)) for i in range(0, GROUPS, BUNDLE)]
    unit = lambda i, step: tuple(step if j == i else 0 for j in range(size))
    steps = {tuple(x + y for x, y in zip(unit(i, up), unit(j, down), strict=True)) for i in range(size) for j in range(size) for up in (0, 1) for down in (0, -1)}
    # the first step is none: the word's own cell
    steps = sorted(s for s in steps if s >= (0,) * size)
    moved = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"s{i}") for i, x in enumerate(s)], F.lit(not any(s)).alias("stored")) for s in steps]))
    rows = words.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(coarse)]).select("*", moved.alias("move"))
    keys = [F.col(f"c{i}") + F.col(f"move.s{i}") for i in range(size)]
    return rows.filter(F.least(*keys) >= 0).select(
        F.concat_ws(",", *keys).alias("cell"), "word", "n", F.col("move.stored").alias("stored"), F.lit(0).alias("spent")
    )


def _opened(rows: DataFrame, group: int) -> DataFrame:
    """Rows of large cells dealt by the count of one more group."""
    move = lambda step, spent, stored: F.struct(F.lit(step).alias("step"), spent.alias("spent"), stored.alias("stored"))
    spent, yes, no = F.col("spent"), F.lit(True), F.lit(False)
    none = F.lit(None).cast("struct<step:int,spent:int,stored:boolean>")
    up = F.when(spent.bitwiseAND(1) == 0, move(1, spent.bitwiseOR(1), no)).otherwise(none)
    down = F.when(spent.bitwiseAND(2) == 0, move(-1, spent.bitwiseOR(2), no)).otherwise(none)
    # of two stored words the one with the smaller count becomes the probe
    moves = F.when(F.col("stored"), F.array(move(0, spent, yes), move(1, F.lit(1), no))).otherwise(F.array(move(0, spent, no), up, down))
    dealt = rows.withColumn("move", F.explode(F.filter(moves, lambda m: m.isNotNull())))
    return dealt.select(
        F.concat_ws(",", "cell", (_count(F.col("word"), [group]) + F.col("move.step")).cast("string")).alias("cell"),
        "word", "n", F.col("move.stored").alias("stored"), F.col("move.spent").alias("spent"),
    )


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of cells of equal counts dealt by first and by last half of the shorter word."""
    own = F.aggregate(F.slice(F.split("cell", ","), 1, GROUPS // BUNDLE).cast("array<int>"), F.lit(0), lambda x, y: x + y)
    rows = rows.withColumn("own", own).withColumn("long", F.length("word"))
    shorts = F.when(F.col("stored"), F.array(F.col("own") - 1, F.col("own"))).otherwise(F.array(F.least("own", "long")))
    rows = rows.withColumn("short", F.explode(shorts))
    first = (F.col("short") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit("first").alias("half"), F.expr("left(word, short div 2)").alias("part")),
        F.struct(F.lit("last").alias("half"), F.expr("right(word, short - short div 2)").alias("part")),
    )
    rows = rows.withColumn("h", F.explode(halves)).filter(first >= 0)
    return rows.select(F.concat_ws("\t", "cell", "h.half", "short", "h.part").alias("cell"), "word", "n", "stored", "spent")


def near_words(words: DataFrame, scratch: Scratch, most_letters: int = MOST_LETTERS) -> DataFrame:
    """word, n_near, near_n, near: the number of near words and the most frequent one.

    Words without a near word have no row. Of equally frequent near words the smallest counts.
    """
    found, kept, rows = [], [], scratch.write(_first_cells(words))
    for level in range(GROUPS + 1):
        sizes = rows.groupBy("cell").agg(F.sum(F.length("word")).alias("letters"), F.max("stored").alias("any"), F.count("*").alias("rows"))
        sizes = scratch.write(sizes.filter(F.col("any") & (F.col("rows") > 1)).select("cell", "letters"))
        dealt = rows.join(sizes, "cell")
        fits = dealt.filter(F.col("letters") <= most_letters).select("cell", "word", "n", "stored")
        found.append(scratch.write(fits.groupBy("cell").applyInArrow(_cell, NEAR)))
        kept += [sizes, rows]
        if sizes.filter(F.col("letters") > most_letters).isEmpty():
            break
        large = dealt.filter(F.col("letters") > most_letters).drop("letters")
        rows = scratch.write(_opened(large, level) if level < GROUPS else _halved(large))
    else:
        whole = rows.select("cell", "word", "n", "stored")
        found.append(scratch.write(whole.groupBy("cell").applyInArrow(_cell, NEAR)))
        kept.append(rows)
    scratch.drop(*kept)
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("near")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.least")).alias("near_n"), F.col("best.near").alias("near")
    )


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last.

    Each step multiplies the frequency by ten at least, so chains are short; every round
    halves what is left of them.
    """
    at = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        following = scratch.write(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        scratch.drop(at)
        at = following
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(words: DataFrame, scratch: Scratch, most_letters: int = MOST_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of (word, n).

    ``words`` holds each word once, made of letters a-z and U+00C0 to U+00FF. A form is the most
    frequent near word if it is at least ``FORM_TIMES`` as frequent as the word; an empty table
    gives an empty result.
    """
    words = scratch.write(words.select("word", "n"))
    near = near_words(words, scratch, most_letters)
    joined = words.join(near, "word", "left")
    has = F.col("near_n") >= FORM_TIMES * F.col("n")
    named = scratch.write(
        joined.select(
            "word",
            F.when(has, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has, F.col("near_n")).alias("form_n"),
        )
    )
    last = roots(named.filter(F.col("form").isNotNull()), scratch)
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots.

    Null and empty texts have no words; rows that repeat count again; a null doc_id is written as
    nothing in the hashed text; an empty table gives no rows. Only doc_id and text are read.
    """
    return spelling_variants(word_counts(documents(spark, folder)), Scratch(spark))
