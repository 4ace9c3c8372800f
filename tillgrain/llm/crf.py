"""Language identification with a linear-chain conditional random field.

Each word of a text is a place of the chain and each language a label. The score of a label sums
weights of hashed affixes and character n-grams and of the word's lexicon entry; transitions are
learned weights. Forward-backward gives each word's probabilities, also where the language
changes within a text, and a text's language is the one with the most expected letters.

The lexicon counts the words of all labelled texts per language. Weights are fitted by gradient
steps on a bounded sample: ``SAMPLE`` pieces of ``PIECE`` words per language, drawn by the hash of
document and place, joined in pairs of equal or different languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import documents, mix, slices, texts_of
from tillgrain.session import Scratch

#: sizes of the hashed tables: fixed, whatever the corpus
FEATURES = 1 << 16
LEXICON = 1 << 16
SAMPLE = 1000
PIECE = 16
ROUNDS = 40
RATE = 0.3
DECAY = 1e-3
#: messages are passed in parallel over blocks of this many words
BLOCK = 32
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
PLACES = mix(np.arange(1, 8193, 2, dtype=np.uint64)) | np.uint64(1)
TRIGRAM, BIGRAM, PREFIX, SUFFIX = (np.uint64(salt) for salt in (0x51, 0x52, 0x53, 0x54))


class Words:
    """The words of some texts as arrays over their joined, lower-cased bytes."""

    def __init__(self, texts: list[bytes]):
        lowered = [text.decode().lower().encode() for text in texts]
        self.data = np.frombuffer(b" " + b" ".join(lowered) + b" ", np.uint8)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edges = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
        self.begins, self.ends = edges[::2], edges[1::2]
        self.inside = np.flatnonzero(~space)
        self.sizes = self.ends - self.begins
        self.heads = np.cumsum(self.sizes) - self.sizes
        bounds = np.cumsum([len(t) + 1 for t in lowered])
        self.owner = np.searchsorted(bounds, self.begins - 1, side="right")
        self.counts = np.bincount(self.owner, minlength=len(texts))
        letter = (self.data[self.inside] >= 97) & (self.data[self.inside] <= 122) | (self.data[self.inside] >= 0xC3)
        self.letters = np.add.reduceat(letter, self.heads, dtype=np.int64) if len(self.heads) else self.sizes

    def keys(self) -> np.ndarray:
        """A hash of each whole word: bytes times powers of their places in it."""
        place = np.arange(len(self.inside)) - np.repeat(self.heads, self.sizes)
        held = (self.data[self.inside].astype(np.uint64) + np.uint64(1)) * PLACES[np.minimum(place, len(PLACES) - 1)]
        sums = np.add.reduceat(held, self.heads) if len(self.heads) else np.zeros(0, np.uint64)
        return mix(sums)

    def entries(self) -> np.ndarray:
        return (self.keys() % np.uint64(LEXICON)).astype(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of each byte within a word: the trigram around it and the bigram that it ends."""
        at = self.data.astype(np.uint64)
        before, here, after = at[self.inside - 1], at[self.inside], at[self.inside + 1]
        two = before << np.uint64(8) | here
        return _slot(two << np.uint64(8) | after, TRIGRAM), _slot(two, BIGRAM)

    def affixes(self) -> list[np.ndarray]:
        """Features of each word: its first and last 2 and 4 bytes."""
        found = []
        for salt, step, first in ((PREFIX, 1, self.begins), (SUFFIX, -1, self.ends - 1)):
            value = np.zeros(len(self.begins), np.uint64)
            for i in range(4):
                at = np.clip(first + step * i, self.begins, self.ends - 1)
                value = value << np.uint64(8) | np.where(self.sizes > i, self.data[at], 0).astype(np.uint64)
                if i in (1, 3):
                    found.append(_slot(value * np.uint64(8) + np.uint64(i), salt))
        return found

    def scores(self, model: Model) -> np.ndarray:
        if not len(self.begins):
            return np.zeros((0, len(model.labels)), np.float32)
        trigrams, bigrams = self.grams()
        total = np.add.reduceat(model.weights[trigrams] + model.weights[bigrams], self.heads, axis=0)
        for feature in self.affixes():
            total += model.weights[feature]
        return total + model.trust * model.lexicon[self.entries()]


def _slot(values: np.ndarray, salt: np.uint64) -> np.ndarray:
    return (mix(values * np.uint64(256) + salt) >> np.uint64(48)).astype(np.int64) % FEATURES


class Model:
    """Learned weights; its size depends on the number of languages alone."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = labels
        share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * LEXICON))
        self.lexicon = (share - share.mean(axis=1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((FEATURES, len(labels)), np.float32)
        self.trust = np.zeros(len(labels), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float32)

    def fit(self, pieces: list[tuple[int, str]], seed: int = 3) -> None:
        """Gradient steps with per-weight rates on chains of two pieces each."""
        rng = np.random.default_rng(seed)
        pairs = rng.permutation(len(pieces))
        if len(pairs) % 2:
            pairs = np.append(pairs, pairs[0])
        chains = pairs.reshape(-1, 2)
        chains[::2, 1] = [self._like(pieces, int(a), rng) for a in chains[::2, 0]]
        texts = [f"{pieces[a][1]} {pieces[b][1]}".encode() for a, b in chains]
        words = Words(texts)
        split = np.array([len(pieces[a][1].encode().split()) for a, _ in chains])
        first = np.array([pieces[a][0] for a, _ in chains])
        second = np.array([pieces[b][0] for _, b in chains])
        place = np.arange(len(words.begins)) - (np.cumsum(words.counts) - words.counts)[words.owner]
        truth = np.where(place < split[words.owner], first[words.owner], second[words.owner])
        chain = Chains(words.counts)
        n = len(self.labels)
        exact = np.eye(n, dtype=np.float32)[truth]
        follows = place > 0
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:-1][follows[1:]], truth[1:][follows[1:]]), 1)
        trigrams, bigrams = words.grams()
        affixes = words.affixes()
        entry = self.lexicon[words.entries()]
        inside = np.repeat(np.arange(len(words.begins)), words.sizes)
        squared = [np.full_like(x, 1e-6) for x in (self.weights, self.trust, self.moves)]
        for _ in range(ROUNDS):
            scores = words.scores(self)
            marginals, expected = chain.posteriors(scores, self.moves, pairs=True)
            gap = (exact - marginals) / len(truth)
            weights = np.zeros_like(self.weights)
            for label in range(n):
                spread = gap[inside, label]
                column = np.bincount(trigrams, spread, FEATURES) + np.bincount(bigrams, spread, FEATURES)
                for feature in affixes:
                    column += np.bincount(feature, gap[:, label], FEATURES)
                weights[:, label] = column
            steps = (
                weights - DECAY / len(truth) * self.weights,
                (gap * entry).sum(axis=0) - DECAY / len(truth) * self.trust,
                (seen - expected) / len(truth) - DECAY / len(truth) * self.moves,
            )
            for target, step, square in zip((self.weights, self.trust, self.moves), steps, squared, strict=True):
                square += step**2
                target += (RATE * step / np.sqrt(square)).astype(np.float32) * (np.abs(step) > 1e-12)

    @staticmethod
    def _like(pieces: list[tuple[int, str]], a: int, rng: np.random.Generator) -> int:
        """Another piece of the same language, found among a few draws, or the piece itself."""
        for b in rng.integers(0, len(pieces), 16):
            if pieces[b][0] == pieces[a][0]:
                return int(b)
        return a


class Chains:
    """Forward-backward over chains of different lengths.

    Chains are laid out in blocks. Block products of the transfer matrices are made for all
    blocks at once, messages then go from block to block, and last through all blocks at once.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        blocks = -(-counts // BLOCK)
        self.blocks = blocks
        self.first_block = np.cumsum(blocks) - blocks
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.row = np.repeat(self.first_block, counts) + place // BLOCK
        self.column = place % BLOCK
        self.used = np.zeros((int(blocks.sum()), BLOCK), bool)
        self.used[self.row, self.column] = True
        self.opens = np.zeros(len(self.used), bool)
        self.opens[self.first_block[blocks > 0]] = True

    def posteriors(self, scores: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """Marginals of every word and, if asked, expected numbers of each transition."""
        n, rows = scores.shape[1], len(self.used)
        local = np.ones((rows, BLOCK, n))
        local[self.row, self.column] = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else 1.0
        local = np.maximum(local, 1e-30)
        step = np.exp(moves.astype(np.float64))
        into = self._edges(local, step, forward=True)
        back = self._edges(local, step, forward=False)
        ahead = np.empty((rows, BLOCK, n))
        message = into
        for t in range(BLOCK):
            moved = message @ step
            if t == 0:
                moved[self.opens] = 1.0
            moved = moved * local[:, t]
            message = np.where(self.used[:, t, None], moved / moved.sum(axis=1, keepdims=True), message)
            ahead[:, t] = message
        behind = np.empty((rows, BLOCK, n))
        message = back
        for t in reversed(range(BLOCK)):
            behind[:, t] = message
            moved = (local[:, t] * message) @ step.T
            message = np.where(self.used[:, t, None], moved / moved.sum(axis=1, keepdims=True), message)
        both = ahead * behind
        marginals = (both / both.sum(axis=2, keepdims=True))[self.row, self.column].astype(np.float32)
        if not pairs:
            return marginals
        before, here = ahead[self.row, self.column][:-1], (local * behind)[self.row, self.column][1:]
        linked = np.flatnonzero(np.diff(np.repeat(np.arange(len(self.counts)), self.counts)) == 0)
        joint = before[linked][:, :, None] * step[None] * here[linked][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return marginals, joint.sum(axis=0)

    def _edges(self, local: np.ndarray, step: np.ndarray, forward: bool) -> np.ndarray:
        """The message that enters each block from its chain's earlier (or later) blocks."""
        rows, _, n = local.shape
        product = np.broadcast_to(np.eye(n), (rows, n, n)).copy()
        order = range(BLOCK) if forward else reversed(range(BLOCK))
        for t in order:
            if forward:
                moved = (product.reshape(-1, n) @ step).reshape(rows, n, n)
                if t == 0:
                    moved[self.opens] = 1.0
                moved = moved * local[:, t, None, :]
            else:
                moved = ((product * local[:, t, None, :]).reshape(-1, n) @ step.T).reshape(rows, n, n)
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            product = np.where(self.used[:, t, None, None], moved, product)
        result = np.full((rows, n), 1.0 / n)
        held = np.flatnonzero(self.blocks > 1)
        held = held[np.argsort(-self.blocks[held], kind="stable")]
        sizes = self.blocks[held]
        for k in range(int(sizes.max(initial=1)) - 1):
            active = held[: np.searchsorted(-sizes, -(k + 1), side="left")]
            at = self.first_block[active] + (k if forward else self.blocks[active] - 1 - k)
            message = np.einsum("ij,ijk->ik", result[at], product[at])
            result[at + (1 if forward else -1)] = message / message.sum(axis=1, keepdims=True)
        return result


GATHERED = "label string, entry int, n bigint, lot bigint, piece string"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lexicon counts of each slice, and of its pieces those with the smallest lots."""
    names = [c.split()[0] for c in GATHERED.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def rows(label: str, *columns) -> pa.RecordBatch:
        size = len(next(c for c in columns if c is not None))
        filled = [[label] * size, *[c if c is not None else [None] * size for c in columns]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(filled, kinds, strict=True)], names=names)

    for batch in slices(batches, 16_000_000):
        labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
        by_label: dict[str, list[bytes]] = {}
        for label, text in zip(labels, texts_of(batch), strict=True):
            by_label.setdefault(label, []).append(text)
        for label, texts in by_label.items():
            entries = Words(texts).entries()
            counts = np.bincount(entries, minlength=LEXICON)
            held = np.flatnonzero(counts)
            if len(held):
                yield rows(label, held, counts[held], None, None)
            lots = []
            for text in texts:
                seed = xxhash.xxh3_64_intdigest(text)
                words = text.split()
                lots += [
                    (int(np.uint64(xxhash.xxh3_64_intdigest(f"{seed}:{i}")).astype(np.int64)), b" ".join(words[i : i + PIECE]))
                    for i in range(0, len(words), PIECE)
                ]
                if len(lots) > 50 * SAMPLE:
                    lots = sorted(lots)[:SAMPLE]
            lots = sorted(lots)[:SAMPLE]
            if lots:
                yield rows(label, None, None, [lot for lot, _ in lots], [piece.decode() for _, piece in lots])


def train(labelled: DataFrame, scratch: Scratch) -> Model | None:
    """A model from ``labelled`` (label, text); none if no labelled text has a word.

    What comes to the driver is bounded by the languages: LEXICON counts and SAMPLE pieces each.
    """
    gathered = scratch.write(labelled.mapInArrow(_gather, GATHERED), compression="zstd")
    counted = gathered.filter("entry is not null").groupBy("label", "entry").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(counted["label"].unique())
    if not labels:
        return None
    counts = np.zeros((LEXICON, len(labels)))
    counts[counted["entry"], counted["label"].map({x: i for i, x in enumerate(labels)})] = counted["n"]
    pieces = []
    for i, label in enumerate(labels):
        drawn = gathered.filter((F.col("label") == label) & F.col("piece").isNotNull())
        pieces += [(i, r.piece) for r in drawn.orderBy("lot", "piece").limit(SAMPLE).select("piece").collect()]
    scratch.drop(gathered)
    model = Model(labels, counts)
    model.fit(pieces)
    return model


def predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4_000_000):
            texts = texts_of(batch)
            named = [UNKNOWN] * len(texts)
            values = [0.0] * len(texts)
            if model is not None:
                words = Words(texts)
                marginals = Chains(words.counts).posteriors(words.scores(model), model.moves)
                weight = np.maximum(words.letters, 1e-6)[:, None]
                shares = np.zeros((len(texts), len(model.labels)))
                for label in range(len(model.labels)):
                    shares[:, label] = np.bincount(words.owner, (marginals[:, label, None] * weight)[:, 0], len(texts))
                shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
                best = shares.argmax(axis=1)
                for i, text in enumerate(texts):
                    if LETTER.search(text.decode()):
                        named[i], values[i] = model.labels[best[i]], float(min(1.0, shares[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("held_out")),
                    pa.array(named, pa.string()),
                    pa.array(values, pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, labelled: Column, held_out: Column, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, lang_pred and score per document.

    The model learns from text and lang of the rows where ``labelled`` holds and both are given.
    Predictions read the text alone. Texts that are null or have no letter, and all texts if
    nothing was labelled, are ``und`` with score 0. Ties go to the language first in order.
    """
    known = docs.filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(known.select(F.col("lang").cast("string").alias("label"), "text"), scratch)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out"))
    return rows.mapInArrow(predictor(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op10_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return identify(
        documents(spark, folder), third != 1, F.coalesce(third == 1, F.lit(False)), Scratch(spark)
    )
