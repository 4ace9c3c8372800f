"""Quality rules with an n-gram model: perplexity bands per language.

Characters are counted in Spark over all documents and make an interpolated modified Kneser-Ney
model per language. The model is stored sorted by a packed gram key, in files of bounded size;
scoring tasks look grams up by binary search and hold a few files at a time. A text counts once,
however many documents have it, and a gram that occurs in no other text counts as unseen, so that
neither odd documents nor groups of copies explain themselves.
Documents far outside the perplexities usual for their language are rejected; one that only its
own language's model finds too odd gets a second hearing by the model of all languages together,
which text in several languages satisfies.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import cover, documents, released, slices, texts_of, word_hashes
from tillgrain.llm.digests import digest
from tillgrain.llm.repeats import BASES, rolling
from tillgrain.session import Scratch

ORDER = 5
BITS = 12
#: model rows in one file, and files a scoring task holds at a time
FILE_ROWS = 250_000
HELD_FILES = 8
#: bytes of text that are counted, or of one language scored, at once
SLICE = 2_000_000
#: a band ends this many quartile distances beyond the quartiles, and a document must lie
#: this many standard errors of its own mean beyond it to be rejected
FENCE = 3.0
#: up to so many languages, the bands (a row each) are broadcast
FEW_LANGUAGES = 10_000
#: the name of the model of all languages
ANY = "*"
ERRORS = 4.0
#: a band never begins nearer to the mean log probability that the model gives its own corpus
MARGIN = 0.15
#: bits that tell repeated texts, and how many of them a row of Spark's bitmaps holds
REPEAT_BITS = 1 << 23
BUCKET_BITS = 1 << 15
# fixed values of the base rules
LEAST_WORDS = 10
MOST_REPEATED = 20
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5

SCORES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "score double, error double, second double"
)


@functools.cache
def _codes() -> np.ndarray:
    """The 12-bit code of every code point.

    Digits count as 0 and white space as a space. Code points from 4096 on share the codes by a
    hash; code 0 stands for the begin of a text.
    """
    points = np.arange(0x110000, dtype=np.int64)
    codes = np.where(points >= 1 << BITS, ((points * 2654435761) >> 8) % ((1 << BITS) - 1) + 1, points)
    codes[0], codes[9:14], codes[48:58] = 1, 32, 48
    return codes.astype(np.uint16)


def all_letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of lower-cased texts, one after the other, and how many each has.

    A run of white space is one space.
    """
    lowered = [text.decode().lower() for text in texts]
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    kept = np.ones(len(points), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    begins = np.append(0, ends[:-1])
    kept[begins[begins < ends]] = True
    before = np.append(0, np.cumsum(kept))
    return _codes()[points[kept]], before[ends] - before[begins]


def all_grams(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the gram of ``ORDER`` codes that ends there, and the number of its text."""
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    size = len(codes) + (ORDER - 1) * (len(sizes) + 1)
    place = np.arange(len(codes), dtype=np.int32 if size < 2**31 else np.int64)
    place += (ORDER - 1) * (text + 1)
    padded = np.zeros(size, np.uint16)
    padded[place] = codes
    place -= ORDER - 1
    result = np.zeros(len(codes), np.int64)
    for _ in range(ORDER):  # in place, as this is the most that a task holds
        result <<= BITS
        result |= padded[place]
        place += 1
    return result, text


def letters(text: str) -> np.ndarray:
    return all_letters([text.encode()])[0].astype(np.int64)


def grams(codes: np.ndarray) -> np.ndarray:
    return all_grams(codes, np.array([len(codes)]))[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, SLICE):
        members: dict[tuple[str, int], list[int]] = {}
        for i, langs in enumerate(batch.column(batch.schema.get_field_index("langs")).to_pylist()):
            for lang in langs:
                members.setdefault((lang, 1), []).append(i)
            if len(langs) > 1:  # the sum over languages has the text once, too
                members.setdefault((ANY, 1 - len(langs)), []).append(i)
        whole, text = all_grams(*all_letters(texts_of(batch)))
        for (lang, weight), rows in members.items():
            chosen = np.zeros(batch.num_rows, bool)
            chosen[rows] = True
            kinds, keys = pd.factorize(whole[chosen[text]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(np.bincount(kinds, minlength=len(keys)) * weight)],
                names=["lang", "gram", "raw"],
            )


def _distinct(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(langs, text): every distinct text once, with the languages of its documents.

    Only texts whose digest may occur repeatedly are grouped, and copies combine on the map side;
    a bitmap of fixed size tells them. One that is full sends more texts there, never too few.
    """
    read = docs.select("lang", "text", digest(F.col("text")).alias("text_digest"))
    slot = F.pmod(F.xxhash64("text_digest"), F.lit(REPEAT_BITS))
    bucket, place = F.floor(slot / BUCKET_BITS).alias("bucket"), slot % BUCKET_BITS
    groups = read.select("text_digest").groupBy("text_digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = scratch.write(groups.filter("n > 1").groupBy(bucket).agg(F.bitmap_construct_agg(place).alias("bits")))
    byte = F.substring(F.col("bits"), F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))
    bit = F.floor(F.conv(F.hex(byte), 16, 10).cast("bigint") / F.pow(F.lit(2), F.col("place") % 8)) % 2 == 1
    told = read.select("*", bucket, place.alias("place")).join(F.broadcast(repeated), "bucket", "left")
    told = told.select("lang", "text", "text_digest", F.coalesce(bit, F.lit(False)).alias("again"))
    once = told.filter(~F.col("again")).select(F.array("lang").alias("langs"), "text")
    again = told.filter("again").groupBy("text_digest")
    again = again.agg(F.collect_set("lang").alias("langs"), F.first("text").alias("text"))
    return once.unionByName(again.select("langs", "text"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language, from the numbers of counts 1 to 4."""
    of = counts.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    n1, n2, n3, n4 = (F.greatest(F.col(f"n{i}"), F.lit(1.0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + n2 * 2)
    raw = (F.lit(1.0) - y * 2 * n2 / n1, F.lit(2.0) - y * 3 * n3 / n2, F.lit(3.0) - y * 4 * n4 / n3)
    return of.select(
        "lang",
        *[F.least(F.greatest(d, F.lit(0.1)), F.lit(i + 0.9)).alias(f"d{i + 1}") for i, d in enumerate(raw)],
    )


def _key(order: int, gram: Column) -> Column:
    return F.lit(order << 60).cast("bigint").bitwiseOR(gram)


def train(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The whole model of ``trained``."""
    return trained(docs, scratch, 1)[0]


def trained(docs: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, key, raw, logp, follow, bow): for each gram of 1 to ORDER codes its occurrences and
    log probability, and for each context its occurrences and log back-off weight; and
    (lang, expected), the mean log probability that each model gives its own corpus.

    The key is the order in the bits above 60 and the gram below. Counts of lower orders are the
    numbers of distinct codes seen before the gram. Every table has at most a row per distinct
    gram of a language. Equal texts count once per language, and once in the model of all. Rows
    of fewer than ``least`` occurrences are left out at the end; with 2 no score changes, since
    what occurs once is unseen by the text that has it and absent from all others.
    """
    counted = _distinct(docs, scratch).mapInArrow(released(_count), "lang string, gram bigint, raw bigint")
    single = scratch.write(counted.groupBy("lang", "gram").agg(F.sum("raw").alias("raw")))
    pooled = single.groupBy("gram").agg(F.sum("raw").alias("raw"))
    both = single.filter(F.col("lang") != ANY).unionByName(pooled.withColumn("lang", F.lit(ANY)))
    counts = {ORDER: scratch.write(both.withColumn("c", F.col("raw")))}
    scratch.drop(single)
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
        counts[order] = scratch.write(
            counts[order + 1].groupBy("lang", suffix.alias("gram")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("c"))
        )
    lower = counts[1].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("p0"))
    lower = lower.select("lang", F.lit(0).cast("bigint").alias("suffix"), "p0")
    parts = []
    for order in range(1, ORDER + 1):
        rows = counts[order].join(_discounts(counts[order]), "lang")
        c = F.col("c")
        discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select(
            "lang", "gram", "raw", "c", discount.alias("d"),
            F.shiftright("gram", BITS).alias("context"),
            F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("suffix"),
        )
        contexts = rows.groupBy("lang", "context").agg(
            F.sum("c").cast("double").alias("total"), F.sum("d").alias("freed"), F.sum("raw").alias("follow")
        )
        rows = (
            rows.join(contexts, ["lang", "context"])
            .join(lower, ["lang", "suffix"])
            .withColumn("p", (F.col("c") - F.col("d") + F.col("freed") * F.col("p0")) / F.col("total"))
        )
        found = scratch.write(rows.select("lang", "gram", "raw", "p"))
        none = F.lit(None)
        if order == ORDER:
            means = found.groupBy("lang").agg((F.sum(F.col("raw") * F.log("p")) / F.sum("raw")).alias("expected"))
        parts.append(found.select("lang", _key(order, F.col("gram")).alias("key"), "raw", F.log("p").alias("logp"), none.cast("bigint").alias("follow"), none.cast("double").alias("bow")))
        parts.append(contexts.select("lang", _key(order - 1, F.col("context")).alias("key"), none.cast("bigint").alias("raw"), none.cast("double").alias("logp"), "follow", F.log(F.col("freed") / F.col("total")).alias("bow")))
        lower = found.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p0"))
    whole = functools.reduce(DataFrame.unionByName, parts)
    whole = whole.filter((F.col("raw") >= least) | (F.col("follow") >= least))
    merged = whole.groupBy("lang", "key").agg(*[F.max(x).alias(x) for x in ("raw", "logp", "follow", "bow")])
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("raw", "logp", "follow", "bow")}
    return merged.select("lang", "key", *[v.alias(k) for k, v in zero.items()]), means


def store(model: DataFrame, scratch: Scratch) -> tuple[str, list[tuple]]:
    """Write the model as sorted files and list them: (lang, first key, last key, path).

    The list has an entry per language and file, so it is smaller than the model by the rows of
    a file.
    """
    folder = scratch.folder()
    pieces = model.count() // FILE_ROWS + 1
    model.repartitionByRange(pieces, "lang", "key").sortWithinPartitions("lang", "key").write.parquet(folder)
    files = (
        model.sparkSession.read.schema("lang string, key bigint")
        .parquet(folder)
        .groupBy("lang", F.col("_metadata.file_path").alias("path"))
        .agg(F.min("key").alias("low"), F.max("key").alias("high"))
    )
    return folder, [(r.lang, r.low, r.high, r.path) for r in files.collect()]


@functools.lru_cache(maxsize=HELD_FILES)
def _load(path: str, lang: str) -> dict[str, np.ndarray]:
    files, place = fs.FileSystem.from_uri(path)
    with files.open_input_file(place) as source:
        table = pq.read_table(io.BytesIO(source.read()))
    rows = table.filter(pc.equal(table["lang"], lang))
    # counts are compared with those of a slice only, which stay far below 2^31
    kinds = {"key": np.int64, "raw": np.int32, "logp": np.float32, "follow": np.int32, "bow": np.float32}
    return {c: (np.minimum(v, 2**31 - 1) if k is np.int32 else v).astype(k) for c, k in kinds.items() for v in (rows[c].to_numpy(),)}


def look_up(files: list[tuple], lang: str, keys: np.ndarray, columns: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of the model for each key; zeros where it has none."""
    first, second = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float32)
    for owner, low, high, path in files:
        if owner != lang:
            continue
        inside = np.flatnonzero((keys >= low) & (keys <= high))
        if not len(inside):
            continue
        part = _load(path, lang)
        at = np.minimum(np.searchsorted(part["key"], keys[inside]), len(part["key"]) - 1)
        hit = part["key"][at] == keys[inside]
        inside, at = inside[hit], at[hit]
        first[inside], second[inside] = part[columns[0]][at], part[columns[1]][at]
    return first, second


class _Level:
    """What the model says of one order's grams, or of their contexts, in a slice of texts.

    ``kind`` maps the slice's distinct longest grams to the distinct keys of this order, which
    have ``model`` occurrences in the model and ``here`` in the slice. A key is known to any text
    if it occurs more often in the model than in the slice, and to no text that has it if it
    occurs once; between, it hangs on how often the text itself has it.
    """

    def __init__(self, kind: np.ndarray, count: int, total: np.ndarray):
        self.kind = kind
        self.here = np.bincount(kind, weights=total, minlength=count).astype(np.int64)
        self.model, self.value = np.zeros(count, np.int64), np.zeros(count)

    def ask(self, places: np.ndarray, keys: np.ndarray, lang: str, files: list[tuple], columns: tuple[str, str]) -> None:
        wanted = np.unique(self.kind[places])
        wanted = wanted[np.argsort(keys[wanted])]
        self.model[wanted], self.value[wanted] = look_up(files, lang, keys[wanted], columns)
        self.sure = self.model > self.here
        self.hangs = (self.model >= 2) & ~self.sure

    def known(self, gram: np.ndarray, text: np.ndarray, inverse: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether the model knows the key of (gram, text) from other texts."""
        kind = self.kind[gram]
        result = self.sure[kind]
        open_ = np.flatnonzero(self.hangs[kind])
        if len(open_):
            places = np.flatnonzero(self.hangs[self.kind][inverse])
            width = len(self.here)
            pairs, counts = np.unique(owner[places].astype(np.int64) * width + self.kind[inverse[places]], return_counts=True)
            own = counts[np.searchsorted(pairs, text[open_].astype(np.int64) * width + kind[open_])]
            result[open_] = self.model[kind[open_]] > own
        return result


def all_log_probabilities(whole: np.ndarray, text: np.ndarray, lang: str, files: list[tuple]) -> np.ndarray:
    """Of each place the log probability of its code after the codes before, given its gram.

    Orders are tried from the highest; a gram counts as seen if it occurs more often than in
    its text alone, and a context's back-off weight is paid if the context does. Every distinct
    gram of the slice is looked up once. Only places whose gram hangs on the text's own counts
    are followed one by one.
    """
    inverse, grams_ = pd.factorize(whole)
    total = np.bincount(inverse, minlength=len(grams_))
    value, single = np.zeros(len(grams_)), np.zeros(len(grams_), bool)
    open_, levels = np.arange(len(grams_)), []
    full, kind = grams_, np.arange(len(grams_))
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            shorter, full = pd.factorize(full & ((1 << BITS * order) - 1))
            kind = shorter[kind]
        seen = _Level(kind, len(full), total)
        seen.ask(open_, full | (order << 60), lang, files, ("raw", "logp"))
        single[open_] |= seen.hangs[kind[open_]]
        done = seen.sure[kind[open_]] & ~single[open_]
        value[open_[done]] += seen.value[kind[open_[done]]]
        open_ = open_[~done]
        to_context, contexts = pd.factorize(full >> BITS)
        context = _Level(to_context[kind], len(contexts), total)
        context.ask(open_, contexts | (order - 1 << 60), lang, files, ("follow", "bow"))
        single[open_] |= context.hangs[context.kind[open_]]
        at = context.kind[open_]
        value[open_] += np.where(context.sure[at], context.value[at], 0.0)
        levels.append((seen, context))
    value[open_] -= np.log(1 << BITS)
    result = value[inverse]
    places = np.flatnonzero(single[inverse])
    exact, left = np.zeros(len(places)), np.arange(len(places))
    for seen, context in levels:
        gram, owner = inverse[places[left]], text[places[left]]
        known = seen.known(gram, owner, inverse, text)
        exact[left[known]] += seen.value[seen.kind[gram[known]]]
        left, gram, owner = left[~known], gram[~known], owner[~known]
        paid = context.known(gram, owner, inverse, text)
        exact[left[paid]] += context.value[context.kind[gram[paid]]]
    exact[left] -= np.log(1 << BITS)
    result[places] = exact
    return result


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    again = 0
    if len(words) >= REPEAT_WINDOW:
        windows = rolling(word_hashes(words), REPEAT_WINDOW, BASES[0])
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        again = int(cover(len(words), starts, starts + REPEAT_WINDOW).sum()) if len(starts) else 0
    chars = len(text.translate(None, b" \t\n\x0b\x0c\r").decode())
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated, again


def log_probabilities(codes: np.ndarray, lang: str, files: list[tuple]) -> np.ndarray:
    """``all_log_probabilities`` of one text."""
    return all_log_probabilities(*all_grams(codes, np.array([len(codes)])), lang, files)


def _means(logs: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of its places and its standard error; not a number without places."""
    sizes = np.bincount(text, minlength=count)
    with np.errstate(invalid="ignore"):
        means = np.bincount(text, weights=logs, minlength=count) / sizes
        spread = np.bincount(text, weights=(logs - means[text]) ** 2, minlength=count) / sizes
        return means, np.sqrt(spread / sizes)


def _with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A ``text`` column, from the row where it is only there."""
    if "text" in batch.schema.names:
        return batch
    return batch.append_column("text", pc.struct_field(batch.column(batch.schema.get_field_index("row")), "text"))


def _by_language(batches: Iterator[pa.RecordBatch], most: int, held: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language at a time, about ``most`` bytes of text, with ``held`` kept waiting."""
    waiting: dict[str, list[pa.RecordBatch]] = {}
    sizes: dict[str, int] = {}

    def gathered(lang: str) -> tuple[str, pa.RecordBatch]:
        del sizes[lang]
        return lang, pa.Table.from_batches(waiting.pop(lang)).combine_chunks().to_batches()[0]

    for batch in slices(map(_with_text, batches), most):
        kinds, langs = pd.factorize(np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object))
        for i, lang in enumerate(langs):
            part = batch.take(pa.array(np.flatnonzero(kinds == i)))
            waiting.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + part.nbytes
            if sizes[lang] >= most:
                yield gathered(lang)
        while sum(sizes.values()) > held:
            yield gathered(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield gathered(lang)


def _score(files: list[tuple], expected: dict[str, float]):
    """``row``, base counts, the score by the own language's model and, where it is low, by all.

    ``second`` is the score by the model of all languages, given its errors. It is taken of every
    text that may lie below its language's band, as no band begins above ``expected - MARGIN``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scored(batches)
        finally:
            _load.cache_clear()  # the worker may live on for other work

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCORES.split(", ")]
        for lang, batch in _by_language(batches, SLICE, 3 * SLICE):
            texts, count = texts_of(batch), batch.num_rows
            whole, text = all_grams(*all_letters(texts))
            means, errors = _means(all_log_probabilities(whole, text, lang, files), text, count)
            low = means + ERRORS * errors < expected.get(lang, 0.0) - MARGIN
            chosen = low[text]
            again, wide = _means(all_log_probabilities(whole[chosen], text[chosen], ANY, files), text[chosen], count)
            counts = zip(*map(base_counts, texts), strict=True)
            scores = (means, errors, np.where(low, again + ERRORS * wide, np.nan))
            added = [pa.array(c, pa.int64()) for c in counts] + [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in scores]
            kept = ["lang", "row", "text_digest"]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *added], names=[*kept, *names])

    return run


def judged(docs: DataFrame, row: Column, scratch: Scratch) -> DataFrame:
    """Per document: ``row`` as given, the base counts, base_failed, perplexity and kept.

    ``docs`` has text and lang; a null lang is a language of its own, null texts count as empty
    and fail the base rules. The bands follow from all texts that pass the base rules, each once:
    quartiles of the mean log probability, to the thousandth, per language. Copies have one score.
    """
    read = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text", row.alias("row"),
        digest(F.col("text")).alias("text_digest"),
    )
    model, means = trained(read.select("lang", "text"), scratch, least=2)
    model, means = scratch.write(model), scratch.write(means)
    _, files = store(model, scratch)
    expected = {r.lang: r.expected for r in means.collect()}  # a row per language
    kind = read.schema["row"].dataType.simpleString()
    whole = "text" in getattr(read.schema["row"].dataType, "names", [])  # then a text goes to Python once
    scored = scratch.write(
        (read.drop("text") if whole else read).mapInArrow(released(_score(files, expected)), f"lang string, row {kind}, text_digest binary, {SCORES}"), compression="zstd"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    texts = scored.filter(~failed).groupBy("lang", "text_digest").agg(F.max(F.round("score", 3)).alias("value"))
    rounded = texts.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"))
    quartile = {q: F.expr(f"percentile(value, {q}, n)") for q in (0.25, 0.75)}
    bands = rounded.groupBy("lang").agg(quartile[0.25].alias("q1"), quartile[0.75].alias("q3"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    bands = bands.join(means, "lang").select(
        "lang",
        F.least(F.col("q1") - reach, F.col("expected") - MARGIN).alias("low"),
        (F.col("q3") + reach).alias("high"),
    )
    bands = scratch.write(bands)
    if len(expected) <= FEW_LANGUAGES:
        bands = F.broadcast(bands)
    usual = (F.col("score") + ERRORS * F.col("error") >= F.col("low")) | F.coalesce(
        F.col("second") >= F.col("low"), F.lit(False)
    )
    varied = F.col("score") - ERRORS * F.col("error") <= F.col("high")
    return scored.join(bands, "lang", "left").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce(~failed & usual & varied, F.lit(False)).alias("kept"),
        F.exp(-F.col("score")).alias("perplexity"),
        F.exp(-F.col("high")).alias("lower_band"),
        F.exp(-F.col("low")).alias("upper_band"),
    )


def passing(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, F.struct("*"), scratch).filter("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judged(documents(spark, folder), F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), Scratch(spark))
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "perplexity", "lower_band", "upper_band",
    )
