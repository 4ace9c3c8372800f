"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a shuffled order. Its virtual finish time is the
number of source words up to its end, repeats counted, divided by the source's target; at time 1
every source has delivered its target. Entries (document, pass) are range-sorted globally by
finish time, and the total budget cuts the order.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillgrain.llm.common import WORD, documents, width
from tillgrain.session import Scratch

PASSES = 3
SEED = 7


def targets(sizes: DataFrame, passes: int = PASSES, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Words to take from each source: (source, source_size, target).

    Sources in code point order, null last, weigh ``weights``, repeating. All sizes together are
    shared by weight; a target stops at ``passes`` times its source's size and the excess is
    reshared among the others until none is above. Sources without words have target 0.

    With saturation points r = passes * size / weight in ascending order, the sources below some
    level t are full and the rest get t * weight; that level follows from running sums, without
    a loop. One row per source; the sums run in one task, so the number of sources must fit it.
    """
    by_code_point = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    place = (F.row_number().over(by_code_point) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("double")
    ranked = sizes.select("source", "source_size", weight.alias("w")).withColumn(
        "most", (F.col("source_size") * passes).cast("double")
    )
    running = W.orderBy(F.col("most") / F.col("w"), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(running), F.lit(0.0))
    ) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(running), F.lit(0.0)))
    # the first source whose saturation lies above the level reached with all before it full
    staged = ranked.withColumn("level", level)
    open_ = F.when(
        F.col("level") * F.col("w") < F.col("most"),
        F.struct(F.col("most") / F.col("w"), "source", "level"),
    )
    final = F.min(open_).over(whole)["level"]
    target = F.coalesce(F.least(F.col("most"), final * F.col("w")), F.col("most"))
    return staged.select("source", "source_size", target.alias("target"))


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows of the group.

    Rows are range-partitioned by group and order, so a group may span any number of tasks:
    each task sums its own part, and parts are offset by the totals of the parts before.
    """
    parts = scratch.write(
        rows.repartitionByRange(width(rows.sparkSession), *group, *order).withColumn("_part", F.spark_partition_id())
    )
    totals = parts.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    offsets = totals.withColumn(
        "_offset",
        F.coalesce(F.sum("_sum").over(earlier.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_sum")
    within = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = parts.alias("l").join(offsets.alias("r"), _same("l", "r", ["_part", *group])).select("l.*", "_offset")
    return joined.withColumn(
        "before", F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))
    ).drop("_part", "_offset")


def fair_mix(sized: DataFrame, scratch: Scratch, passes: int = PASSES, seed: int = SEED, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix and the sources' targets.

    ``sized`` has doc_id, row_key, source, size. The mix has one row per document and pass:
    doc_id, row_key, source, pass, finish, words, position; ``position`` is the number of words
    before it in the mix. The entry in which the budget ends for a source gives its first words
    only or, if ``whole``, is taken entirely when at least half of it lies before the end.
    Shuffling is by a seeded hash of doc_id and text, so that reruns agree; equal rows follow
    each other. Rows of size 0 are never taken.
    """
    sources = scratch.write(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), passes)
    )
    shuffled = sized.filter("size > 0").withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "row_key"))
    placed = running_sums(shuffled, ["source"], ["lot", "doc_id", "row_key", "copy"], "size", scratch)
    entries = (
        placed.alias("p")
        .join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
        .select("p.doc_id", "p.row_key", "p.copy", "p.source", "p.size", "p.before", "s.source_size", "s.target")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
        .withColumn("start", F.col("before") + (F.col("pass") - 1) * F.col("source_size"))
        .withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
    )
    # words of the entry whose own finish time is within the budget, that is before time 1
    inside = F.least(F.col("size"), F.floor(F.col("target") + F.lit(1e-6)) - F.col("start"))
    if whole:
        words = F.when(F.col("start") + F.col("size") / 2 <= F.col("target") + F.lit(1e-6), F.col("size")).otherwise(F.lit(0))
    else:
        words = inside
    entries = entries.withColumn("words", words.cast("bigint")).filter("words > 0")
    ordered = running_sums(
        entries.select("doc_id", "row_key", "copy", "source", "pass", "finish", "words"),
        [],
        ["finish", "source", "doc_id", "row_key", "copy", "pass"],
        "words",
        scratch,
    ).withColumnRenamed("before", "position")
    budget = F.lit(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    if not whole:
        ordered = ordered.filter(F.col("position") < budget)
    return ordered, sources


def sizes_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, row_key, copy, source and size (words of the whole text; null has none) per row.

    ``copy`` numbers the rows of one table, so rows repeated in every column stay apart.
    """
    text = F.coalesce("text", F.lit(""))
    return scratch.write(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.xxhash64(text).alias("row_key"),
            F.monotonically_increasing_id().alias("copy"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        )
    )


def op3_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, source_size, target, taken per document; repeated rows count one by one."""
    scratch = Scratch(spark)
    sized = sizes_of(documents(spark, folder), scratch)
    mix, sources = fair_mix(sized, scratch)
    taken = mix.groupBy("copy").agg(F.sum("words").alias("taken"))
    return (
        sized.join(taken, "copy", "left")
        .alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents the mix takes, whole, once per pass that takes them, with their columns."""
    sized = sizes_of(docs, scratch)
    mix, _ = fair_mix(sized, scratch, whole=True)
    # equal rows are told apart by nothing but their number: it suffices to know how often
    # all of them together are taken
    key = ["doc_id", "row_key", "source"]
    taken = mix.groupBy(*key).agg(F.count(F.lit(1)).alias("taken")).alias("t")
    rows = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).alias("r")
    wanted = taken.join(rows, _same("t", "r", key)).select("t.*", "rows").alias("w")
    given = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"),
        F.col("source").cast("string").alias("source"),
    ).alias("d")
    found = given.join(wanted, _same("d", "w", key)).select("row", "taken", "rows")
    # each of some equal rows gives its part of their copies
    share = F.when(F.col("rows") == 1, F.col("taken")).otherwise(F.ceil(F.col("taken") / F.col("rows")))
    return found.withColumn("pass", F.explode(F.sequence(F.lit(1), share.cast("int")))).select("row.*")


def _same(left: str, right: str, key: list[str]) -> Column:
    match = F.lit(True)
    for name in key:
        match = match & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return match
