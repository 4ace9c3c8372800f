"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text. New data
is grouped by digest (sums combine on the map side), reduced to unknown digests by a sort-merge
anti-join in which the index is not shuffled, and appended in the same layout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import LOWER, UPPER, documents, width
from tillgrain.session import Scratch, scratch_root

#: a digest with more than this share of all rows is resolved by a broadcast of at most 1/share rows
HOT_SHARE = 0.001


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


class DigestIndex:
    """Digests seen so far, with the row that stays for each.

    ``location`` keeps the index beyond the session: opened again, the table is registered over
    the files found there.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int):
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (text_digest BINARY, doc_id BIGINT, row_id BIGINT) "
            f"USING parquet CLUSTERED BY (text_digest) SORTED BY (text_digest) "
            f"INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add the digests of ``rows`` (text_digest, doc_id, row_id) that are not yet known.

        Of rows with one digest that with the largest (doc_id, row_id) enters; null doc_ids
        lose to all others. Appending the same rows again changes nothing.
        """
        newest = rows.groupBy("text_digest").agg(F.max(F.struct("doc_id", "row_id")).alias("last"))
        unknown = newest.join(self.read().hint("merge"), "text_digest", "left_anti")
        (
            unknown.select("text_digest", "last.doc_id", "last.row_id")
            .repartition(self.buckets, "text_digest")
            .sortWithinPartitions("text_digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "text_digest")
            .sortBy("text_digest")
            .option("path", self.location)
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_duplicates(docs: DataFrame, scratch: Scratch, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, text_digest, keep_id, group_size, kept.

    The upper half of the doc_id range enters the index first and the lower half is then
    deduplicated against it, so the largest doc_id of equal texts stays. Null texts count as
    empty; rows repeated with one doc_id count one by one and exactly one of them stays; rows
    without a doc_id lose to all others. Other columns are not read.
    """
    spark = docs.sparkSession
    keyed = scratch.write(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            digest(F.col("text")).alias("text_digest"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    total, low, high = keyed.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(0 if low is None else (low + high) // 2)
    index = DigestIndex(
        spark,
        f"digests_{uuid.uuid4().hex}",
        f"{scratch_root(spark)}/digests-{uuid.uuid4().hex}",
        buckets or width(spark),
    )
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.append(keyed.filter(upper))
    index.append(keyed.filter(~upper))

    sizes = keyed.groupBy("text_digest").agg(F.count(F.lit(1)).alias("group_size"))
    decided = scratch.write(
        index.read()
        .join(sizes, "text_digest")
        .withColumnsRenamed({"doc_id": "keep_id", "row_id": "keep_row"})
    )
    crowded = F.col("group_size") > max(1, int(total * HOT_SHARE))
    hot = decided.filter(crowded)
    rest = keyed.join(F.broadcast(hot.select("text_digest")), "text_digest", "left_anti")
    both = keyed.join(F.broadcast(hot), "text_digest").unionByName(
        rest.join(decided.filter(~crowded), "text_digest")
    )
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        "text_digest",
    )


def op2_digest_index(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(documents(spark, folder), Scratch(spark))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("text_digest")).alias("text_sha256"),
    )


OP2_SQL = f"""
WITH keyed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM keyed
"""


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without those whose text another one, with a larger doc_id, has too.

    All columns stay. A kept (doc_id, digest) pair selects its rows; where rows repeat both,
    one of them stays.
    """
    kept = exact_duplicates(docs, scratch).filter("kept")
    kept = kept.select("doc_id", "text_digest", (F.col("group_size") > 1).alias("shared")).alias("k")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("text_digest")
    ).alias("d")
    same = (F.col("d.text_digest") == F.col("k.text_digest")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    found = rows.join(kept, same).select("row", "d.text_digest", "shared")
    single = found.filter(~F.col("shared")).select("row.*")
    return single.unionByName(found.filter("shared").dropDuplicates(["text_digest"]).select("row.*"))
