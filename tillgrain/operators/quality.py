"""Data-quality checks: expected sizes, keys and value rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.config import MINIMUM_ROWS
from tillgrain.functions.numeric import ratio, rounded
from tillgrain.operators.distincts import id_bitmaps
from tillgrain.operators.star import Star
from tillgrain.session import Scratch, materialize

PRIMARY_KEYS = {
    "dim_customers": "customerid",
    "dim_products": "stockcode",
    "dim_date": "datekey",
    "dim_geography": "country",
    "dim_rfm_segments": "segment",
}
FOREIGN_KEYS = {
    "customerid": "dim_customers",
    "stockcode": "dim_products",
    "datekey": "dim_date",
    "country": "dim_geography",
}
REQUIRED_FACT = ("invoiceno", "invoicedate", "quantity", "unitprice", "totalamount")
SCORES = ("r_score", "f_score", "m_score")


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(star: Star) -> DataFrame:
    """Rows of the fact and of the four built dimensions."""
    return _stack(
        [
            getattr(star, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
            for name in MINIMUM_ROWS
        ]
    )


def expected_row_counts(counts: DataFrame, minimum: dict[str, int] = MINIMUM_ROWS) -> DataFrame:
    expected = F.create_map(*[F.lit(x) for pair in minimum.items() for x in pair])
    least = expected[F.col("tbl")].cast("bigint")
    return counts.select(
        "tbl", "rows", least.alias("expected"), (F.col("rows") >= least).cast("int").alias("ok")
    )


def _whole(key: str, kind: T.DataType) -> Column | None:
    """The key as a whole number that tells its values apart, if it has one."""
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("bigint")
    return F.col(key).cast("bigint") if isinstance(kind, T.IntegralType) else None


def _in_doubt(used: DataFrame, known: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows of ``used`` whose key may lack a row in ``known``.

    Whole numbers are compared as exact bitmaps, combined on the map side: a bucket is in doubt
    if the dimension and the fact together have more bits there than the dimension alone. A Bloom
    filter would not do: a stranger that it lets pass would never be counted.
    """
    number = _whole(key, used.schema[key].dataType)
    present = used.filter(F.col(key).isNotNull())
    if number is None:
        return present
    ids = lambda frame: id_bitmaps(frame.select(number.alias("_id")), [], "_id")
    tagged = ids(known).withColumn("_known", F.bitmap_count("bits")).unionByName(ids(used).withColumn("_known", F.lit(0).cast("bigint")))
    both = tagged.groupBy("_bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("_known").alias("_known"))
    doubtful = scratch.write(both.filter(F.bitmap_count("bits") > F.col("_known")).select("_bucket"))
    return present.withColumn("_bucket", F.bitmap_bucket_number(number)).join(doubtful, "_bucket", "left_semi").drop("_bucket")


def foreign_keys(star: Star) -> DataFrame:
    """Fact rows per foreign key without a dimension row; null keys are allowed.

    One pass over the fact keeps its four keys, as typed. Only rows in doubt are counted per value
    and compared exactly; of a sound fact with whole-number keys none are, and no row is shuffled.
    Text keys are counted per value on the map side.
    """
    with Scratch(star.fact_transactions.sparkSession) as scratch:
        used = scratch.write(star.fact_transactions.select(*FOREIGN_KEYS))
        found = []
        for key, dimension in FOREIGN_KEYS.items():
            known = scratch.write(getattr(star, dimension).select(F.col(key).cast(used.schema[key].dataType).alias(key)).distinct())
            counted = _in_doubt(used.select(key), known, key, scratch).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            orphans = counted.join(known, key, "left_anti").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphans"))
            found.append(orphans.select(F.lit(f"{key} -> {dimension}").alias("foreign_key"), "orphans"))
        return materialize(_stack(found))


def primary_keys(star: Star) -> DataFrame:
    """Repeated and missing primary key values per dimension."""

    def check(name: str, key: str) -> DataFrame:
        seen = getattr(star, name).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        return seen.agg(
            F.count_if(F.col("_rows") > 1).alias("duplicates"),
            F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_rows"))), F.lit(0)).alias("nulls"),
        ).select(F.lit(name).alias("tbl"), "duplicates", "nulls")

    return _stack([check(name, key) for name, key in PRIMARY_KEYS.items()])


def table_keys(
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]],
    links: dict[tuple[str, str], tuple[str, str]],
) -> DataFrame:
    """Key faults of tables as given: (tbl, rule, values, rows).

    ``repeated`` counts key values found on several rows and those rows, ``missing`` rows with
    a null in the key, and a link's ``unmatched`` the values without a target and their rows.
    Rows are counted per value on the map side before anything is compared.
    """

    def fault(table: str, rule: str, counted: DataFrame) -> DataFrame:
        return counted.agg(
            F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows")
        ).select(F.lit(table).alias("tbl"), F.lit(rule).alias("rule"), "values", "rows")

    found = []
    for table, key in keys.items():
        counted = tables[table].groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
        absent = reduce(Column.__or__, [F.col(k).isNull() for k in key])
        found.append(fault(table, "repeated", counted.filter(~absent & (F.col("_rows") > 1))))
        found.append(fault(table, "missing", counted.filter(absent)))
    for (table, column), (target, key) in links.items():
        used = tables[table].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
        known = tables[target].select(F.col(key).alias(column))
        found.append(fault(table, f"{column} unmatched", used.join(known, column, "left_anti")))
    return _stack(found)


def value_rules(star: Star) -> DataFrame:
    """Violations of NOT NULL and of the score range, one pass per table."""

    def violations(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
        counted = frame.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
        as_rows = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
        return counted.select(F.inline(F.array(*as_rows)))

    required = {f"fact_transactions.{c} not null": F.col(c).isNull() for c in REQUIRED_FACT}
    ranges = {f"dim_customers.{c} 1 to 5": ~F.col(c).between(1, 5) for c in SCORES}
    return violations(star.fact_transactions, required).unionByName(
        violations(star.dim_customers, ranges)
    )


def segment_revenue(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers, revenue and mean line value per segment, as the fact has them.

    The fact is summed per customer first, on the map side, so the join is one row to one row.
    """
    spent = fact.groupBy("customerid").agg(
        F.sum("totalamount").alias("_spent"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        spent.join(customers.select("customerid", "segment"), "customerid")
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("_spent").alias("_revenue"),
            F.sum("_rows").alias("_lines"),
        )
        .select(
            "segment",
            "customers",
            rounded(F.col("_revenue"), 0).alias("total_revenue"),
            rounded(ratio(F.col("_revenue"), F.col("_lines")), 2).alias("avg_line_value"),
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def top_spenders(customers: DataFrame, n: int = 5) -> DataFrame:
    return (
        customers.orderBy(F.desc("monetary"), "customerid")
        .limit(n)
        .select("customerid", "segment", "monetary", "frequency", "r_score", "f_score", "m_score")
    )


def top_countries(geography: DataFrame, n: int = 5) -> DataFrame:
    return (
        geography.orderBy("revenuerank", "country")
        .limit(n)
        .select("country", "totalrevenue", "totalorders", "uniquecustomers", "revenuerank")
    )


def score_balance(customers: DataFrame) -> DataFrame:
    """Customers per score of each metric; balanced quintiles hold about a fifth each."""
    scores = F.array(
        *[F.struct(F.lit(s[0].upper()).alias("metric"), F.col(s).alias("score")) for s in SCORES]
    )
    return (
        customers.select(F.inline(scores))
        .groupBy("metric", "score")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("metric", "score")
    )
