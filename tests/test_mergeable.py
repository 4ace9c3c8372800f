from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_star_and_reports import some_lines
from tillgrain.config import CleaningConfig
from tillgrain.functions import sketches
from tillgrain.operators import bucketed, cleaning, distincts, quality
from tillgrain.operators.star import Star
from tillgrain.plans import customer_reports
from tillgrain.session import Scratch

# distinct counts


def visits(spark, seed=1, count=600):
    rng = random.Random(seed)
    # a third of all rows have one customer
    who = lambda: 7 if rng.random() < 0.34 else rng.choice([None, rng.randint(-40, 40), rng.randint(32760, 32775), 10**12 + rng.randint(0, 5)])
    data = [(date(2010, 11, 1) + timedelta(days=rng.randrange(430)), who(), rng.choice(["a", "b", "ß", None])) for _ in range(count)]
    return spark.createDataFrame(data, "day date, customer bigint, product string"), data


def plain_counts(data, column):
    label = {
        "day": lambda d: d.isoformat(), "month": lambda d: d.isoformat()[:7],
        "quarter": lambda d: f"{d.year}-Q{(d.month + 2) // 3}", "year": lambda d: str(d.year), "all": lambda d: "all",
    }
    found = {}
    for row in data:
        if row[column] is not None:
            for level, name in label.items():
                found.setdefault((level, name(row[0])), set()).add(row[column])
    return sorted((*k, len(v)) for k, v in found.items())


def test_periods_merge_to_exact_distinct_counts(spark):
    frame, data = visits(spark)
    days = distincts.id_bitmaps(frame, ["day"], "customer")
    assert rows(distincts.period_counts(days, "day", "n")) == plain_counts(data, 1)
    values = frame.select("product").filter("product is not null").distinct()
    days = distincts.id_bitmaps(frame, ["day"], "product", distincts.numbered(values, "product", 3))
    assert rows(distincts.period_counts(days, "day", "n")) == plain_counts(data, 2)
    with pytest.raises(TypeError):
        distincts.id_bitmaps(frame, ["day"], "product")


def test_new_days_are_added_without_old_rows(spark):
    (first, a), (second, b) = visits(spark, 2), visits(spark, 3)
    kept = distincts.id_bitmaps(first, ["day"], "customer").unionByName(distincts.id_bitmaps(second, ["day"], "customer"))
    both = distincts.merged(kept, ["day"])
    assert both.groupBy("day", "_bucket").count().filter("count > 1").isEmpty()
    assert rows(distincts.period_counts(both, "day", "n")) == plain_counts(a + b, 1)


def test_counting_needs_no_ids_in_the_shuffle(spark):
    frame, _ = visits(spark)
    plan = distincts.distinct_counts(distincts.id_bitmaps(frame, ["day"], "customer"), ["day"], "n")._jdf.queryExecution().toString()
    assert "partial_bitmap_construct_agg" in plan and "Expand" not in plan


# quantile sketches


def test_small_sketches_are_exact_and_merge(spark):
    frame = spark.createDataFrame([(m, v) for m in "ab" for v in range(50)] + [("a", None)], "month string, v bigint")
    parts = sketches.sketches(frame, "v", ["month"])
    assert rows(parts, "month", "rows") == [("a", 50), ("b", 50)]
    found = sketches.sketched_quantiles(parts, [0.0, 0.5, 1.0])
    assert rows(found) == [(0.0, 0), (0.5, 24), (1.0, 49)]
    assert rows(sketches.sketched_quantiles(parts, [0.5], ["month"])) == [("a", 0.5, 24), ("b", 0.5, 24)]
    assert rows(sketches.measured_error(frame, "v", found), "fraction", "error") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_large_sketches_keep_their_bound(spark):
    # a third of the rows have one value
    frame = spark.range(200_000).select((F.col("id") % 16).alias("part"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id") % 1000).alias("v"))
    parts = sketches.sketches(frame, "v", ["part"], 200)
    found = sketches.measured_error(frame, "v", sketches.sketched_quantiles(parts, [0.1, 0.5, 0.9]))
    assert all(r.error <= 3 * sketches.rank_error(200) for r in found.collect())
    assert sketches.rank_error(800) < sketches.rank_error(200) < 0.02


def test_no_values(spark):
    none = spark.createDataFrame([], "v bigint")
    found = sketches.sketched_quantiles(sketches.sketches(none, "v"), [0.5])
    assert found.collect() == [] and sketches.measured_error(none, "v", found).collect() == []


def test_cleaning_may_cut_by_sketch(make_lines):
    lines = make_lines(*[(str(i), "A", "a", i + 1, "2011-01-01 00:00", 2.5, 1, "UK") for i in range(100)])
    exact = cleaning.clean_sales(lines, CleaningConfig(quantity_quantile=0.9))
    sketch = cleaning.clean_sales(lines, CleaningConfig(quantity_quantile=0.9, sketch_size=200))
    assert (exact.count(), sketch.count()) == (90, 90)


def test_several_exact_quantiles_in_one_search(spark):
    frame = spark.createDataFrame([(v, 1 + v % 3) for v in (5, 1, 9, 9, 2, 40)], "v bigint, n int")
    values = sorted(v for v in (5, 1, 9, 9, 2, 40) for _ in range(1 + v % 3))
    import numpy as np

    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {r.fraction: r.threshold for r in cleaning.exact_quantiles(frame, "v", fractions, "n").collect()}
    assert found == pytest.approx({f: float(np.quantile(values, f)) for f in fractions})
    assert rows(cleaning.exact_quantile(frame.limit(0), "v", 0.5)) == [(None, None)]


# orphans


def test_orphans_are_counted_exactly(make_sales):
    star = Star.build(some_lines(make_sales))
    fact = star.fact_transactions
    day = fact.agg(F.min("datekey")).first()[0]
    spoilt = fact.withColumn("customerid", F.when(F.col("customerid") == 3, 999).otherwise(F.col("customerid")))
    spoilt = spoilt.withColumn("country", F.when(F.col("country") == "France", None).otherwise(F.col("country")))
    broken = Star(**{**vars(star), "fact_transactions": spoilt, "dim_date": star.dim_date.filter(F.col("datekey") != F.lit(day))})
    want = {
        "customerid -> dim_customers": fact.filter("customerid = 3").count(),
        "stockcode -> dim_products": 0,
        "datekey -> dim_date": fact.filter(F.col("datekey") == F.lit(day)).count(),
        "country -> dim_geography": 0,
    }
    assert want["customerid -> dim_customers"] and want["datekey -> dim_date"]
    assert {r.foreign_key: r.orphans for r in quality.foreign_keys(broken).collect()} == want
    sound = quality.foreign_keys(star)
    assert {r.orphans for r in sound.collect()} == {0}


def test_only_buckets_in_doubt_are_compared(spark):
    with Scratch(spark) as scratch:
        used = scratch.write(spark.range(0, 200_000).select(F.col("id").alias("k")))
        known = scratch.write(used.filter("k <> 70000"))
        doubt = quality._in_doubt(used, known, "k", scratch)
        assert (doubt.count(), doubt.agg(F.min("k"), F.max("k")).first()[:]) == (32768, (65537, 98304))
        assert quality._in_doubt(known, used, "k", scratch).count() == 0


# the bucketed star


@pytest.fixture
def customer_star(spark, make_sales, tmp_path):
    lines = some_lines(make_sales, 26)
    one = lines.filter("CustomerID = 11")
    crowd = one.crossJoin(spark.range(1, 60)).withColumn("InvoiceNo", F.concat("InvoiceNo", F.lit("+"), F.col("id").cast("string"))).drop("id")
    plain = Star.build(lines.unionByName(crowd))
    made = bucketed.CustomerStar.write(plain.fact_transactions, plain.dim_customers, str(tmp_path), 4, "star_of_a_test")
    yield plain, made
    for table in bucketed._TABLES:
        spark.sql(f"DROP TABLE star_of_a_test_{table}")


def test_reports_on_buckets_equal_the_plain_ones(spark, customer_star):
    plain, made = customer_star
    assert rows(made.hot_customers, "customerid") == [(11,)]
    assert made.fact.filter("customerid = 11").isEmpty() and made.fact.count() + made.hot_fact.count() == plain.fact_transactions.count()
    assert rows(bucketed.segment_revenue(made)) == rows(quality.segment_revenue(plain.fact_transactions, plain.dim_customers))
    from tillgrain.operators.star import lines_of_fact

    for segment in ("Champions", "Loyal Customers"):
        named = plain.dim_customers.withColumn("segment", F.when(F.col("segment") == segment, "Champions").otherwise("other"))
        want = customer_reports.champions_deep_dive(named, lines_of_fact(plain.fact_transactions))
        assert rows(bucketed.champions_deep_dive(made, segment)) == rows(want)


def test_the_bucketed_fact_is_not_shuffled(spark, customer_star):
    _, made = customer_star
    only = bucketed.CustomerStar(made.fact, made.customers, made.hot_fact.limit(0), made.hot_customers.limit(0))
    for frame in (only.per_customer(lambda f: f.groupBy("customerid").agg(F.count(F.lit(1)).alias("n"))), bucketed.champions_deep_dive(only)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
