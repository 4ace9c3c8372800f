from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillgrain.functions.ranking import (
    digits_of,
    middle_ranks,
    order_statistics,
    quantile_ranks,
    value_of,
)

NAMES = ["d1", "d2", "d3"]


def table(spark, values, group="g"):
    df = spark.createDataFrame([(group, v) for v in values], "g string, v bigint")
    return df.select("g", *[d.alias(n) for d, n in zip(digits_of(F.col("v")), NAMES, strict=True)])


def found(df, ranks, **options):
    stats = order_statistics(df, "g", NAMES, ranks, **options)
    out = stats.select("g", "slot", value_of(*[F.col(n) for n in NAMES]).alias("v")).collect()
    return {(r.g, r.slot): r.v for r in out}


@pytest.mark.parametrize(
    "values",
    [
        [7],
        [3, 1],
        [5] * 40,
        [-(2**62), -1, 0, 1, 2**62, 2**44, 2**44 - 1, 2**22, 2**22 - 1],
        [random.Random(1).randrange(-(10**12), 10**12) for _ in range(301)],
        [0] * 100 + [random.Random(2).randrange(10**9) for _ in range(200)],
    ],
)
def test_ranks_match_sorting(spark, values):
    ordered = sorted(values)
    n = len(values)
    got = found(table(spark, values), quantile_ranks(5))
    assert got == {("g", k - 1): ordered[(n - 1) * k // 5] for k in range(1, 5)}


def test_groups_and_weights(spark):
    data = [("a", 10, 3), ("a", 20, 1), ("b", 5, 2), ("b", 2**30, 2), ("c", 9, 1)]
    df = spark.createDataFrame(data, "g string, v bigint, w bigint").select(
        "g", "w", *[d.alias(n) for d, n in zip(digits_of(F.col("v")), NAMES, strict=True)]
    )
    got = found(df, middle_ranks, weight="w")
    assert got == {
        ("a", 0): 10, ("a", 1): 10,
        ("b", 0): 5, ("b", 1): 2**30,
        ("c", 0): 9, ("c", 1): 9,
    }


@pytest.mark.parametrize("n", [7, 20, 101, 103, 250])
def test_scores_match_pandas_qcut(spark, n):
    """The search against pandas, with ties and sizes that put edges on a value."""
    from tillgrain.operators import rfm

    rng = random.Random(n)
    data = [
        (i * 7919 % 100_003, rng.randrange(0, 400), rng.choice([1, 1, 1, 2, 3, 9]), rng.randrange(100, 10**7))
        for i in range(1, n + 1)
    ]
    pdf = pd.DataFrame(data, columns=["CustomerID", "Recency", "Frequency", "cents"]).sort_values("CustomerID")
    pdf["Monetary"] = pdf["cents"] / 100
    want = pdf[["CustomerID"]].copy()
    want["R"] = pd.qcut(pdf["Recency"], 5, labels=[5, 4, 3, 2, 1]).astype(int)
    want["F"] = pd.qcut(pdf["Frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    want["M"] = pd.qcut(pdf["Monetary"], 5, labels=[1, 2, 3, 4, 5]).astype(int)
    expected = {r.CustomerID: (r.R, r.F, r.M) for r in want.itertuples()}

    df = spark.createDataFrame(data, "CustomerID bigint, Recency bigint, Frequency bigint, cents bigint")
    df = df.withColumn("Monetary", (F.col("cents") / 100).cast("decimal(20,2)"))
    scored = rfm.score_rfm(df).select("CustomerID", "R_Score", "F_Score", "M_Score").collect()
    assert {r[0]: tuple(r[1:]) for r in scored} == expected


def test_repeated_edges_leave_a_score_empty(spark):
    from tillgrain.operators.rfm import score_rfm

    df = spark.createDataFrame(
        [(i, 5, 1) for i in range(10)] + [(99, 80, 1)], "CustomerID bigint, Recency bigint, Frequency bigint"
    ).withColumn("Monetary", F.lit(1).cast("decimal(20,2)"))
    scores = {r.CustomerID: r for r in score_rfm(df).collect()}
    assert scores[0].R_Score == 5 and scores[99].R_Score == 1
    assert {r.M_Score for r in scores.values()} == {1}
