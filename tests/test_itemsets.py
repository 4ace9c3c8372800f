from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_basket import ALL, brute, lines_of
from tillgrain.config import BasketConfig
from tillgrain.operators import basket, itemsets
from tillgrain.plans import flows
from tillgrain.session import Scratch


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as held:
        yield held


def some_baskets(seed):
    rng = random.Random(seed)
    # a third of the baskets are copies of one long basket
    return [list("ABCDEFG")] * 40 + [rng.sample("ABCDEFGHIJKL", rng.randrange(2, 8)) for _ in range(80)]


def as_rows(spark, baskets):
    return spark.createDataFrame([(str(i), x) for i, b in enumerate(baskets) for x in b], "InvoiceNo string, Item string")


def sets_of(found):
    return {tuple(r.itemset): r.n for r in found.collect()}


@pytest.mark.parametrize("most_pairs", [1, 9, 50_000])
def test_sets_of_any_length_equal_brute_force(spark, scratch, most_pairs):
    data = some_baskets(3)
    found = itemsets.mined_itemsets(as_rows(spark, data), scratch, BasketConfig(min_support=0.1), most_pairs=most_pairs)
    want = brute(data, 0.1, 12)
    assert max(map(len, want)) == 7
    assert sets_of(found) == want
    assert all(r.length == len(r.itemset) and r.support == r.n / len(data) for r in found.collect())


def test_length_limit_equals_level_search(spark, scratch):
    data = some_baskets(4)
    config = BasketConfig(min_support=0.05)
    for longest in (1, 2, 3):
        found = itemsets.mined_itemsets(as_rows(spark, data), scratch, config, longest)
        frame = spark.createDataFrame([(sorted(b),) for b in data], "Items array<string>")
        assert sets_of(found) == sets_of(basket.frequent_itemsets(frame, BasketConfig(min_support=0.05, max_length=longest)))


def test_several_bitmaps_and_uneven_slots(spark, scratch, monkeypatch):
    monkeypatch.setattr(itemsets, "BITS", 8)
    data = some_baskets(5)
    places = itemsets.numbered(as_rows(spark, data).select("InvoiceNo").distinct(), "InvoiceNo", len(data), 8).collect()
    assert len({(r._bucket, r._position) for r in places}) == len(data)
    assert max(r._position for r in places) < 8
    found = itemsets.mined_itemsets(as_rows(spark, data), scratch, BasketConfig(min_support=0.1), 4)
    assert sets_of(found) == brute(data, 0.1, 4)


def test_a_basket_of_ten_thousand_products_stays_bounded(spark, scratch):
    data = some_baskets(6)
    wide = [f"p{i}" for i in range(10_000)] + list("ABCDE")
    found = itemsets.mined_itemsets(as_rows(spark, [*data, wide]), scratch, BasketConfig(min_support=0.1))
    assert sets_of(found) == {k: n for k, n in brute([*data, list("ABCDE")], 0.1, 12).items()}


def test_no_baskets_and_nothing_frequent(spark, scratch):
    empty = spark.createDataFrame([], "InvoiceNo string, Item string")
    assert itemsets.mined_itemsets(empty, scratch).collect() == []
    rare = as_rows(spark, [["A", "B"], ["C", "D"], ["E", "F"]])
    none = itemsets.mined_itemsets(rare, scratch, BasketConfig(min_support=0.9))
    assert none.collect() == []
    assert itemsets.grown_rules(none, scratch).collect() == []


def test_basket_rows_follow_the_arrays(make_sales):
    lines = lines_of(make_sales, "ABC", "A", "BD").unionByName(
        make_sales(("9", "A", "A", 2, "2011-05-04 10:00", 1, 1, "UK"), ("9", "A", "A", -2, "2011-05-04 10:00", 1, 1, "UK"), ("9", "B", "B", 1, "2011-05-04 10:00", 1, 1, "UK"))
    )
    arrays = basket.baskets(lines, ALL).select("InvoiceNo", F.explode("Items").alias("Item"))
    assert rows(itemsets.basket_items(lines, ALL)) == rows(arrays)


@pytest.mark.parametrize("confidence, lift", [(0.0, 0.0), (0.4, 1.0), (0.9, 0.0)])
def test_grown_rules_equal_all_splits(spark, scratch, confidence, lift):
    config = BasketConfig(min_support=0.1, min_confidence=confidence, min_lift=lift)
    found = scratch.write(itemsets.mined_itemsets(as_rows(spark, some_baskets(7)), scratch, config, 5))
    assert found.agg(F.max("length")).first()[0] == 5
    grown = itemsets.grown_rules(found, scratch, config)
    split = basket.association_rules(found, config)
    assert grown.columns == split.columns
    assert rows(grown.drop("antecedents", "consequents")) == rows(split.drop("antecedents", "consequents"))


def test_the_basket_run_finds_long_sets(spark, make_sales, tmp_path):
    lines_of(make_sales, "ABCDE", "ABCDE", "ABC", "DE").write.parquet(f"{tmp_path}/sales")
    config = BasketConfig(home_market=None, min_support=0.5, max_length=5, min_confidence=0.3, min_lift=0.0)
    results = flows.run_baskets(spark, f"{tmp_path}/sales", f"{tmp_path}/out", config)
    found = results["frequent_itemsets"].collect()
    assert max(r.length for r in found) == 5 and len(found) == 31
    stored = spark.read.option("header", True).csv(f"{tmp_path}/out/association_rules")
    assert stored.count() == sum(2 ** r.length - 2 for r in found if r.length > 1)
