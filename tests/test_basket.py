from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from tests.conftest import rows
from tillgrain.config import BasketConfig
from tillgrain.operators import basket

DAY = "2011-05-04 10:00"
ALL = BasketConfig(home_market=None, min_support=0.01, min_confidence=0.0, min_lift=0.0)


def lines_of(make_sales, *baskets, country="United Kingdom"):
    return make_sales(
        *[(str(i), x, x, 1, DAY, 1, i, country) for i, items in enumerate(baskets) for x in items]
    )


def mined(baskets, config):
    return {tuple(r.itemset): r.n for r in basket.frequent_itemsets(baskets, config).collect()}


def brute(baskets, support, longest=3):
    n = len(baskets)
    counts = {}
    for items in baskets:
        for size in range(1, longest + 1):
            for chosen in combinations(sorted(set(items)), size):
                counts[chosen] = counts.get(chosen, 0) + 1
    return {k: c for k, c in counts.items() if c >= math.ceil(support * n)}


def test_triples_and_certain_rules(make_sales):
    sets = basket.frequent_itemsets(
        basket.baskets(lines_of(make_sales, "ABC", "ABC", "AB", "CD"), ALL),
        BasketConfig(home_market=None, min_support=0.5),
    )
    assert {tuple(r.itemset): r.n for r in sets.collect()} == {
        ("A",): 3, ("B",): 3, ("C",): 3, ("A", "B"): 3, ("A", "C"): 2, ("B", "C"): 2, ("A", "B", "C"): 2,
    }
    rules = {
        (r.antecedents_str, r.consequents_str): r
        for r in basket.association_rules(sets, BasketConfig(min_confidence=0.3, min_lift=0.0)).collect()
    }
    assert len(rules) == 3 * 2 + 6
    certain = rules["A", "B"]
    assert (certain.confidence, certain.lift, certain.conviction) == (1.0, 1.3333, math.inf)
    assert certain.rule_str == "A  →  B"
    both = rules["A, B", "C"]
    assert (both.support, both.confidence, both.leverage, both.conviction) == (0.5, 0.6667, -0.0625, 0.75)


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_equal_pattern_growth_and_brute_force(spark, seed):
    rng = random.Random(seed)
    # a third of the baskets are copies of one long basket
    data = [list("ABCDEF")] * 40 + [rng.sample("ABCDEFGHIJKL", rng.randrange(2, 7)) for _ in range(80)]
    df = spark.createDataFrame([(sorted(b),) for b in data], "Items array<string>")
    config = BasketConfig(min_support=0.1)
    got = mined(df, config)
    assert got == brute(data, 0.1)
    model = FPGrowth(itemsCol="Items", minSupport=0.1, numPartitions=2).fit(df)
    grown = {tuple(sorted(r.items)): r.freq for r in model.freqItemsets.filter(F.size("items") <= 3).collect()}
    assert got == grown


def test_shorter_length_limit(spark):
    df = spark.createDataFrame([(["A", "B", "C"],)] * 3, "Items array<string>")
    assert {len(k) for k in mined(df, BasketConfig(max_length=2))} == {1, 2}
    assert {len(k) for k in mined(df, BasketConfig(max_length=1))} == {1}
    with pytest.raises(ValueError):
        basket.frequent_itemsets(df, BasketConfig(max_length=4))


def test_nothing_frequent_keeps_the_schema(spark):
    empty = spark.createDataFrame([], "Items array<string>")
    sets = basket.frequent_itemsets(empty, ALL)
    rules = basket.association_rules(sets, ALL)
    assert sets.count() == 0 and rules.count() == 0
    assert basket.top_pairs(rules).columns[:3] == ["antecedents_str", "consequents_str", "rule_str"]


def test_texts_are_normalised_and_filtered(make_sales):
    lines = make_sales(
        ("1", "1", " mug ", 1, DAY, 1, 1, "United Kingdom"),
        ("1", "2", "CUP", 1, DAY, 1, 1, "United Kingdom"),
        ("1", "3", None, 1, DAY, 1, 1, "United Kingdom"),
        ("2", "1", "MUG", 1, DAY, 1, 1, "United Kingdom"),
        ("3", "1", "MUG", 1, DAY, 1, 1, "France"),
        ("3", "2", "CUP", 1, DAY, 1, 1, "France"),
    )
    assert rows(basket.baskets(lines)) == [("1", ["CUP", "MUG"])]
    assert rows(basket.basket_lines(lines), "InvoiceNo", "Description") == [("1", "CUP"), ("1", "MUG")]


def test_top_products_cut_ties_by_name(make_sales):
    lines = lines_of(make_sales, "AB", "AC", "BC", "AD")
    config = BasketConfig(home_market=None, top_products=2)
    top = basket.top_items(basket.invoice_items(basket.item_lines(lines, config)), config)
    assert rows(top) == [("A", 3), ("B", 2)]
    assert rows(basket.baskets(lines, config)) == [("0", ["A", "B"])]


def test_cancelled_out_quantity_is_absent_but_counts_for_size(make_sales):
    lines = make_sales(
        ("1", "A", "A", 2, DAY, 1, 1, "UK"),
        ("1", "A", "A", -2, DAY, 1, 1, "UK"),
        ("1", "B", "B", 1, DAY, 1, 1, "UK"),
    )
    assert rows(basket.baskets(lines, ALL)) == [("1", ["B"])]


def test_density_and_network(make_sales):
    found = basket.baskets(lines_of(make_sales, "ABC", "AB"), ALL)
    assert rows(basket.basket_density(found)) == [(2, 3, 5, 83.3333)]
    sets = basket.frequent_itemsets(found, ALL)
    pairs = basket.top_pairs(basket.association_rules(sets, ALL))
    edges = basket.network_edges(pairs)
    assert edges.count() == 6
    assert rows(basket.network_nodes(edges)) == [("A", 4), ("B", 4), ("C", 4)]
    assert basket.sample_rules(basket.association_rules(sets, ALL), BasketConfig(sample_rules=2)).count() == 2
