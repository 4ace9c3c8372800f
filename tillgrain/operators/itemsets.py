"""Frequent itemsets of any length and the rules of long sets.

Baskets are numbered densely and every frequent product becomes a column of bitmaps, one per
bucket of baskets. The baskets of a set are the AND of the bitmaps of two of its parts, its count
is the number of bits, so a basket with very many products costs as many bits and never the
subsets it has. Sets grow depth first by groups of first products: all sets that begin with a
group's products are finished, and their bitmaps dropped, before the next group starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.config import BasketConfig
from tillgrain.functions.numeric import ratio
from tillgrain.operators.basket import described_rules, invoice_items, item_lines
from tillgrain.operators.distincts import BITS, numbered
from tillgrain.session import Scratch

GROUP_PAIRS = 50_000
"""Pairs of products whose bitmaps are held at a time."""

_SETS = "itemset array<int>, n bigint"


def basket_items(lines: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Products of invoices with at least two, as rows; without a bound on products or baskets.

    A product whose quantities cancel out counts as absent, but still for the size test.
    """
    pairs = invoice_items(item_lines(lines, config))
    several = pairs.groupBy("InvoiceNo").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= 2)
    return pairs.filter(F.col("Quantity") != 0).join(several, "InvoiceNo", "left_semi").select("InvoiceNo", "Item")


def _groups(products: int, most_pairs: int) -> list[tuple[int, int]]:
    """Ranges of first products, last ones first, each with a bounded number of pairs."""
    ranges, high, pairs = [], products, 0
    for first in range(products, 0, -1):
        following = products - first
        if pairs and pairs + following > most_pairs:
            ranges.append((first + 1, high))
            high, pairs = first, 0
        pairs += following
    return [*ranges, (1, high)] if products else []


def _intersected(candidates: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """itemset, _bucket, bits of candidates (itemset, left, right): the AND of two parts."""
    parts = candidates.select("itemset", F.explode(F.array("left", "right")).alias("part"))
    held = bitmaps.select(F.col("itemset").alias("part"), "_bucket", "bits")
    both = parts.join(held, "part").groupBy("itemset", "_bucket")
    # a bucket that only one part has is empty
    merged = both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_parts"))
    return merged.filter((F.col("_parts") == 2) & (F.bitmap_count("bits") > 0)).drop("_parts")


def _frequent(bitmaps: DataFrame, enough: int) -> DataFrame:
    return bitmaps.groupBy("itemset").agg(F.sum(F.bitmap_count("bits")).alias("n")).filter(F.col("n") >= enough)


def _longer(frequent: DataFrame, length: int) -> DataFrame:
    """Candidates of ``length`` products from frequent sets that differ in the last one."""
    start = F.slice("itemset", 1, length - 2).alias("_start")
    last = F.element_at("itemset", -1)
    left = frequent.select(start, F.col("itemset").alias("left"), last.alias("_x"))
    right = frequent.select(start, F.col("itemset").alias("right"), last.alias("_y"))
    joined = left.join(right, "_start").filter(F.col("_x") < F.col("_y"))
    return joined.select(F.concat("left", F.array("_y")).alias("itemset"), "left", "right")


def _pruned(candidates: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """Candidates whose other subsets, too, are known to be frequent.

    Sets that begin with later products are known by now, as groups run from the last.
    """
    others = F.transform(
        F.sequence(F.lit(1), F.lit(length - 2)),
        lambda i: F.concat(F.slice("itemset", F.lit(1), i - 1), F.slice("itemset", i + 1, F.lit(length))),
    )
    subsets = candidates.select("itemset", "left", "right", F.explode(others).alias("_subset"))
    found = subsets.join(known.select(F.col("itemset").alias("_subset")), "_subset")
    counted = found.groupBy("itemset", "left", "right").agg(F.count(F.lit(1)).alias("_found"))
    return counted.filter(F.col("_found") == length - 2).drop("_found")


def mined_itemsets(
    items: DataFrame, scratch: Scratch, config: BasketConfig = BasketConfig(), max_length: int | None = None,
    most_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """Itemsets found in at least ``ceil(min_support * baskets)`` baskets, of any length.

    ``items`` has a row (InvoiceNo, Item) per basket and product; ``max_length`` None means no
    limit. Returns ``itemset`` (sorted array), ``length``, ``n`` and ``support`` like
    ``frequent_itemsets``. There are at most mean basket size / ``min_support`` frequent products,
    which bounds the list that turns numbers back into names.
    """
    items = scratch.write(items.select("InvoiceNo", "Item").distinct())
    baskets = scratch.write(items.select("InvoiceNo").distinct())
    total = baskets.count()
    enough = max(1, int(scratch.spark.range(1).select(F.ceil(F.lit(config.min_support) * F.lit(total).cast("double"))).first()[0]))
    singles = items.groupBy("Item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough)
    order = Window.partitionBy().orderBy("Item")  # frequent products only
    products = scratch.write(singles.withColumn("code", F.row_number().over(order)))
    many = products.count()
    vertical = scratch.write(
        items.join(products.select("Item", "code"), "Item")
        .join(numbered(baskets, "InvoiceNo", total, BITS), "InvoiceNo")
        .groupBy(F.array("code").alias("itemset"), "_bucket")
        .agg(F.bitmap_construct_agg("_position").alias("bits"))
    )
    scratch.drop(items, baskets)
    folder = scratch.folder()
    products.select(F.array("code").alias("itemset"), "n").write.parquet(f"{folder}/length=1")
    for low, high in _groups(many, most_pairs) if max_length != 1 else []:
        firsts = products.select("code").filter(F.col("code").between(low, high) & (F.col("code") < many))
        pairs = firsts.select(F.array("code").alias("left"), F.explode(F.sequence(F.col("code") + 1, F.lit(many))).alias("_y"))
        candidates = pairs.select(F.concat("left", F.array("_y")).alias("itemset"), "left", F.array("_y").alias("right"))
        bitmaps, length = vertical, 2
        while True:
            grown = scratch.write(_intersected(candidates, bitmaps))
            frequent = scratch.write(_frequent(grown, enough))
            frequent.write.mode("append").parquet(f"{folder}/length={length}")
            if bitmaps is not vertical:
                scratch.drop(bitmaps)
            bitmaps = scratch.write(grown.join(frequent.select("itemset"), "itemset", "left_semi"))
            scratch.drop(grown)
            length += 1
            done = length == (max_length or 0) + 1 or frequent.isEmpty()
            if not done:
                known = scratch.spark.read.schema(_SETS).parquet(f"{folder}/length={length - 1}")
                candidates = scratch.write(_pruned(_longer(frequent, length), known, length))
                done = candidates.isEmpty()
            if done:
                scratch.drop(bitmaps)
                break
    found = scratch.spark.read.schema(_SETS).parquet(f"{folder}/length=*")
    names = products.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "Item"))), lambda x: x["Item"])).scalar()
    spelled = found.withColumn("_names", names).withColumn("itemset", F.expr("transform(itemset, x -> element_at(_names, x))"))
    return spelled.select("itemset", F.size("itemset").alias("length"), "n", ratio(F.col("n"), F.lit(total)).alias("support"))


def grown_rules(itemsets: DataFrame, scratch: Scratch, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Association rules of sets of any length, consequents grown product by product.

    A rule's confidence only falls when products move from the antecedent to the consequent, so
    consequents that miss ``min_confidence`` are not grown. Equal to ``association_rules``, which
    tries all splits; ``itemsets`` should be a written table.
    """
    supports = itemsets.select("itemset", "support")

    def measured(candidates: DataFrame) -> DataFrame:
        parts = candidates.withColumn("antecedents", F.array_except("itemset", "consequents"))
        given = supports.select(F.col("itemset").alias("antecedents"), F.col("support").alias("_antecedents_support"))
        rules = parts.join(given, "antecedents").withColumn("confidence", F.col("support") / F.col("_antecedents_support"))
        return scratch.write(rules.filter(F.col("confidence") >= config.min_confidence))

    whole = itemsets.filter(F.col("length") >= 2).select("itemset", "support")
    level = measured(whole.withColumn("consequents", F.transform("itemset", lambda x: F.array(x))).withColumn("consequents", F.explode("consequents")))
    levels, size = [level], 1
    while not level.isEmpty():
        open_ = level.filter(F.size("itemset") > size + 1)
        start = F.slice("consequents", 1, size - 1) if size > 1 else F.array().cast("array<string>")
        last = F.element_at("consequents", -1)
        left = open_.select("itemset", "support", start.alias("_start"), "consequents", last.alias("_x"))
        right = open_.select("itemset", start.alias("_start"), last.alias("_y"))
        longer = left.join(right, ["itemset", "_start"]).filter(F.col("_x") < F.col("_y"))
        level = measured(longer.select("itemset", "support", F.concat("consequents", F.array("_y")).alias("consequents")))
        levels.append(level)
        size += 1
    rules = levels[0]
    for level in levels[1:]:
        rules = rules.unionByName(level)
    wanted = supports.select(F.col("itemset").alias("consequents"), F.col("support").alias("_consequents_support"))
    return described_rules(rules.drop("itemset").join(wanted, "consequents"), config)
