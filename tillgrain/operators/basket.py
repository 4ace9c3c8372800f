"""Market baskets: frequent itemsets, association rules and top pairs.

Itemsets are found level by level up to a fixed length. Equal baskets are merged into one
weighted row first, so copies cost nothing, and every level is counted with map-side
combination straight from the basket arrays: what is shuffled is one row per candidate and
task. The length limit keeps the search polynomial; pattern growth without it lists every
subset of a basket that a large share of invoices repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.config import RULE_STRENGTH, BasketConfig
from tillgrain.functions.banding import at_least, shorten
from tillgrain.functions.numeric import ratio, rounded
from tillgrain.session import materialize

LONGEST_SUPPORTED = 3


def item_lines(lines: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Home-market lines with a product text, trimmed and in upper case."""
    if config.home_market is not None and "Country" in lines.columns:
        lines = lines.filter(F.col("Country") == config.home_market)
    return lines.dropna(subset=["Description"]).withColumn(
        "Description", F.upper(F.trim("Description"))
    )


def invoice_items(items: DataFrame) -> DataFrame:
    """Distinct products per invoice with their summed quantity."""
    return items.groupBy("InvoiceNo", F.col("Description").alias("Item")).agg(
        F.sum(F.col("Quantity").cast("bigint")).alias("Quantity")
    )


def top_items(pairs: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The products found on most invoices; ties at the cut go by name."""
    return (
        pairs.groupBy("Item")
        .agg(F.count(F.lit(1)).alias("Invoices"))
        .orderBy(F.desc("Invoices"), "Item")
        .limit(config.top_products)
    )


def basket_pairs(items: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Invoice and product of the top products; the broadcast list has ``top_products`` rows.

    Products are counted first, and only the pairs of the top ones are kept and stored.
    """
    top = materialize(top_items(invoice_items(items), config).select("Item"))
    kept = items.join(F.broadcast(top.withColumnRenamed("Item", "Description")), "Description", "left_semi")
    return materialize(invoice_items(kept))


def _multi_item(pairs: DataFrame) -> DataFrame:
    """Invoices with at least two products. An array holds at most the top products.

    A product whose quantities cancel out counts as absent, but still for the size test.
    """
    present = F.when(F.col("Quantity") != 0, F.col("Item"))
    return (
        pairs.groupBy("InvoiceNo")
        .agg(F.count(F.lit(1)).alias("_size"), F.array_sort(F.collect_set(present)).alias("Items"))
        .filter(F.col("_size") >= 2)
        .drop("_size")
    )


def baskets(lines: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """One sorted product array per invoice with two or more top products."""
    return _multi_item(basket_pairs(item_lines(lines, config), config))


def basket_lines(lines: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The lines behind the baskets; they are read once to find the products, once to keep theirs."""
    items = materialize(item_lines(lines, config))
    top = top_items(invoice_items(items), config).select(F.col("Item").alias("Description"))
    kept = materialize(items.join(F.broadcast(top), "Description", "left_semi"))
    several = materialize(
        kept.groupBy("InvoiceNo")
        .agg(F.countDistinct("Description").alias("_size"))
        .filter(F.col("_size") >= 2)
        .select("InvoiceNo")
    )
    return kept.join(several, "InvoiceNo", "left_semi")


def basket_density(baskets: DataFrame) -> DataFrame:
    """Share of filled cells in the invoice-by-product matrix."""
    merged = baskets.groupBy("Items").agg(F.count(F.lit(1)).alias("_copies"))
    cells = merged.agg(
        F.sum("_copies").alias("Baskets"), F.sum(F.size("Items") * F.col("_copies")).alias("Filled")
    )
    products = merged.select(F.explode("Items").alias("Item")).agg(
        F.countDistinct("Item").alias("Products")
    )
    filled, size = F.col("Filled"), F.col("Baskets") * F.col("Products")
    return (
        cells.withColumn("Products", products.scalar())
        .select("Baskets", "Products", "Filled", rounded(ratio(filled * 100, size), 4).alias("Density_%"))
    )


def frequent_itemsets(baskets: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Itemsets of up to ``max_length`` products found in enough baskets.

    Returns ``itemset`` (sorted array), ``length``, ``n`` (baskets) and ``support``. An itemset
    is frequent from ``ceil(min_support * baskets)`` on. The list of frequent products that codes
    the baskets has at most ``top_products`` entries for baskets built here, and never more than
    the mean basket size divided by ``min_support``.
    """
    if not 1 <= config.max_length <= LONGEST_SUPPORTED:
        raise ValueError(f"max_length must be between 1 and {LONGEST_SUPPORTED}")
    merged = materialize(baskets.groupBy("Items").agg(F.count(F.lit(1)).alias("_copies")))
    total = merged.agg(F.sum("_copies")).scalar()
    enough = F.ceil(F.lit(config.min_support) * total.cast("double"))

    def counted(candidates: DataFrame, *members: str) -> DataFrame:
        return (
            candidates.groupBy(*members)
            .agg(F.sum("_copies").alias("n"))
            .filter(F.col("n") >= enough)
        )

    singles = counted(merged.select(F.explode("Items").alias("a"), "_copies"), "a")
    levels = [singles.select(F.array("a").alias("itemset"), "n")]
    if config.max_length >= 2:
        # names become positions in the sorted list of frequent products: short keys from here
        names = materialize(singles.agg(F.array_sort(F.collect_list("a")).alias("names")))
        names = names.select("names").scalar()
        coded = materialize(
            merged.select(
                F.array_intersect("Items", names).alias("Items"), names.alias("_names"), "_copies"
            )
            .filter(F.size("Items") >= 2)
            .select(
                F.transform("Items", lambda x: F.array_position("_names", x).cast("int")).alias("Items"),
                "_copies",
            )
            .groupBy("Items")
            .agg(F.sum("_copies").alias("_copies"))
        )
        pairs = materialize(counted(_extended(_started(coded), "a", "b").drop("_rest"), "a", "b"))
        levels.append(_spelled(pairs, names, "a", "b"))
    if config.max_length >= 3:
        # each side is as small as the frequent pairs really are; Spark broadcasts by size
        ab, ac, bc = (pairs.select(*pair) for pair in _pair_columns(pairs))
        triples = (
            _extended(_started(coded), "a", "b")
            .join(ab, ["a", "b"], "left_semi")
            .transform(_extended, "b", "c")
            .drop("_rest")
            .join(ac, ["a", "c"], "left_semi")
            .join(bc, ["b", "c"], "left_semi")
        )
        levels.append(_spelled(counted(triples, "a", "b", "c"), names, "a", "b", "c"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select(
        "itemset", F.size("itemset").alias("length"), "n", ratio(F.col("n"), total).alias("support")
    )


def _pair_columns(pairs: DataFrame):
    a, b = F.col("a"), F.col("b")
    return ((a, b), (a, b.alias("c")), (a.alias("b"), b.alias("c")))


def _started(coded: DataFrame) -> DataFrame:
    """First members of candidate sets, each with the items that may follow."""
    return coded.select("_copies", "Items", F.posexplode("Items").alias("_at", "a")).select(
        "_copies", "a", F.expr("slice(Items, _at + 2, size(Items))").alias("_rest")
    )


def _extended(candidates: DataFrame, last: str, member: str) -> DataFrame:
    """Candidates grown by one of the items that may follow."""
    kept = [c for c in candidates.columns if c != "_rest"]
    return candidates.select(*kept, "_rest", F.posexplode("_rest").alias("_at", member)).select(
        *kept, member, F.expr("slice(_rest, _at + 2, size(_rest))").alias("_rest")
    )


def _spelled(found: DataFrame, names: Column, *members: str) -> DataFrame:
    """Positions back to names."""
    return found.withColumn("_names", names).select(
        F.array(*[F.element_at("_names", F.col(m)) for m in members]).alias("itemset"), "n"
    )


def association_rules(itemsets: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """All splits of every frequent itemset into antecedent and consequent.

    ``itemsets`` is read three times (sets and both sides); hand in a materialized table.
    """
    sets = itemsets.filter(F.col("length") >= 2)
    masks = F.expr("sequence(1, cast(shiftleft(1, length) - 2 as int))")
    splits = sets.withColumn("_mask", F.explode(masks))

    def side(wanted: int) -> Column:
        chosen = F.expr(f"filter(itemset, (x, i) -> (shiftright(_mask, i) & 1) = {wanted})")
        return chosen

    def supports(prefix: str) -> DataFrame:
        return itemsets.select(
            F.col("itemset").alias(prefix), F.col("support").alias(f"_{prefix}_support")
        )

    confidence = F.col("support") / F.col("_antecedents_support")
    measured = (
        splits.select(side(1).alias("antecedents"), side(0).alias("consequents"), "support")
        .join(supports("antecedents"), "antecedents")
        .join(supports("consequents"), "consequents")
        .withColumn("confidence", confidence)
        .filter(F.col("confidence") >= config.min_confidence)
    )
    return described_rules(measured, config)


def described_rules(measured: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """Rules with all their measures, from both sides, their supports and the confidence."""
    sup, sup_a, sup_c = F.col("support"), F.col("_antecedents_support"), F.col("_consequents_support")
    measured = measured.withColumn("lift", F.col("confidence") / sup_c).filter(F.col("lift") >= config.min_lift)
    certain = F.col("confidence") >= 1
    conviction = F.when(certain, F.lit(float("inf"))).otherwise(
        F.try_divide(1 - sup_c, 1 - F.col("confidence"))
    )
    left = F.array_join("antecedents", ", ")
    right = F.array_join("consequents", ", ")
    return measured.select(
        "antecedents",
        "consequents",
        left.alias("antecedents_str"),
        right.alias("consequents_str"),
        F.concat(left, F.lit("  →  "), right).alias("rule_str"),
        rounded(sup, 4).alias("support"),
        rounded(F.col("confidence"), 4).alias("confidence"),
        rounded(F.col("lift"), 4).alias("lift"),
        rounded(sup - sup_a * sup_c, 4).alias("leverage"),
        F.when(certain, conviction).otherwise(rounded(conviction, 4)).alias("conviction"),
        at_least(F.col("lift"), RULE_STRENGTH).alias("strength"),
    )


def by_lift(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedents_str", "consequents_str")


def rule_strength_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("strength").agg(F.count(F.lit(1)).alias("rules"))


def top_pairs(rules: DataFrame, n: int = BasketConfig.top_pairs) -> DataFrame:
    """Rules from one product to one product, highest lift first."""
    return (
        by_lift(rules.filter((F.size("antecedents") == 1) & (F.size("consequents") == 1)))
        .limit(n)
        .select(
            "antecedents_str", "consequents_str", "rule_str", "support", "confidence", "lift", "strength"
        )
    )


def sample_rules(rules: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """At most ``sample_rules`` rules in the order of a seeded hash (a sampling operator)."""
    order = F.md5(F.concat(F.lit(f"{config.sample_seed}:"), F.col("rule_str")))
    return (
        rules.orderBy(order, "rule_str")
        .limit(config.sample_rules)
        .select("rule_str", "support", "confidence", "lift")
    )


def network_edges(pairs: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The strongest pairs as edges with shortened names and a line width."""
    top = pairs.orderBy(F.desc("lift"), "antecedents_str", "consequents_str").limit(config.network_pairs)
    return top.select(
        shorten(F.col("antecedents_str"), 20).alias("source"),
        shorten(F.col("consequents_str"), 20).alias("target"),
        F.greatest(F.lit(1.0), F.col("confidence") * 6).alias("weight"),
        "strength",
    )


def network_nodes(edges: DataFrame) -> DataFrame:
    """Products of the network with the number of edges that touch them."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def pair_bars(pairs: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The strongest pairs with a rule text short enough for a chart axis."""
    top = pairs.orderBy(F.desc("lift"), "antecedents_str", "consequents_str").limit(config.chart_pairs)
    return top.select(shorten(F.col("rule_str"), 35).alias("rule_short"), "lift", "strength")
