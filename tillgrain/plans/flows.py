"""The batch runs from input lines to written results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tillgrain.config import BasketConfig, CleaningConfig, RfmConfig
from tillgrain.operators import basket, cohort, quality, rfm
from tillgrain.operators.cleaning import clean_sales
from tillgrain.operators.features import engineered_sales
from tillgrain.operators.grains import invoice_grain
from tillgrain.operators.itemsets import basket_items, grown_rules, mined_itemsets
from tillgrain.operators.star import Star
from tillgrain.session import Scratch, materialize
from tillgrain.sources.readers import load_lines, load_table
from tillgrain.sources.schemas import BASKET_REQUIRED
from tillgrain.sources.versions import Store
from tillgrain.sources.writers import write_csv, write_parquet


def run_cleaning(
    spark: SparkSession, csv_path: str, out: str, config: CleaningConfig = CleaningConfig()
) -> DataFrame:
    """Raw CSV to cleaned sales lines, stored as Parquet."""
    write_parquet(clean_sales(load_lines(spark, csv_path), config), out)
    return spark.read.parquet(out)


def run_features(spark: SparkSession, sales_path: str, out: str | None = None, **options) -> DataFrame:
    """Cleaned sales to lines with all features; stored where ``out`` is given."""
    features = engineered_sales(load_table(spark, sales_path), **options)
    if out is None:
        return features
    write_parquet(features, out)
    return spark.read.parquet(out)


def run_rfm(
    spark: SparkSession, sales_path: str, out: str, config: RfmConfig = RfmConfig()
) -> dict[str, DataFrame]:
    customers = rfm.rfm_segments(invoice_grain(load_table(spark, sales_path)), config)
    results = {
        "rfm_scores": customers.drop("Action", "Lines"),
        "rfm_segments_summary": rfm.segment_summary(customers),
    }
    return _store(results, out)


def run_cohorts(spark: SparkSession, sales_path: str, out: str) -> dict[str, DataFrame]:
    cells = materialize(cohort.cohort_cells(invoice_grain(load_table(spark, sales_path))))
    results = {
        "cohort_retention_matrix": cohort.retention_matrix(cells),
        "cohort_revenue_matrix": cohort.revenue_matrix(cells),
        "cohort_summary": cohort.cohort_summary(cohort.retention_long(cells)),
    }
    return _store(results, out)


def run_baskets(
    spark: SparkSession, sales_path: str, out: str, config: BasketConfig = BasketConfig()
) -> dict[str, DataFrame]:
    lines = load_table(spark, sales_path, BASKET_REQUIRED)
    if config.max_length <= basket.LONGEST_SUPPORTED:
        itemsets = materialize(basket.frequent_itemsets(basket.baskets(lines, config), config))
        rules = materialize(basket.association_rules(itemsets, config))
    else:  # longer sets by bitmaps, over all products
        scratch = Scratch(spark)
        itemsets = scratch.write(mined_itemsets(basket_items(lines, config), scratch, config, config.max_length))
        rules = scratch.write(grown_rules(itemsets, scratch, config))
    results = {
        "frequent_itemsets": itemsets.select("support", "itemset", "length"),
        "association_rules": basket.by_lift(
            rules.select(
                "antecedents_str",
                "consequents_str",
                "rule_str",
                "support",
                "confidence",
                "lift",
                "strength",
            )
        ),
        "top_product_pairs": basket.top_pairs(rules, config.top_pairs),
    }
    return _store(results, out)


def run_warehouse(
    spark: SparkSession,
    sales_path: str,
    out: str,
    home_market: str = "United Kingdom",
    config: RfmConfig = RfmConfig(),
    verify: bool = True,
) -> tuple[Star, dict[str, DataFrame]]:
    """Sales lines to the stored star schema and its checks."""
    Star.build(load_table(spark, sales_path), home_market, config).write(out)
    star = Star.read(spark, out)
    if not verify:
        return star, {}
    checks = {
        "row_counts": quality.expected_row_counts(quality.row_counts(star)),
        "primary_keys": quality.primary_keys(star),
        "foreign_keys": quality.foreign_keys(star),
        "value_rules": quality.value_rules(star),
        "top_customers": quality.top_spenders(star.dim_customers),
        "segment_revenue": quality.segment_revenue(star.fact_transactions, star.dim_customers),
        "top_countries": quality.top_countries(star.dim_geography),
    }
    return star, checks


def refresh_warehouse(
    spark: SparkSession,
    sales_path: str,
    out: str,
    months: Sequence[tuple[int, int]] | None = None,
    home_market: str = "United Kingdom",
    config: RfmConfig = RfmConfig(),
) -> Star:
    """Sales lines to a new version of the star in a versioned store.

    Only the touched ``months`` of the fact are written (None: all of them); dimensions hold
    figures of all sales and are written whole. Readers switch to the new version at its end.
    """
    store = Store(spark, out)
    version = Star.build(load_table(spark, sales_path), home_market, config).refresh(store, months)
    return Star.at(store, version)


def _store(results: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    for name, frame in results.items():
        write_csv(frame, f"{out}/{name}")
    return results
