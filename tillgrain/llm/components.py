"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrain.session import Scratch


def components(links: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links``.

    Labels only fall. A round gives each node the smallest label among its neighbours (combined
    on the map side, so a node with very many links costs no task more) and then that label's own
    label, which about halves the distance to the smallest node. Rounds end when the sum of labels
    stays; every round is stored, so a lost executor repeats one round at most.
    """
    both = scratch.write(
        links.select(F.col(left).alias("node"), F.col(right).alias("other"))
        .unionByName(links.select(F.col(right).alias("node"), F.col(left).alias("other")))
        .distinct()
    )
    labels = scratch.write(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component"))
    )
    state = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    while True:
        named = labels.select(F.col("node").alias("other"), F.col("component").alias("label"))
        offered = both.join(named, "other").groupBy("node").agg(F.min("label").alias("label"))
        nearer = labels.join(offered, "node").select("node", F.least("component", "label").alias("component"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("label"))
        following = scratch.write(
            nearer.join(above, "component", "left").select(
                "node", F.coalesce(F.least("component", "label"), F.col("component")).alias("component")
            )
        )
        scratch.drop(labels)
        labels = following
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == state:
            scratch.drop(both)
            return labels
        state = now
