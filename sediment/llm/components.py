"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b (long, no nulls). Returns node and root, the smallest node of its component.

    Each round halves distances at least; every round is written to the shared folder, which cuts the lineage. The least
    neighbours are written, too: so the edges of a hub, which a third of all nodes may touch, are skewed on one side of
    a join only, which Spark splits at run time. Nodes without an edge are not in the result; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, before = materialize(pairs, "components"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v")).distinct()
        before = state
        both = pairs.union(pairs.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "components")
        release(least, pairs)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        release(least, large)
