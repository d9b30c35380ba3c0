"""Positions in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Add the 0-based place in ``order``: range partitions, places inside them, and one offset for each partition.

    The places inside are written before they are counted, so that rows with equal keys keep theirs if a task runs again.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside), "positions")
    offsets, total = [], 0
    for row in ranged.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        offsets.append((row["_part"], total))
        total += row["count"]
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    return ranged.join(small, "_part").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in ``order``: range partitions, sorted inside, so that files written from them follow each other.

    Where equal keys meet, their rows stay in one partition, in any order.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def batches(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """Add the batch of ``size`` rows that each row falls into."""
    return with_position(df, *order).withColumn("batch", F.floor(F.col("position") / size).cast("long"))


LEAF_ROWS, FAN = 4096, 256


def merkle_tree(df: DataFrame, value: Column, *order: Column | str, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """level, node, hash and rows of a hash tree over ``value`` in ``order``; the highest level is one node, the fingerprint.

    A leaf hashes ``leaf_rows`` values by their places, a node above it ``fan`` nodes, so the tree depends on values and
    order only, not on partitions, and no task holds more than one node's children. Values must not hold line ends; null
    ones count as empty. No rows are one empty leaf.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.select(F.coalesce(value.cast("string"), F.lit("")).alias("value"), *(c.alias(f"_o{i}") for i, c in enumerate(columns)))
    placed = with_position(named, *(f"_o{i}" for i in range(len(columns))), "value").select("value", "position")
    rows = placed.count()

    def joined(key: Column, item: str, place: str, below: DataFrame, count: Column) -> DataFrame:
        inside = F.transform(F.array_sort(F.collect_list(F.struct(place, item))), lambda x: x[item])
        return below.groupBy(key.alias("node")).agg(F.sha2(F.array_join(inside, "\n"), 256).alias("hash"), count.alias("rows"))

    level = materialize(joined(F.floor(F.col("position") / leaf_rows).cast("long"), "value", "position", placed, F.count("*")), "merkle")
    if not rows:
        level = df.sparkSession.range(1).select(F.col("id").alias("node"), F.sha2(F.lit(""), 256).alias("hash"), F.lit(0).cast("long").alias("rows"))
    tree, height, nodes = level.select(F.lit(0).alias("level"), "node", "hash", "rows"), 0, -(-rows // leaf_rows)
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // fan)
        level = joined(F.floor(F.col("node") / fan).cast("long"), "hash", "node", level, F.sum("rows"))
        tree = tree.union(level.select(F.lit(height).alias("level"), "node", "hash", "rows"))
    return materialize(tree, "merkle")


def fingerprint(tree: DataFrame) -> str:
    return tree.orderBy(F.desc("level")).first()["hash"]


def first_difference(a: DataFrame, b: DataFrame, fan: int = FAN) -> int | None:
    """The first leaf at which two hash trees differ, found from the root down; null if they are equal.

    Each step reads the children of one node of either tree. A tree that lacks a level or node differs there.
    """
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    if tops[0] != tops[1]:
        both = [t.where("level = 0").select("node", "hash") for t in (a, b)]
        return both[0].join(both[1].withColumnRenamed("hash", "other"), "node", "full").where("not (hash <=> other)").agg(F.min("node")).first()[0]
    node, span = 0, 1
    for level in range(tops[0], -1, -1):
        inside = [t.where((F.col("level") == level) & F.col("node").between(node * span, node * span + span - 1)).select("node", "hash") for t in (a, b)]
        node, span = inside[0].join(inside[1].withColumnRenamed("hash", "other"), "node", "full").where("not (hash <=> other)").agg(F.min("node")).first()[0], fan
        if node is None:
            return None
    return node


def numeric_order(identifier: Column) -> list[Column]:
    """Order of decimal identifiers of any length: without leading zeros, by length, then digits, then as written."""
    bare = F.regexp_replace(identifier, "^0+(?=.)", "")
    return [F.length(bare), bare, identifier]
