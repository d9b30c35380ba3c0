"""A body that a third of all records share is dealt out over several tasks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from sediment.operators import quality


@contextmanager
def _small_partitions(spark):
    """Sizes at which this test's tables are large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_members_of_a_hot_group_are_split(spark):
    docs = spark.range(0, 30_000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one body").otherwise(F.concat(F.lit("body "), (F.col("id") / 2).cast("long").cast("string"))).alias("text"))
    with _small_partitions(spark):
        members = quality.duplicate_members(docs, "doc_id", F.col("text"))
        rows = members.collect()
        plan = members._jdf.queryExecution().executedPlan().toString()
    texts: dict[str, list[int]] = {}
    for i in range(30_000):
        texts.setdefault("one body" if i % 3 == 0 else f"body {i // 2}", []).append(i)
    assert sorted((r["key"], r["n"], r["first_key"]) for r in rows) == sorted((i, len(g), g[0]) for g in texts.values() if len(g) > 1 for i in g)
    assert "skew=true" in plan
