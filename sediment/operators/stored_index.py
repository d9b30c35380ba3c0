"""A vector index that is kept: points by id, in buckets of the hash of their id.

``root/about`` says what the points are: dimensions, distance, buckets and the caller's facts. ``root/points`` has a folder
a bucket, and ``root/status`` a line for each step of each upsert. An upsert rewrites the buckets that its ids fall into
and no others. What it will write lies in ``root/merged`` before the first old file goes, so a run that ends in the
middle is completed by the next one, and until then the index doesn't open. There is one writer at a time.

Defined results: a null id, an id that comes twice, and a vector that is not one are errors naming the first such id, and
nothing is written; an empty table changes nothing; points replace those of their id, with all their columns.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release
from ..sources.sinks import write_json
from .vectors import vector_fault

#: Buckets of a new index: so many that what comes in at once touches few, and that one is a task's work.
BUCKETS = 64
_STATUS = "step long, done boolean, points long, added long, replaced long"


def _status(spark: SparkSession, root: str):
    """The last line, or None if there is no index. Lines are only ever added."""
    try:
        return spark.read.schema(_STATUS).json(f"{root}/status").orderBy(F.desc("step")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _note(spark: SparkSession, root: str, *line) -> None:
    spark.createDataFrame([line], _STATUS).coalesce(1).write.mode("append").json(f"{root}/status")


def _about(spark: SparkSession, root: str) -> dict | None:
    if _status(spark, root) is None:
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{root}/about").collect()))  # one small document


def _wanted(dimensions: int, distance: str, facts: dict | None) -> dict:
    return json.loads(json.dumps({"dimensions": dimensions, "distance": distance, **(facts or {})}))  # as it would be read back


def _agrees(about: dict, wanted: dict) -> None:
    differ = sorted(k for k in {**about, **wanted} if k != "buckets" and about.get(k) != wanted.get(k))
    if differ:
        raise ValueError(f"the index was made with another {differ[0]}: {about.get(differ[0])}, not {wanted.get(differ[0])}")


def _complete(spark: SparkSession, root: str) -> None:
    """Carry out what the last upsert had begun."""
    last = _status(spark, root)
    if last["done"]:
        return
    merged = spark.read.parquet(f"{root}/merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/points")
    have = spark.read.parquet(f"{root}/points").count()
    if have != last["points"]:
        raise ValueError(f"the index has {have} points, not {last['points']}")
    _note(spark, root, last["step"] + 1, True, *last[2:])


def upsert(points: DataFrame, root: str, dimensions: int, distance: str = "cosine", facts: dict | None = None, buckets: int = BUCKETS, only_new: bool = False) -> dict:
    """Put points (id, vector and any other columns) into the index, which is made if it isn't there; returns how many
    points it has and how many came new or replaced others.

    With ``only_new``, points whose id is there already stay as they are: for ids that name contents, so that a repeated run
    writes nothing. Tables opened before an upsert that replaces points are to be opened anew.
    """
    spark, wanted = points.sparkSession, _wanted(dimensions, distance, facts)
    about = _about(spark, root)
    if about is None:
        write_json(spark, about := wanted | {"buckets": buckets}, f"{root}/about")
        _note(spark, root, 0, True, 0, 0, 0)
    _agrees(about, wanted)
    _complete(spark, root)
    if only_new and _status(spark, root)["points"]:
        points = points.join(spark.read.parquet(f"{root}/points").select("id"), "id", "left_anti")
    coming = materialize(points.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(about["buckets"])).cast("int")), "upserted")
    fault = F.when(F.col("id").isNull(), "null_id").otherwise(vector_fault(F.col("vector"), dimensions))
    twice = coming.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("twice").alias("fault"))
    if bad := coming.select("id", fault.alias("fault")).where("fault is not null").union(twice).head(1):
        raise ValueError(f"point {bad[0]['id']}: {bad[0]['fault']}")
    last, touched = _status(spark, root), [r["bucket"] for r in coming.select("bucket").distinct().collect()]  # at most as many as buckets
    if touched:
        there = spark.read.parquet(f"{root}/points").where(F.col("bucket").isin(touched)) if last["points"] else coming.where("false")
        there.join(coming.select("id"), "id", "left_anti").unionByName(coming).write.mode("overwrite").parquet(f"{root}/merged")
        n, old, rows = coming.count(), there.count(), spark.read.parquet(f"{root}/merged").count()
        _note(spark, root, last["step"] + 1, False, last["points"] + rows - old, rows - old, n - (rows - old))
        _complete(spark, root)
        last = _status(spark, root)
    release(coming)
    return {"points": last["points"], "added": last["added"] if touched else 0, "replaced": last["replaced"] if touched else 0}


def opened(spark: SparkSession, root: str, dimensions: int, distance: str = "cosine", facts: dict | None = None) -> DataFrame:
    """The points, if the index was made with the same dimensions, distance and facts and is complete; else an error."""
    about = _about(spark, root)
    if about is None:
        raise ValueError(f"no index in {root}")
    _agrees(about, _wanted(dimensions, distance, facts))
    last = _status(spark, root)
    if not last["points"]:
        raise ValueError("the index has no points")
    points = spark.read.parquet(f"{root}/points").drop("bucket")
    if not last["done"] or points.count() != last["points"]:
        raise ValueError("the index is not complete")
    return points
