"""Verified readers: raw snapshots, normalized records and evaluation cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.order import with_position
from .split_json import read_array

_RESPONSE = "timed_out boolean, _shards struct<total:long,successful:long,failed:long>, hits struct<total:variant,hits:array<variant>>"


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file, from the stored bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def files_in_order(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """position, path and bytes of the files below a folder, by path; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    return with_position(found, "path")


def verify_file(spark: SparkSession, path: str, n_bytes: int, sha256: str) -> None:
    found = file_facts(spark, path).first()
    if found is None or (found["bytes"], found["sha256"]) != (n_bytes, sha256):
        raise ValueError(f"checksum or size mismatch: {path}")


def verify_layers(spark: SparkSession, path: str, packed: tuple[int, str], plain: tuple[int, str]) -> None:
    """Check size and SHA-256 of a compressed file as stored and of the text within, which Spark unpacks."""
    verify_file(spark, path, *packed)
    text = F.col("value").cast("binary")
    found = spark.read.text(path, wholetext=True).select(F.octet_length(text).cast("long"), F.sha2(text, 256)).first()
    if found is None or tuple(found) != plain:
        raise ValueError(f"checksum or size mismatch of the unpacked text: {path}")


def exact_total(response: DataFrame) -> int:
    """The response's hit count, if it is complete and exact."""
    kind = F.schema_of_variant("hits.total")
    row = response.select(
        F.coalesce("timed_out", F.lit(False)).alias("late"),
        F.coalesce("_shards.failed", F.lit(0)).alias("failed"),
        F.when(kind.startswith("OBJECT"), F.try_variant_get("hits.total", "$.relation", "string")).otherwise("eq").alias("relation"),
        F.when(kind.startswith("OBJECT"), F.try_variant_get("hits.total", "$.value", "bigint")).otherwise(F.try_variant_get("hits.total", "$", "bigint")).alias("total"),
    ).first()
    if row is None or row["late"] or row["failed"] or row["relation"] != "eq" or not row["total"] or row["total"] < 0:
        raise ValueError("the search response is not complete and exact")
    return row["total"]


def read_hits(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """idx, raw_hit, doc_id and source (VARIANT, so that absent, null and types survive) of a search response in JSON.

    A response is one JSON value; tasks read its byte ranges (``split_json``), a compressed one in one task.
    """
    rest, objects = read_array(spark, path)
    response = spark.createDataFrame([(rest,)], "value string").select(F.from_json("value", _RESPONSE).alias("r")).select("r.*")
    total = exact_total(response)
    if response.select(F.size("hits.hits")).first()[0]:
        raise ValueError("a hit is no object")
    hits = objects.select("idx", F.parse_json("json").alias("raw_hit"))
    hits = hits.select("idx", "raw_hit", F.try_variant_get("raw_hit", "$._id", "string").alias("doc_id"), F.try_variant_get("raw_hit", "$._source", "variant").alias("source"))
    kind = F.schema_of_variant("source")
    count, distinct, hollow = hits.agg(F.count("*"), F.count_distinct(F.coalesce("doc_id", F.lit(""))), F.count_if(F.coalesce(~kind.startswith("OBJECT<") | (kind == "OBJECT<>"), F.lit(True)))).first()
    if count != total or distinct != count or hollow or (expected is not None and expected != count):
        raise ValueError("hit count, expected count, unique ids or sources do not agree")
    return hits


def source_fields(hits: DataFrame) -> DataFrame:
    """field: the different field names of all sources."""
    return hits.select(F.explode(F.map_keys(F.try_variant_get("source", "$", "map<string,variant>"))).alias("field")).distinct()


_LAYER = "struct<path:string,bytes:long,sha256:string>"


def load_snapshot(spark: SparkSession, folder: str) -> tuple[Row, DataFrame]:
    """The manifest of a snapshot folder and its hits, if sizes, checksums, counts and ids agree in every layer."""
    schema = f"record_count long, response_received_utc string, files struct<compressed:{_LAYER},uncompressed:{_LAYER}>"
    manifest = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/manifest.json").first()
    if manifest is None or manifest["files"] is None or manifest["record_count"] is None:
        raise ValueError(f"{folder} has no complete manifest")
    packed, plain = manifest["files"]["compressed"], manifest["files"]["uncompressed"]
    path = f"{folder}/{packed['path']}"
    verify_layers(spark, path, (packed["bytes"], packed["sha256"]), (plain["bytes"], plain["sha256"]))
    return manifest, read_hits(spark, path, manifest["record_count"])


def consistent(count: Callable[[], int], read: Callable[[int], str], most: int = 10_000) -> tuple[str, int]:
    """The text of a response and its record count, if the source counts the same before and after it is read.

    ``count`` and ``read`` are the deployment's client of the source; ``read`` gets the number of records to ask for.
    """
    before = count()
    if not 0 < before <= most:
        raise ValueError(f"{before} records can't be read at once")
    text = read(before)
    if count() != before:
        raise ValueError("the source changed while it was read")
    return text, before


def read_records(spark: SparkSession, path: str, schema, records: int | None = None, stored: tuple[int, str] | None = None) -> DataFrame:
    """Normalized records from JSON lines (gzip too); ids unique, one snapshot only, and the file as ``stored`` (bytes,
    SHA-256) if that is given. Gzip files do not split: dealt out anew."""
    if stored:
        verify_file(spark, path, *stored)
    rows = spark.read.schema(schema).json(path).repartition("lesson_id")
    count, distinct, snapshots = rows.agg(F.count("*"), F.count_distinct("lesson_id"), F.count_distinct("source.snapshot_sha256")).first()
    if count != distinct or snapshots > 1 or (records is not None and records != count):
        raise ValueError("record count, unique ids or snapshot do not agree")
    return rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: question, expected_ids, source_note."""
    cases = spark.read.schema("question string, expected_lesson_ids array<string>, source_note string").option("multiLine", True).json(path)
    return cases.withColumnRenamed("expected_lesson_ids", "expected_ids")


def checked_cases(cases: DataFrame, lessons: DataFrame) -> DataFrame:
    """The cases, if all records that they expect are there."""
    unknown = cases.select(F.explode("expected_ids").alias("lesson_id")).join(lessons.select("lesson_id"), "lesson_id", "left_anti").head(1)
    if unknown:
        raise ValueError(f"a case expects the unknown record {unknown[0]['lesson_id']}")
    return cases
