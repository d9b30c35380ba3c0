"""The whole way from a verified snapshot to a searchable, evaluated corpus."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import SCHEMA_VERSION, ChunkConfig, Embedder, Generator
from ..functions import text as T
from ..operators import chunking, evaluate, normalize, order, quality, stored_index, vectors
from ..sources import readers, sinks


NAMES = ("lessons", "variants", "quarantine", "issues", "comparisons")
#: Products of records are written in the order of their identifiers, variants by section within.
ORDERS = {"lessons": (), "variants": ("section",), "issues": ("seq",), "comparisons": ("section",)}


def run_statistics(made: normalize.Normalized) -> dict:
    """The totals of a run, each an aggregate: records, flags, missing sections, field comparisons, sizes."""
    stats = quality.corpus_statistics(made.lessons, made.variants, made.quarantine).first().asDict()
    stats["input_hits"] = stats["lessons"] + stats["quarantined"]
    stats |= {f"flag {r['flag']}": r["n"] for r in quality.flag_histogram(made.lessons, "quality_flags").collect()}  # a row for each of the fixed flags
    by_section = made.issues.where("code in ('missing_section', 'field_variant', 'legacy_field_fallback')").groupBy("code", "section").count()
    stats |= {f"{r['code']} {r['section']}": r["count"] for r in by_section.collect()}  # sections are fixed, too
    stats |= {f"missing {r['field']}": r["missing"] for r in quality.missing_content(made.lessons).collect()}
    bodies = made.lessons.where("body_sha256 is not null").groupBy("body_sha256").count().where("count > 1")
    stats |= bodies.agg(F.count("*").alias("same_body_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("same_body_records")).first().asDict()
    return stats | {f"fields {r['section']}": {k: v for k, v in r.asDict().items() if k != "section"} for r in quality.field_comparison(made.comparisons).collect()}


def ingest(spark: SparkSession, snapshot: str, output: str, base_url: str, snapshot_sha256: str = "", protected: str | None = None) -> normalize.Normalized:
    """Read hits, normalize them and write the five products, a manifest and a report; returns the products as written.

    ``snapshot`` is a response file, or a snapshot folder, whose layers are verified.
    """
    if protected:
        sinks.guard_outside(output, protected)
    if snapshot.rstrip("/").endswith((".json", ".gz")):
        hits, received = readers.read_hits(spark, snapshot), None
    else:
        manifest, hits = readers.load_snapshot(spark, snapshot)
        received = manifest["response_received_utc"]
        snapshot_sha256 = manifest["files"]["compressed"]["sha256"]
    made = normalize.normalize(hits, base_url, snapshot, snapshot_sha256)
    frames = {name: getattr(made, name) for name in NAMES}
    for name, df in frames.items():
        ordered = order.in_order(df, *order.numeric_order(F.col("lesson_id")), *ORDERS[name]) if name in ORDERS else df
        ordered.write.mode("errorifexists").parquet(f"{output}/{name}")
    made = normalize.Normalized(**{name: spark.read.schema(df.schema).parquet(f"{output}/{name}") for name, df in frames.items()})
    stats = run_statistics(made)
    products = {r["name"]: {"records": r["records"], "content": r["content"]} for r in sinks.products({name: getattr(made, name) for name in NAMES}).collect()}
    if products["lessons"]["records"] + products["quarantine"]["records"] != hits.count():
        raise ValueError("records and quarantine do not make up the hits")
    fields = [r["field"] for r in readers.source_fields(hits).orderBy("field").collect()]  # names of fields
    text = sinks.report(stats | {"source_fields": len(fields)}, received)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{output}/report")
    facts = {"schema_version": SCHEMA_VERSION, "source_snapshot": snapshot, "source_snapshot_sha256": snapshot_sha256, "source_fields": fields, "external_fetches": 0, "statistics": stats, "products": products, "report_sha256": hashlib.sha256(text.encode()).hexdigest()}
    sinks.write_json(spark, facts, f"{output}/manifest")
    return made


def index(lessons: DataFrame, root: str, dataset: str, embedder: Embedder, config: ChunkConfig) -> DataFrame:
    """Plan, write the plan under its identity, embed what is missing, and join the index."""
    spark = lessons.sparkSession
    path = sinks.write_run(chunking.plan_chunks(lessons, dataset, config), root, config.as_dict() | {"dataset": dataset})
    chunks = spark.read.parquet(f"{path}/data")
    chunking.check_plan(chunks, config)
    chunking.plan_manifest(chunks, config, dataset).coalesce(1).write.mode("overwrite").json(f"{path}/plan")
    status = vectors.embed_pending(chunks, embedder, f"{path}/cache")
    sinks.write_json(spark, status, f"{path}/status")
    points = vectors.build_index(chunks, vectors.checked_rounds(spark, f"{path}/cache", chunks, embedder.dimensions), embedder.dimensions)
    facts = {"dataset": dataset, "configuration": config.as_dict()}
    made = stored_index.upsert(points, f"{path}/index", embedder.dimensions, facts=facts, only_new=True)  # a unit's id names its contents
    if made["points"] != status["expected"]:
        raise ValueError("the index has not as many points as there are units")
    return stored_index.opened(spark, f"{path}/index", embedder.dimensions, facts=facts)


def search_stored(spark: SparkSession, root: str, questions: DataFrame, embedder: Embedder, config: ChunkConfig, dataset: str, k: int = 5) -> DataFrame:
    """As ``search``, over a stored index, if it is complete and was made of this data set with this configuration."""
    return search(stored_index.opened(spark, root, embedder.dimensions, facts={"dataset": dataset, "configuration": config.as_dict()}), questions, embedder, config, k)


def search(points: DataFrame, questions: DataFrame, embedder: Embedder, config: ChunkConfig, k: int = 5) -> DataFrame:
    """Ranked parents for questions (query_id, question). Blank questions, those of over 20,000 bytes with the prefix that is
    embedded before them, and a k beyond 1 to 20 are errors."""
    stripped = T.strip(F.col("question"))
    text = F.concat(F.lit(config.query_prefix), stripped)
    if not 1 <= k <= 20 or questions.where(stripped.isNull() | (stripped == "") | (F.octet_length(text) > 20000)).head(1):
        raise ValueError("questions must have text of up to 20,000 bytes, and k lies between 1 and 20")
    if embedder.dimensions != config.dimensions or points.where(F.size("vector") != embedder.dimensions).head(1):
        raise ValueError("index, embedder and configuration differ in their dimensions")
    asked = questions.select(F.col("query_id").cast("string").alias("cache_key"), F.lit("").alias("input_sha256"), text.alias("embedding_input"))
    asked = vectors.embed(asked, embedder).select(F.col("cache_key").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.top_parents(points.withColumn("child", F.xxhash64("id")), asked, k, "lesson_id", "child")


def evaluated(points: DataFrame, cases: DataFrame, embedder: Embedder, config: ChunkConfig, k: int = 5) -> DataFrame:
    """Metrics of cases (query_id, question, expected_ids)."""
    found = search(points, cases, embedder, config, k)
    named = cases.select(F.col("query_id").cast("string").alias("query_id"), "expected_ids")
    return evaluate.metrics(evaluate.first_relevant_rank(found, named, k))


def evaluated_in_steps(points: DataFrame, cases: DataFrame, embedder: Embedder, config: ChunkConfig, path: str, k: int = 5, at_once: int = 1000) -> DataFrame:
    """As ``evaluated``; the ranks of each part of the cases are appended as they are found, and a report says whether all
    are there. Cases that have a rank there already are not asked again."""
    spark = points.sparkSession
    spark.createDataFrame([], "query_id string, first_relevant_rank int").write.mode("append").parquet(f"{path}/ranks")
    named = cases.withColumn("query_id", F.col("query_id").cast("string"))
    parts, written = -(-named.count() // at_once), lambda: spark.read.schema("query_id string, first_relevant_rank int").parquet(f"{path}/ranks")
    for part in range(parts):
        todo = named.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).join(written(), "query_id", "left_anti")
        if todo.head(1):
            evaluate.first_relevant_rank(search(points, todo, embedder, config, k), todo.select("query_id", "expected_ids"), k).write.mode("append").parquet(f"{path}/ranks")
        found = evaluate.metrics(written())
        sinks.write_json(spark, found.first().asDict() | {"complete": part == parts - 1}, f"{path}/report")
    return evaluate.metrics(written())


def answers(points: DataFrame, lessons: DataFrame, questions: DataFrame, embedder: Embedder, generator: Generator, config: ChunkConfig, k: int = 5, version: str = "v2") -> DataFrame:
    """query_id, question, prompt_version, source_ids and answer of a batch of questions, by search, prompts and the generator."""
    found = search(points, questions, embedder, config, k)
    asked = found.join(questions.select(F.col("query_id").cast("string").alias("query_id"), "question"), "query_id")
    prompts = evaluate.prompts(asked, evaluate.contexts(lessons), version)
    return evaluate.generated(prompts, generator).join(asked.select("query_id", "question").distinct(), "query_id")
