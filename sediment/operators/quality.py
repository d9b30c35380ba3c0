"""Corpus-level quality: duplicate bodies, flags, missing fields, field comparison, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import NOT_CORE, SECTIONS
from ..functions import text as T
from ..scratch import materialize


def duplicate_groups(df: DataFrame, key: str, body: Column) -> DataFrame:
    """body_sha256, n and the smallest key of bodies that several rows share. The members stay rows: see ``duplicate_members``."""
    named = df.where(body.isNotNull()).select(F.sha2(body, 256).alias("body_sha256"), F.col(key).alias("key"))
    return named.groupBy("body_sha256").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")


def duplicate_members(df: DataFrame, key: str, body: Column) -> DataFrame:
    """key, body_sha256, n, first_key: one row a member, however large the group.

    The groups are written first: Spark splits a group with very many members only where the join's sides are read as they are.
    """
    groups = materialize(duplicate_groups(df, key, body), "duplicate-groups")
    return df.select(F.col(key).alias("key"), F.sha2(body, 256).alias("body_sha256")).join(groups, "body_sha256")


def flag_histogram(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(flags)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, missing: rows where the field has no meaningful text; one pass over the data."""
    counted = df.agg(*(F.count_if(~T.meaningful(c)).alias(n) for n, c in fields.items()))
    return counted.unpivot([], list(fields), "field", "missing")


def compare_aliases(current: Column, legacy: Column) -> Column:
    """How two spellings of one field compare, as text."""
    full = lambda c: T.meaningful(c)
    same = F.when(full(current), T.tidy(current)).eqNullSafe(F.when(full(legacy), T.tidy(legacy)))
    both = current.isNotNull() & legacy.isNotNull()
    return F.when(~both, "one_or_no_field_present").when(same, "equivalent_after_rendering").when(full(current) & full(legacy), "different_nonempty_variants").otherwise("one_variant_empty")


RELATIONS = ("equivalent_after_rendering", "different_nonempty_variants", "one_variant_empty", "one_or_no_field_present")


def field_comparison(comparisons: DataFrame) -> DataFrame:
    """section, records, both_fields_present and a count of each outcome of comparing a section's two fields."""
    outcomes = [F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS]
    return comparisons.groupBy("section").agg(F.count("*").alias("records"), F.count_if("both_fields_present").alias("both_fields_present"), *outcomes)


def missing_content(lessons: DataFrame) -> DataFrame:
    """field, missing: records whose title has no text, or whose section has no text, table or media."""
    def hollow(s: str) -> Column:
        r = F.col(f"sections.{s}")
        return ~F.coalesce((F.length(r["text"]) > 0) | (F.size(r["tables"]) > 0) | (F.size(r["media"]) > 0), F.lit(False))

    counted = lessons.agg(F.count_if(F.col("title.text").isNull()).alias("title"), *(F.count_if(hollow(s)).alias(s) for s in SECTIONS))
    return counted.unpivot([], ["title", *SECTIONS], "field", "missing")


def word_statistics(df: DataFrame, words: Column, *by: str, long: int = 1500) -> DataFrame:
    w = df.select(*by, words.cast("long").alias("w"))
    return w.groupBy(*by).agg(F.sum("w").alias("total"), F.median("w").alias("median"), F.max("w").alias("maximum"), F.count_if(F.col("w") > long).alias("over"))


def record_words() -> Column:
    """Words of a normalized record: title and core sections."""
    total = T.word_count(F.col("title.text"))
    for s in SECTIONS:
        if s != NOT_CORE:
            total = total + T.word_count(F.col(f"sections.{s}.text"))
    return total


def key_counts(df: DataFrame, json_text: str) -> DataFrame:
    """key, n: how many rows have each top-level key of a JSON object."""
    keys = F.map_keys(F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>"))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def corpus_statistics(lessons: DataFrame, variants: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of the totals that a report needs."""
    size = word_statistics(lessons, record_words())
    a = lessons.agg(F.count("*").alias("lessons"), F.count_if("has_core_body_text").alias("with_body"), F.count_if("text_extraction_succeeded").alias("extracted"))
    b = variants.agg(F.count("*").alias("variant_pairs"), F.count_distinct("lesson_id").alias("with_variants"))
    c = quarantine.agg(F.count("*").alias("quarantined"), F.count_if(F.array_contains("source_fields", "query")).alias("with_query"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(c), "_one").join(one(size), "_one").drop("_one")
