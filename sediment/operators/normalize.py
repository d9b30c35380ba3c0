"""Hits to normalized records: identity, field resolution, variants, dates, attachments, issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import NOT_CORE, SCHEMA_VERSION, SECTIONS
from ..functions import text as T
from ..functions.html import resolved_url
from ..scratch import materialize, release
from .markup import empty_rendering, rendered_by_key, text_key

FIELDS = ["title", *(f for fields in SECTIONS.values() for f in fields)]
_ISSUE = "struct<code:string,section:string,detail:string>"


@dataclass(frozen=True)
class Normalized:
    lessons: DataFrame
    variants: DataFrame
    quarantine: DataFrame
    issues: DataFrame
    comparisons: DataFrame


def _string(field: str) -> Column:
    value = F.try_variant_get("source", f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("source", f"$.{field}", "string"))


def with_identifier(hits: DataFrame) -> DataFrame:
    """Add lesson_id, null unless lesson_number is a string or an integer of decimal digits."""
    number = F.try_variant_get("source", "$.lesson_number", "variant")
    text = F.when(F.schema_of_variant(number).isin("STRING", "BIGINT"), F.try_variant_get("source", "$.lesson_number", "string"))
    return hits.withColumn("lesson_id", F.when(T.is_identifier(text), text))


def field_rows(records: DataFrame) -> DataFrame:
    """lesson_id, i (in FIELDS), text and wrong (no text): a row for each field that a record has."""
    def there(field: str) -> Column:
        value = F.try_variant_get("source", f"$.{field}", "variant")
        return F.when(value.isNotNull(), F.struct(F.lit(FIELDS.index(field)).alias("i"), _string(field).alias("text"), (~F.schema_of_variant(value).isin("STRING", "VOID")).alias("wrong")))

    return records.select("lesson_id", F.explode(F.array_compact(F.array(*map(there, FIELDS)))).alias("f")).select("lesson_id", "f.*")


def rendered_fields(records: DataFrame, by_key: DataFrame) -> DataFrame:
    """lesson_id and r: the renderings of all FIELDS in their order, null where a record has no such field.

    ``by_key`` has the rendering of each different text, so equal ones, in whatever field or record, are rendered once; a
    record's texts stay where they are, only their keys go along.
    """
    keyed = field_rows(records).select("lesson_id", "i", "wrong", text_key(F.col("text")).alias("key"))
    done = keyed.join(by_key, "key", "left").withColumn("r", F.coalesce("r", empty_rendering()))
    problem = F.array(F.struct(F.lit("ERROR").alias("level"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit("not a text field").alias("message")))
    r = F.when(F.col("wrong"), F.col("r").withField("parser_diagnostics", problem)).otherwise(F.col("r"))
    by_record = done.groupBy("lesson_id").agg(F.map_from_entries(F.collect_list(F.struct("i", r.alias("r")))).alias("by_field"))
    return by_record.select("lesson_id", F.array(*(F.try_element_at("by_field", F.lit(i)) for i in range(len(FIELDS)))).alias("r"))


def has_content(r: Column) -> Column:
    return F.coalesce((F.length(r["text"]) > 0) | (F.size(r["tables"]) > 0) | (F.size(r["media"]) > 0), F.lit(False))


def same_content(a: Column, b: Column) -> Column:
    return a["text"].eqNullSafe(b["text"]) & (a["tables"] == b["tables"]) & (a["links"] == b["links"]) & (a["media"] == b["media"])


def resolve_section(section: str) -> dict[str, Column]:
    """Columns of one section: the chosen rendering, its field, and how two spellings of the section compare."""
    fields = SECTIONS[section]
    present = [(f, F.col("r")[FIELDS.index(f)]) for f in fields]
    candidates = [F.when(r.isNotNull(), F.struct(F.lit(f).alias("field"), r.alias("r"))) for f, r in present]
    full = [F.when(has_content(r), c) for (_, r), c in zip(present, candidates, strict=True)]
    chosen = F.coalesce(*full, *candidates)
    out = {"chosen": chosen}
    if len(fields) == 2:
        a, b = present[0][1], present[1][1]
        both = a.isNotNull() & b.isNotNull()
        differ = both & ~same_content(a, b)
        out["both"] = both
        out["relation"] = F.when(~both, "one_or_no_field_present").when(~differ, "equivalent_after_rendering").when(has_content(a) & has_content(b), "different_nonempty_variants").otherwise("one_variant_empty")
        out["other"] = F.when(chosen["field"] == fields[0], candidates[1]).otherwise(candidates[0])
    return out


def _issue(when: Column, code: str, section: str | None = None, detail: Column | None = None) -> Column:
    made = F.struct(F.lit(code).alias("code"), F.lit(section).cast("string").alias("section"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    return F.when(F.coalesce(when, F.lit(False)), made.cast(_ISSUE))


def _rendering_issues(name: str, r: Column) -> list[Column]:
    return [
        _issue(r["parse_failed"].isNotNull(), "html_parse_failed", name, r["parse_failed"]),
        _issue(F.size(r["parser_diagnostics"]) > 0, "html_parser_diagnostics", name, F.to_json(r["parser_diagnostics"])),
        _issue(F.size(r["unrecognized_tags"]) > 0, "unrecognized_html_tags", name, F.to_json(r["unrecognized_tags"])),
        _issue(T.broken_quote(r["text"]), "possible_broken_quote_entity", name),
        _issue(F.size(r["tables"]) > 0, "table_requires_chunking_policy", name, F.size(r["tables"])),
        _issue(F.size(r["media"]) > 0, "media_content_not_loaded", name, F.size(r["media"])),
    ]


def normalize(hits: DataFrame, base_url: str, snapshot_path: str = "", snapshot_sha256: str = "", record_label: str = "Record") -> Normalized:
    """Split hits into records and quarantine; nothing is dropped. A repeated identifier is an error.

    Rendering is the costly step, so its result is written once, and so are the resolved sections: all that follows reads
    plain columns, which keeps the plans small.
    """
    known = with_identifier(hits)
    bad = known.where("lesson_id is null")
    quarantine = bad.select(F.col("doc_id").alias("raw_document_id"), F.concat(F.lit("/hits/hits/"), "idx").alias("raw_pointer"), F.lit("missing_or_invalid_lesson_number").alias("reason"), F.array_sort(F.coalesce(F.map_keys(F.try_variant_get("source", "$", "map<string,variant>")), F.array().cast("array<string>"))).alias("source_fields"), "raw_hit")
    good = known.where("lesson_id is not null")
    twice = good.groupBy("lesson_id").count().where("count > 1").select("lesson_id").head(1)
    if twice:
        raise ValueError(f"identifier {twice[0]['lesson_id']} occurs more than once")

    by_key = rendered_by_key(field_rows(good), "text", base_url)
    rendered = good.join(rendered_fields(good, by_key), "lesson_id", "left")
    sections = {s: resolve_section(s) for s in SECTIONS}
    empty = empty_rendering()

    def origin(field: Column) -> Column:
        value = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(_string(f) for f in FIELDS))), field)
        return F.when(field.isNotNull(), F.struct(field.alias("field"), T.pointer(F.col("idx"), field).alias("raw_pointer"), F.sha2(value, 256).alias("raw_utf8_sha256")))

    df = rendered.select("*", *(c.alias(f"{s}_{k}") for s, cols in sections.items() for k, c in cols.items()))
    of_section = [F.coalesce(F.col(f"{s}_chosen.r"), empty).alias(s) for s in SECTIONS]
    of_section += [F.col(f"{s}_chosen.field").alias(f"{s}_field") for s in SECTIONS]
    df = df.select("idx", "doc_id", "source", "lesson_id", F.coalesce(F.col("r")[0], empty).alias("title"), *of_section, *(c for c in df.columns if c.endswith(("_relation", "_other", "_both"))))
    df = materialize(df, "resolved-sections")
    release(by_key)

    raw_iso, ui = F.try_variant_get("source", "$.lesson_date", "string"), F.try_variant_get("source", "$.lessonDate", "string")
    df = df.withColumn("raw_iso", raw_iso).withColumn("iso", T.iso_date(_string("lesson_date"))).withColumn("ui", ui).withColumn("ui_date", T.display_date(_string("lessonDate")))
    listed = F.try_variant_get("source", "$.attachments", "array<variant>")
    kind = F.schema_of_variant(F.try_variant_get("source", "$.attachments", "variant"))
    numbered = [F.struct(F.lit(f"documentUrl{i}").alias("pointer"), _string(f"documentUrl{i}").alias("reference"), F.try_variant_get("source", f"$.documentName{i}", "string").alias("name"), F.try_variant_get("source", f"$.documentDescription{i}", "string").alias("description")) for i in range(4)]
    from_list = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda v, i: F.struct(F.concat(F.lit("attachments/"), i.cast("string")).alias("pointer"), F.try_variant_get(v, "$.link", "string").alias("reference"), F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.description", "string").alias("description")))
    df = df.withColumn("attachments", F.concat(from_list, F.filter(F.array(*numbered), lambda x: T.meaningful(x["reference"]))))

    core = [s for s in SECTIONS if s != NOT_CORE]
    body = F.lit(False)
    for s in core:
        body = body | F.col(f"{s}.source_text_present")
    failed = F.coalesce(*(F.col(f"{s}.parse_failed") for s in ("title", *SECTIONS))).isNotNull()
    present_iso = T.meaningful(F.col("raw_iso"))
    issues = [_issue(~F.col("doc_id").eqNullSafe(F.col("lesson_id")), "document_id_differs_from_lesson_number", None, F.col("doc_id")), _issue(F.col("title.text").isNull(), "missing_title")]
    for s, fields in SECTIONS.items():
        issues.append(_issue(~has_content(F.col(s)), "missing_section", s))
        issues.append(_issue(F.col(f"{s}_field") != fields[0], "legacy_field_fallback", s, F.col(f"{s}_field")))
        if len(fields) == 2:
            issues.append(_issue(F.col(f"{s}_relation") == "different_nonempty_variants", "field_variant", s, F.col(f"{s}_other.field")))
    for s in ("title", *SECTIONS):
        issues += _rendering_issues(s, F.col(s))
    issues += [
        _issue(present_iso & F.col("iso").isNull(), "invalid_iso_date", None, F.col("raw_iso")),
        _issue(~present_iso, "missing_iso_date"),
        _issue(F.col("iso") != F.col("ui_date"), "date_field_variant", None, F.col("ui_date")),
        _issue(T.meaningful(F.col("ui")) & F.col("ui_date").isNull(), "unparsed_display_date", None, F.col("ui")),
        _issue(kind.isNotNull() & ~kind.startswith("ARRAY") & (kind != "VOID"), "unexpected_attachments_type"),
        _issue(F.size("attachments") > 0, "attachment_content_not_loaded", None, F.size("attachments")),
        _issue(~body, "no_core_body_text"),
    ]
    df = df.withColumn("issues", F.filter(F.array(*issues), lambda x: x.isNotNull())).withColumn("has_core_body_text", body)
    df = df.withColumn("body_sha256", F.when(body, F.sha2(F.to_json(F.array(*(F.col(f"{s}.text") for s in core))), 256)))
    repeated = df.where("body_sha256 is not null").groupBy("body_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.col("body_sha256").alias("same_body"), F.lit(True).alias("repeated"))
    repeated = materialize(repeated, "repeated-bodies")  # written, so that Spark can split a body that very many records share
    # rows without a body are dealt out by their id: they find nothing, and don't meet in one task
    df = df.join(repeated, F.coalesce("body_sha256", F.concat(F.lit("none "), "lesson_id")) == F.col("same_body"), "left").drop("same_body")
    same = F.filter(F.array(_issue(F.col("repeated"), "same_body_text_as_other_lesson", None, F.col("body_sha256"))), lambda x: x.isNotNull())
    df = df.withColumn("issues", F.concat("issues", same))

    consumed = F.array(*map(F.lit, FIELDS))
    rest = F.map_filter(F.try_variant_get("source", "$", "map<string,variant>"), lambda k, _: ~F.array_contains(consumed, k))
    lessons = df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "lesson_id", "title", F.coalesce("title.text", F.concat(F.lit(f"{record_label} "), "lesson_id")).alias("display_title"), F.col("title.text").isNull().alias("display_title_generated"), F.col("iso").cast("string").alias("lesson_date"),
        F.struct(*(F.col(s).withField("source", origin(F.col(f"{s}_field"))).alias(s) for s in SECTIONS)).alias("sections"), "attachments", F.to_json(rest).alias("metadata_raw"),
        F.struct(F.lit(snapshot_path).alias("snapshot_path"), F.lit(snapshot_sha256).alias("snapshot_sha256"), F.concat(F.lit("/hits/hits/"), "idx").alias("raw_record_pointer"), F.col("doc_id").alias("raw_document_id"), F.concat(F.lit(base_url.rstrip("/") + "/lesson/"), "lesson_id").alias("public_lesson_url")).alias("source"),
        "has_core_body_text", (~failed).alias("text_extraction_succeeded"), F.array_sort(F.array_distinct(F.transform("issues", lambda x: x["code"]))).alias("quality_flags"), "body_sha256",
    )
    pairs = [F.when(F.col(f"{s}_relation") == "different_nonempty_variants", F.struct(F.lit(s).alias("section"), F.col(f"{s}_field").alias("selected_field"), F.col(s).alias("selected"), F.col(f"{s}_other.field").alias("alternate_field"), F.col(f"{s}_other.r").alias("alternate"))) for s, f in SECTIONS.items() if len(f) == 2]
    variants = df.select("lesson_id", F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("v")).select("lesson_id", "v.*")
    long = df.select("lesson_id", F.posexplode("issues").alias("seq", "issue")).select("lesson_id", "seq", "issue.*")
    compared = F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"{s}_relation").alias("relation"), F.col(f"{s}_both").alias("both_fields_present")) for s, f in SECTIONS.items() if len(f) == 2))
    comparisons = df.select("lesson_id", F.explode(compared).alias("c")).select("lesson_id", "c.*")
    return Normalized(lessons, variants, quarantine, long, comparisons)


def resolved_attachments(lessons: DataFrame, base_url: str) -> DataFrame:
    """lesson_id, pointer, reference, resolved_url: one row an attachment."""
    rows = lessons.select("lesson_id", F.explode("attachments").alias("a")).select("lesson_id", "a.pointer", "a.reference")
    return rows.withColumn("resolved_url", resolved_url(F.col("reference"), base_url))
