"""Sinks: guarded writes, manifests and one-line JSON products."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import canonical_json


def _plain(path: str) -> str:
    """The path without dots; links of local paths followed."""
    scheme, _, rest = path.rpartition("://")
    if scheme and scheme != "file":
        return f"{scheme}://{posixpath.normpath(rest)}/"
    return os.path.realpath(rest.removeprefix("file:")).rstrip("/") + "/"


def guard_outside(path: str, protected: str) -> None:
    """Refuse to write into a protected folder."""
    if _plain(path).startswith(_plain(protected)):
        raise ValueError(f"{path} lies in the protected folder {protected}")


def redacted(message: Column, secret: str, most: int = 600) -> Column:
    """A message without a secret, cut to a length that is safe to store."""
    return F.left(F.replace(message, F.lit(secret), F.lit("[removed]")) if secret else message, F.lit(most))


def write_json(spark: SparkSession, value: dict, path: str) -> str:
    """One small JSON document, indented, keys sorted, under Spark's commit; returns its text."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_jsonl(df: DataFrame, path: str, protected: str | None = None, canonical: bool = False) -> None:
    """Gzipped JSON lines through Spark's committed writer; nulls are written, so absent and null stay apart.

    Canonical lines have sorted keys and no blanks.
    """
    if protected:
        guard_outside(path, protected)
    if canonical:
        line = canonical_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        df.select(line.alias("value")).write.option("compression", "gzip").text(path)
        return
    df.write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def _manifest(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(f"{path}/manifest").collect()  # one line
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return rows[0]["value"] if rows else None


def write_run(df: DataFrame, root: str, manifest: dict) -> str:
    """A dataset in a folder named by its manifest; an existing folder with another manifest is an error, the same is kept."""
    line = json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    path = f"{root}/{hashlib.sha256(line.encode()).hexdigest()[:24]}"
    spark, found = df.sparkSession, _manifest(df.sparkSession, path)
    if found is not None and found != line:
        raise ValueError(f"{path} belongs to another configuration")
    if found is None:
        df.write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def products(frames: dict[str, DataFrame]) -> DataFrame:
    """name, records and an order-free content hash of several datasets: what a run manifest records."""
    facts = None
    for name, df in frames.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("records"), F.sha2(F.coalesce(F.sum(F.xxhash64(*(F.to_json(c) if kind == "variant" else F.col(c) for c, kind in df.dtypes)).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("content"))
        facts = row if facts is None else facts.union(row)
    return facts


def write_snapshot(spark: SparkSession, text: str, records: int, folder: str, received: str, fields: list[str]) -> dict:
    """A response as it came (and a line end), compressed, with a manifest that ``readers.load_snapshot`` verifies; an
    existing folder is an error.

    A response is one text that its source gives whole, so it is small; Spark writes it, and its stored bytes are read back.
    """
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{folder}/response")
    data = f"{text}\n".encode()
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/response").select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).first()
    files = {"compressed": {"path": "response/" + stored["path"].rpartition("/")[2], "bytes": stored["bytes"], "sha256": stored["sha256"]}, "uncompressed": {"path": "", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}}
    manifest = {"record_count": records, "response_received_utc": received, "source_fields": sorted(fields), "files": files}
    write_json(spark, manifest, f"{folder}/manifest.json")
    return manifest


def _table(head: tuple[str, ...], rows: list[tuple]) -> str:
    shown = [f"{v:,}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for row in rows for v in row]
    lines = ["| " + " | ".join(shown[at : at + len(head)]) + " |" for at in range(0, len(shown), len(head))]
    return "\n".join(["| " + " | ".join(head) + " |", "| " + " | ".join(["---"] + ["---:"] * (len(head) - 1)) + " |", *lines])


def report(stats: dict[str, object], received: str | None = None) -> str:
    """Markdown sections of statistics that are already aggregated; equal statistics give equal text.

    Names tell the section: "missing F", "fields S" (a dictionary of counts), "flag C"; sizes are total, median, maximum
    and over; other names are totals.
    """
    named = lambda prefix: [(k.removeprefix(prefix), v) for k, v in sorted(stats.items()) if k.startswith(prefix)]
    sizes = ("total", "median", "maximum", "over")
    compared = ("both_fields_present", "equivalent_after_rendering", "different_nonempty_variants", "one_variant_empty")
    totals = [(k, v) for k, v in sorted(stats.items()) if " " not in k and k not in sizes]
    parts = ["# Corpus quality", f"Source received at {received}." if received else "The time of receipt is not known."]
    parts += ["## Reconciliation", _table(("Item", "Count"), totals)]
    parts += ["## Missing content", _table(("Field or section", "Records without content"), named("missing "))]
    parts += ["## Two fields of one section", _table(("Section", "Both present", "Equivalent", "Different", "One empty"), [(s, *(c.get(n, 0) for n in compared)) for s, c in named("fields ")])]
    by_section = [(k, v) for k, v in sorted(stats.items()) if k.split(" ")[0] in ("missing_section", "field_variant", "legacy_field_fallback")]
    parts += ["## Review signals", _table(("Signal", "Records"), named("flag ")), _table(("Signal and section", "Records"), by_section)]
    parts += ["## Size in words", _table(("Measure", "Words"), [(k, stats[k]) for k in sizes if stats.get(k) is not None])]
    return "\n\n".join(parts) + "\n"
