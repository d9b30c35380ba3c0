"""Retrieval evaluation, contexts and prompts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import Answer, Generator
from .chunking import rendered, section_list

RULES = "Answer only from the records given. Name the record ids you used. Say so when they do not answer the question."


def first_relevant_rank(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """query_id and first_relevant_rank (null if none): one row a case. ``cases`` has query_id and expected_ids."""
    hits = results.where(F.col("rank") <= k).join(cases, "query_id").where(F.array_contains("expected_ids", F.col("parent")))
    return cases.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("first_relevant_rank")), "query_id", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """queries, hit_at_k and mrr_at_k; the means are null without a case."""
    r = F.col("first_relevant_rank")
    return ranks.agg(F.count("*").alias("queries"), F.avg(r.isNotNull().cast("double")).alias("hit_at_k"), F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0))).alias("mrr_at_k"))


def contexts(lessons: DataFrame) -> DataFrame:
    """lesson_id, title, url, text: all sections with text, also those that the index omits."""
    return lessons.select("lesson_id", F.col("display_title").alias("title"), F.col("source.public_lesson_url").alias("url"), rendered(section_list(lessons)).alias("text"), "quality_flags")


def ordered_text(df: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """key and text: the labelled parts of each key, in order."""
    part = F.concat(F.upper(label), F.lit("\n"), F.coalesce(text, F.lit("")))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def prompts(results: DataFrame, context: DataFrame, version: str = "v2", rules: str = RULES) -> DataFrame:
    """query_id, prompt_version, source_ids and payload (JSON with rules, question and source records)."""
    joined = results.join(context, results["parent"] == context["lesson_id"])
    record = F.struct("rank", "lesson_id", "title", "url", "text")
    gathered = joined.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(record)).alias("source_records"))
    payload = F.to_json(F.struct(F.lit(rules).alias("rules"), "question", F.transform("source_records", lambda r: r.dropFields("rank")).alias("source_records"), F.lit(0.2).alias("temperature"), F.lit(4096).alias("max_output_tokens")))
    return gathered.select("query_id", F.lit(version).alias("prompt_version"), F.transform("source_records", lambda r: r["lesson_id"]).alias("source_ids"), payload.alias("payload"))


def generated(prompts: DataFrame, generator: Generator) -> DataFrame:
    """The prompts without their payload, the generator's answer to each, and why it stopped there."""
    kept = [c for c in prompts.columns if c != "payload"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [a if isinstance(a, Answer) else Answer(a) for a in generator.generate(frame["payload"].tolist())]
            if len(said) != len(frame):
                raise ValueError("one answer for each prompt is expected")
            yield frame[kept].assign(answer=[a.text for a in said], finish_reason=[a.finish_reason for a in said])

    kinds = dict(prompts.dtypes)
    return prompts.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", answer string, finish_reason string")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """A batch of answers before and after a change of prompt, model or index, one row a question of either.

    outcome: same, changed, gained or lost an answer, none in both, or that only one batch has the question;
    same_sources tells whether both answers rest on the same records, in whatever order.
    """
    shown = ("question", "prompt_version", "source_ids", "answer", "finish_reason")
    side = lambda df, name: df.select("query_id", F.lit(True).alias(f"in_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in shown))
    both = side(before, "before").join(side(after, "after"), "query_id", "full")
    old, new = F.col("answer_before"), F.col("answer_after")
    outcome = F.when(F.col("in_after").isNull(), "only_before").when(F.col("in_before").isNull(), "only_after").when(old.isNull() & new.isNull(), "none").when(old.isNull(), "gained").when(new.isNull(), "lost")
    outcome = outcome.when(old == new, "same").otherwise("changed")
    of = lambda c: F.array_sort(F.array_distinct(c))
    sides = [F.col(f"{c}_{name}") for c in shown[1:] for name in ("before", "after")]
    return both.select("query_id", F.coalesce("question_after", "question_before").alias("question"), outcome.alias("outcome"), of("source_ids_before").eqNullSafe(of("source_ids_after")).alias("same_sources"), *sides)


def answer_text(parts):
    """Joined text of an array of (text, thought) response parts, without thoughts; null without any."""
    said = F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].isNotNull())
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda p: p["text"]), ""))


def append_history(answers: DataFrame, path: str) -> None:
    """Append answers with a name of their own (time saved, eight hexadecimal digits), as JSON and as Markdown.

    Earlier entries stay. The same answer saved twice is two entries, unless in the same second.
    """
    markdown = F.concat(F.lit("## "), "question", F.lit("\n\n"), F.coalesce("answer", F.lit("(no answer)")), F.lit("\n\nSources: "), F.array_join("source_ids", ", "), F.lit("\n"))
    now, row = F.current_timestamp(), F.to_json(F.struct(*answers.columns), {"ignoreNullFields": "false"})
    stem = F.concat(F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(row, 256), 1, 8))
    answers.select("*", now.alias("saved_at"), stem.alias("stem"), row.alias("json"), markdown.alias("markdown")).write.mode("append").parquet(path)
