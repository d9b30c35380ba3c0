"""Collocations against brute force: overlaps, ties, odd white space, words inside longer phrases, large numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sediment.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, f string, times string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows() -> list[tuple]:
    rng = random.Random(2)
    common, rare = ["the", "of", "New", "york", "été", "\xa0x", "a", "É"], [f"r{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.choice([0, 1, 7, 30]))]
        text = rng.choice([" ", "  ", "\t"]).join(words)
        rows.append((i, rng.choice(["", "New York City. ", "a a a a a a! ", "\v\f", ";;"]) + text, rng.choice(["en", "fr", None])))
    rows += [(1, "new york city,  New  York\tCITY\rnew york city", "en")] * 40 + [(None, None, "en"), (5, "", None), (6, "only one", "zz"), (7, "long words " * 30000, "fr")]
    return [(*r, "clash", "clash", "clash") for r in rows]


def _expected(rows, least, longest, top, absorbed=100):
    counts: dict = defaultdict(Counter)
    totals: Counter = Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside: dict = {}
        for p, a in candidates.items():
            for q in {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}:
                inside[q] = max(inside.get(q, 0), a)
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= absorbed * a and p in inside:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, col.collocations(docs, least=20).collect())) == _expected(rows, 20, 5, 2000)
    assert sorted(map(tuple, col.collocations(docs, least=7, longest=3, top=9, absorbed=90).collect())) == _expected(rows, 7, 3, 9, 90)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """With so few bits that every n-gram may be frequent."""
    monkeypatch.setattr(col, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(col, "_bitmap", lambda found, bits: __import__("numpy").full(bits >> 3, 255, "uint8"))
    rows = _rows()
    assert sorted(map(tuple, col.collocations(spark.createDataFrame(rows, SCHEMA), least=20).collect())) == _expected(rows, 20, 5, 2000)


def test_pieces_keep_every_occurrence(spark):
    rows = _rows()
    pieces = col.pieces_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert pieces.groupBy("lang", "piece").count().where("count > 1").count() == 0
    expected = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            if piece.strip(" \t"):
                expected[lang or "und", piece.replace("\t", " ").strip(" ")] += 1
    assert {(r["lang"], r["piece"]): r["times"] for r in pieces.collect()} == dict(expected)


def test_buckets_larger_than_duckdb_memory(spark, monkeypatch):
    """Counts are added up in a bucket's file when memory is short."""
    monkeypatch.setattr(col, "BUCKET_MEMORY", "24MB")
    some = spark.range(600_000, numPartitions=4).select(F.lit("en").alias("lang"), F.concat(F.lit("a word of some length "), F.col("id") % 300_000).alias("phrase"), F.lit(3).cast("long").alias("f"))
    found = some.repartition(1).mapInArrow(col._added_up(6, 6), "lang string, phrase string, f long, hash long")
    assert found.agg(F.count("*"), F.min("f"), F.max("f"), F.count_distinct("phrase")).first() == (300_000, 6, 6, 300_000)


def test_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
