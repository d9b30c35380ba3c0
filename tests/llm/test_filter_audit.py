"""The filter audit against a brute-force run of all orders, with texts whose copies span partitions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sediment.llm import filter_audit as audit

SCHEMA = "doc_id long, text string, source string, part string, mask int, fingerprint string"


def _rows() -> list[tuple]:
    rng = random.Random(5)
    make = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    many, few = [f"w{i}" for i in range(900)], ["ab", "Cd", "ef"]
    rows = [(i, make(rng.choice([0, 3, 49, 50, 90]), rng.choice([many, few])) + rng.choice(["", "", " #", " LOUD" * 9]), rng.choice(["a", "b", None, ""])) for i in range(120)]
    shared = make(60, many)
    rows += [(1000 + i, shared, f"s{i % 3}") for i in range(300)]  # more than a partition holds
    rows += [(1000, shared, "s0")] * 3 + [(None, shared, "s0")] * 2  # repeats of the first, and none that has an id
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, " \t\r\n", "b"), (None, "alone", None), (None, "alone", None), (2003, "É" * 20 + "A", "b"), (2004, "x y " * 30000, "b")]
    return [(*r, "clash", 7, "clash") for r in rows]


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 1100, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1), (1001, None, None)]


def _expected(rows: list[tuple]) -> set[tuple]:
    least: dict[str, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = {d for d, q, _ in LABELS if q == 1 and d is not None}, {d for d, _, t in LABELS if t == 1 and d is not None}
    by_part: dict[str, list] = defaultdict(list)
    for doc_id, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = doc_id is not None and doc_id > least[text]
        by_part[source or ""].append((frozenset(f for f in fails if fails[f]), doc_id in good, doc_id in toxic))
    out = set()
    for part, docs in by_part.items():
        steps, share = {}, Counter()
        for order in map("".join, permutations(audit.FILTERS)):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = [d for d in docs if f in d[0]]
                share[f] += len(gone)
                steps[order, k + 1] = (f, len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        out |= {(part, order, k, *counts, share[f]) for (order, k), (f, *counts) in steps.items()}
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_audit_equals_brute_force(spark, partitions):
    rows = _rows()
    random.Random(partitions).shuffle(rows)
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = audit.filter_audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r) for r in found} == _expected(rows)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(none, labels).collect() == []
    one = spark.createDataFrame(_rows()[:1], SCHEMA)
    assert audit.filter_audit(one, labels).count() == 600
