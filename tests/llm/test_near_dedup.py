"""The pipeline's near-dedup stage against exact similarities of five-word shingle sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sediment.llm import simhash


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]


def _shingles(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _alike(a: str, b: str) -> float:
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def _kept(texts: list[str]) -> list[int]:
    """One of each component of the pairs at 0.8 or more."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if _alike(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def _cut_to(words: list[str], similarity: float, rng: random.Random) -> list[str]:
    """The words with others at their end, so that the similarity is the one given."""
    n = len(words) - 4
    other = round(n * (1 - similarity) / (1 + similarity))
    return words[: len(words) - other] + _words(rng, other)


def test_stage_equals_brute_force(spark):
    """Similarities of 0.6 to 0.95, chains of them, texts of one repeated passage with different rests, exact copies."""
    rng, texts = random.Random(11), []
    for similarity in (0.6, 0.65, 0.7, 0.74, 0.78, 0.82, 0.86, 0.9, 0.95):
        for n in (120, 400):
            base = _words(rng, n)
            texts += [" ".join(base), " ".join(_cut_to(base, similarity, rng))]
    chain = _words(rng, 300)
    for _ in range(4):
        texts.append(" ".join(chain))
        chain = _cut_to(chain[20:] + chain[:20], 0.88, rng)
    passage = " ".join(_words(rng, 6))
    texts += [" ".join([passage] * 60 + _words(rng, 50)) for _ in range(3)]
    texts += ["", "one two", "one two", "one three", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect()) == _kept(texts)


def test_repeated_rows_leave_one(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(_words(rng, 60)) for _ in range(3))
    rows = [(1, a, "x"), (1, a, "y"), (1, a + " more", "z"), (2, a, "x"), (3, b, "x"), (3, c, "x"), (None, a, "x"), (None, a, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leaving string")
    found = simhash.one_of_each_group(docs)
    assert found.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert sorted(k for k in kept if k[0] == 3) == sorted([(3, b), (3, c)])
    assert sum(k[0] == 1 for k in kept) == 1 and sum(k[0] == 2 for k in kept) == 0 and sum(k[0] is None for k in kept) == 2


def test_stage_recall_at_the_limit_does_not_depend_on_the_table(spark):
    """Of 400 pairs at a similarity of 0.80 to 0.81, the same nearly all are found alone and among 5,000 other texts."""
    rng, pairs = random.Random(13), []
    for i in range(400):
        base = _words(rng, 304)
        edited = _cut_to(base, 0.805, rng)
        assert 0.8 <= _alike(" ".join(base), " ".join(edited)) < 0.81
        pairs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    others = [(1000 + i, " ".join(_words(rng, 100))) for i in range(5000)]
    gone = []
    for rows in (pairs, pairs + others):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        kept = {r["doc_id"] for r in simhash.one_of_each_group(docs).select("doc_id").collect()}
        gone.append({i for i, _ in rows} - kept)
    print("found", [len(g) for g in gone])
    assert gone[0] == gone[1] and len(gone[0]) >= 392 and all(i % 2 for i in gone[0])


@pytest.mark.parametrize("code", simhash.STAGE_CODES, ids=str)
def test_each_code_finds_pairs_at_the_limit(spark, monkeypatch, code):
    """The codes of larger tables, used at this size: candidates by anchors alone, of 120 pairs of texts at a similarity
    of 0.80 to 0.81."""
    monkeypatch.setattr(simhash, "STAGE_CODES", (simhash.STAGE_CODES[0], (1 << 62, *code[1:])) if code[1:] != simhash.STAGE_CODES[0][1:] else ((1 << 62, *code[1:]),))
    if len(simhash.STAGE_CODES) == 2:
        monkeypatch.setattr(simhash, "STAGE_CODES", ((0, *simhash.STAGE_CODES[0][1:]), simhash.STAGE_CODES[1]))
    rng, rows = random.Random(17), []
    for i in range(120):
        base = _words(rng, 304)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(_cut_to(base, 0.805, rng)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fps = [f"fp{i}" for i in range(simhash.STAGE_WORDS)]
    points = simhash.materialize(simhash.set_prints(docs).select(F.col("doc_id").alias("name"), F.col("doc_id").alias("label"), "size", *fps), "test-points")
    met = {(r["a"], r["b"]) for r in simhash.candidate_pairs(points).collect()}
    by_anchors = sum((2 * i, 2 * i + 1) in met for i in range(120)) / 120
    assert by_anchors >= 0.85


def test_a_product_code_has_the_anchors_of_its_list():
    """Looking up a product of two codes gives what comparing with all its words gives."""
    import numpy as np

    codes = simhash.halves(10)
    words = (codes[0][:, None] | codes[1][None, :] << np.uint64(32)).reshape(-1)
    fps = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64)
    for slack in (0, 3):
        parts = [set(zip(*(x.tolist() for x in f(fps, c, slack)[:2]), strict=True)) for f, c in ((simhash.anchors_of_halves, codes), (simhash.anchors_of, words))]
        assert parts[0] == parts[1]


@pytest.mark.parametrize("points", [1 << 20, 3_000_000, 30_000_000, 1 << 30])
def test_no_round_holds_more_replicas_than_its_bound(points):
    """All anchors of all words come up once, and what one round puts on disk does not grow with the code."""
    import numpy as np

    fps = np.random.default_rng(4).integers(0, 1 << 64, 300, dtype=np.uint64)
    index, anchor, _ = simhash.stage_anchors(points)(fps)
    rounds = simhash.stage_rounds(points)
    seen = np.zeros((simhash.STAGE_ANCHORED, len(anchor)), int)
    for words, (at, parts) in rounds:
        own = anchor % parts == at
        seen[words] += own
        assert len(words) * own.sum() <= 1.5 * simhash.STAGE_ROUND * len(fps)
    assert (seen == 1).all()
    if points < 1 << 24:  # 6 GB of documents have three million
        assert simhash.STAGE_ANCHORED * len(anchor) / len(fps) < 100


@pytest.mark.parametrize("code", simhash.STAGE_CODES, ids=str)
def test_rounds_give_the_candidates_of_one(spark, monkeypatch, code):
    monkeypatch.setattr(simhash, "STAGE_CODES", ((1 << 62, *code[1:]),))
    rng, rows = random.Random(19), []
    for i in range(60):
        base = _words(rng, 150)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(_cut_to(base, 0.85, rng)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    fps = [f"fp{i}" for i in range(simhash.STAGE_WORDS)]
    points = simhash.materialize(simhash.set_prints(docs).select(F.col("doc_id").alias("name"), F.col("doc_id").alias("label"), "size", *fps), "test-points")
    met = []
    for most in (max(10, code[3] // 2), 1 << 30):  # several rounds, one
        monkeypatch.setattr(simhash, "STAGE_ROUND", most)
        met.append({tuple(r) for r in simhash.candidate_pairs(points).collect()})
    assert met[0] == met[1] and len(met[0]) >= 50
