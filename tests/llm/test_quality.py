"""The classifier's features, training step and score against plain versions, and very long texts."""

from __future__ import annotations

import numpy as np
import pytest

from sediment.llm import quality

_M = (1 << 64) - 1
_A, _B = 0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53


def _bucket(points: list[int], salt: int) -> int:
    h = sum((p + 1) * pow(_A, i, 1 << 64) for i, p in enumerate(points)) & _M
    h = (h + salt) * _B & _M
    return ((h ^ (h >> 29)) * _A & _M) >> 48


def _features(text: str) -> list[int]:
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return sorted([_bucket([ord(c) for c in w], 1) for w in text.split(" ") if w])


def _all_features(text: str) -> list[int]:
    grams = [_bucket([ord(c) for c in text[i : i + n]], n + 1) for n in (3, 5) for i in range(len(text) - n + 1)]
    return sorted(_features(text) + grams)


@pytest.mark.parametrize("at_once", [7, 1 << 18])
def test_features_equal_brute_force(monkeypatch, at_once):
    """Parts are cut at blanks, so their edges change nothing (a word longer than a part is cut, and not tested here)."""
    monkeypatch.setattr(quality, "CHARS_AT_ONCE", at_once)
    for text in ["", " ", "a", "ab c", "naïve 漢字 😀😀 x\ty\nz", "it's a test", "  lead and trail  ", "\ud800 x"]:
        found = sorted(int(b) for part in quality.features(text) for b in part)
        assert found == _all_features(text), text


def test_training_step_equals_plain_version():
    rows = [(1, np.array([3, 9]), np.array([2, 1])), (0, np.array([9, 20]), np.array([1, 5])), (1, np.array([3]), np.array([4]))]
    weights, bias = quality.train(rows, epochs=2, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1 / 16, 1 / 16, (quality.BUCKETS, 16)).astype(np.float32).astype(float)
    output, b, done = np.zeros((2, 16)), np.log([2.0, 3.0]), 0
    for _ in range(2):
        for i in rng.permutation(3):
            label, buckets, counts = rows[i]
            lr = 0.5 * (1 - done / 6)
            mean = sum(c / counts.sum() * vectors[k] for k, c in zip(buckets, counts, strict=True))
            z = output @ mean + b
            p = np.exp(z) / np.exp(z).sum() - np.eye(2)[label]
            back = p @ output
            for o in (0, 1):
                output[o] -= lr * p[o] * mean
            b = b - lr * 0.1 * p
            for k, c in zip(buckets, counts, strict=True):
                vectors[k] -= lr * np.sqrt(len(buckets)) * c / counts.sum() * back
            done += 1
    assert weights == pytest.approx(vectors @ (output[1] - output[0]), abs=1e-5) and bias == pytest.approx(b[1] - b[0], abs=1e-5)


def test_scores_and_very_long_texts(spark):
    """A score is the softmax of the mean over all features; 20 MB are read in parts."""
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    texts = [None, "", "some words here", "ab " * 7_000_000, "q" * 2_000_000]
    rows = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, 0.25)).collect()}
    for i in (0, 1, 2):
        found = _all_features(texts[i] or "")
        mean = np.mean([weights[b] for b in found]) if found else 0.0
        assert rows[i] == pytest.approx(1 / (1 + np.exp(-mean - 0.25)))
    assert 0 < rows[3] < 1 and 0 < rows[4] < 1


def test_several_texts_of_one_id_teach_the_same(spark):
    docs = spark.createDataFrame([(1, "good words"), (1, "other words"), (2, "bad %%%"), (3, "good good"), (None, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    models = [quality.learn(docs.repartition(n, "text"), labels) for n in (1, 4)]
    assert (models[0][0] == models[1][0]).all() and models[0][1] == models[1][1]
