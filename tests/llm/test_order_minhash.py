"""Order MinHash against a plain version, and very long texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from sediment.llm import order_minhash as omh

_M = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * _B & _M
    x = (x ^ (x >> 29)) * _C & _M
    return x ^ (x >> 32)


def _plain(text: str) -> list[int]:
    points, seen, bins = [ord(c) for c in text], Counter(), {}
    k = min(8, len(points))
    for at in range(len(points) - k + 1 if points else 0):
        exponents = range(7, -1, -1) if k == 8 else range(k)
        h = _mix(sum(p * pow(_A, e, 1 << 64) for p, e in zip(points[at : at + k], exponents, strict=True)) & _M) >> 24
        numbered = _mix((h * _A + seen[h] * _C) & _M) >> 24
        seen[h] += 1
        bins.setdefault(numbered >> 34, []).append((numbered, at))
    out = []
    for b in range(64):
        chosen = [h + 1 for h, _ in sorted(sorted(bins.get(b, []))[:2], key=lambda x: x[1])]
        value = 0
        for h in [*chosen, 0, 0][:2]:
            value = _mix((value * _A + h) & _M)
        out.append(max(1, value >> 48) if chosen else 0)
    return out


def _likeness(a: list[int], b: list[int]) -> float:
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abc dé漢😀") for _ in range(n))
    texts = [None, "", "a", "abc", "abcdefg", "abcdefgh", make(40), make(300), "ab" * 200, "a" * 100, make(900)]
    texts += [texts[-1], texts[-1][:400] + "X" + texts[-1][401:], make(30)]
    rows = {r["doc_id"]: r for r in omh.fingerprints_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    texts = [t or "" for t in texts]
    printed = lambda fp: "".join(f"{x:04x}" for x in fp)
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = _plain(text), _plain(edited), _plain(following)
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(other)), i
        assert r["near_edited"] == pytest.approx(_likeness(own, other)) and r["near_next"] == pytest.approx(_likeness(own, after))


def test_very_long_texts(spark):
    texts = ["lorem ipsum " * 1_700_000, "lorem ipsum " * 170_000 + "x"]
    rows = sorted(omh.fingerprints_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["n_chars"] for r in rows] == [20_400_000, 2_040_001] and 0 <= rows[0]["near_next"] <= 1
