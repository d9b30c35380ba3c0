"""Line dedup against brute force on lines drawn from a few, and its selection of positions."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from sediment.llm import lines


def _gone(rows: list[tuple[int, str]], least: int) -> list[set[int]]:
    docs = [[(n, x.strip(), len(x.split())) for n, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    gone: list[set[int]] = [set() for _ in docs]
    for x, later in enumerate(docs):
        for y in range(x + 1):
            for i in range(len(later)):
                for j in range(len(docs[y]) if y < x else i):
                    if i and j and later[i - 1][1] == docs[y][j - 1][1]:
                        continue  # part of a longer match
                    n = 0
                    while i + n < len(later) and j + n < len(docs[y]) and later[i + n][1] == docs[y][j + n][1]:
                        n += 1
                    if sum(w for _, _, w in later[i : i + n]) >= least:
                        gone[x] |= {k for k, _, _ in later[i : i + n]}
    return gone


def test_lines_of_a_few_kinds_equal_brute_force(spark):
    rng = random.Random(7)
    kinds = [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(n)) for n in (1, 2, 3, 5, 8, 12, 20, 30, 49, 50, 60)] + ["", "  ", "ab  cd"]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(kinds) for _ in range(rng.randrange(0, 14)))) for i in range(70)]
    rows += [(70, "ab\n" * 120), (71, "ab\n" * 49), (72, "x\n" + "ab\n" * 60)]
    gone = _gone(rows, 50)
    found = {r["doc_id"]: r for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, text), g in zip(rows, gone, strict=True):
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in g)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (len(g), hashlib.sha256(kept.encode()).hexdigest()), i


def test_few_positions_are_selected():
    """Every window holds a position; on lines of ten words fewer than half of them are kept."""
    rng = np.random.default_rng(3)
    hashes, words = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.full(5000, 10)
    at = lines.selected(hashes, words, 50)
    first, last, forward = lines.windows(words, 50)
    assert (np.searchsorted(at, first) < np.searchsorted(at, last, "right")).all() and forward == 4996
    assert len(at) < 2000
