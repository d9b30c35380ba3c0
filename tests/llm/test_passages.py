"""Repeated passages that begin or end inside a line, against brute force."""

from __future__ import annotations

import random

from sediment.llm import lines


def _kept(rows: list[tuple[int, str]], least: int) -> dict[int, list[str]]:
    first, kept = {}, {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for p in range(len(words) - least + 1):
            run = tuple(words[p : p + least])
            doc, at = first.setdefault(run, (i, p))
            if doc < i or p >= at + least:
                gone |= set(range(p, p + least))
        kept[i] = [w for n, w in enumerate(words) if n not in gone]
    return kept


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    make = lambda n: [word() for _ in range(n)]
    lay = lambda words: "".join(w + rng.choice([" "] * 12 + ["\n", "  "]) for w in words)
    passages = [make(n) for n in (49, 50, 51, 54, 90, 300)]
    rows = []
    for i in range(60):
        words = make(rng.randrange(1, 40))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(30)])
            words += passage[a:] + make(rng.randrange(30))
        rows.append((i, lay(words)))
    rows += [(60, "x " * 400), (61, "y x " * 30), (62, ""), (63, " ".join(passages[3])), (64, "a " + "x " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["text"].split() for r in lines.without_repeated_passages(docs).collect()}
    assert found == _kept(rows, 50)


def test_stage_removes_passages_inside_lines(spark):
    import corpus_pipeline

    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    end, whole, begin, inside = make(12), make(24), make(18), make(59)
    rows = [(1, f"{make(30)} {end}\n{whole}\n{begin} {make(9)}"), (2, f"{make(70)} {inside} {make(14)}"), (3, f"m {end}\n{whole}\n{begin} n"), (4, f"p {inside} q"), (5, f"r {inside} s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert (found[3], found[4], found[5]) == (["m", "n"], ["p", "q"], ["r", "s"])
    assert found[1] == rows[0][1].split() and found[2] == rows[1][1].split()
