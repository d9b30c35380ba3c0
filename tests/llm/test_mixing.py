"""Source mixing against a brute-force mix, and its draw at sizes that no table here reaches."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sediment.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(i, make(rng.choice([0, 1, 5, 63, 64, 65, 700])), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(200)]
    rows += [(None, make(30), "s0"), (None, make(40), "s0"), (7, rows[7][1], rows[7][2]), (900, None, "only empty"), (901, make(20000), "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix_equals_brute_force(spark, docs):
    """Blocks tile each source without gaps; a source's slots go through its permutations one by one."""
    block, seed = 64, 7
    rows = mixing.sized(docs)
    sources = mixing.source_table(rows, block)
    sizes = {r["uid"]: r["size"] for r in rows.collect()}
    parts = defaultdict(list)
    for r in mixing.block_parts(mixing._with_source(rows, sources), block).collect():
        parts[r["key"], r["index"]].append((r["uid"], r["first"], r["n"]))
    words: Counter = Counter()
    for (key, index), of in parts.items():
        assert sum(n for _, _, n in of) == min(block, sources[key][2] - block * index)
        for uid, first, n in of:
            words.update((uid, w) for w in range(first, first + n))
    assert words == Counter({(uid, w): 1 for uid, size in sizes.items() for w in range(size)})
    taken: Counter = Counter()
    for key, _, size, blocks, _, slots in sources:
        for nth in range(slots):
            index = int(mixing.permuted(np.array([nth % blocks]), blocks, mixing._number(seed, key, nth // blocks))[0])
            for uid, _, n in parts[key, index]:
                taken[uid] += n
    doc_ids = {r["uid"]: (r["doc_id"], r["source"], r["size"]) for r in rows.collect()}
    expected = Counter((*doc_ids[uid][::2], taken[uid]) for uid in sizes)
    found = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in found) == expected
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_mixed_texts_hold_the_words_taken(docs):
    """As often as they are taken, in stretches of the document, each pass once over a word at most."""
    texts: dict = defaultdict(list)
    for r in mixing.mixed_documents(docs).where("doc_id < 900").collect():
        texts[r["doc_id"]].append(r["text"].split())
    whole = {r["doc_id"]: r["text"].split() for r in docs.where("doc_id < 900").distinct().collect()}
    taken: Counter = Counter()
    for r in mixing.mix(docs).where("doc_id < 900").collect():
        taken[r["doc_id"]] += r["taken"]
    for doc_id, n in taken.items():
        assert sum(map(len, texts[doc_id])) == n
        for words in texts[doc_id]:
            rest = iter(whole[doc_id])
            assert all(w in rest for w in words)  # a subsequence


def test_mix_does_not_depend_on_partitions(docs):
    rows = lambda df: Counter(map(tuple, mixing.mix(df).collect()))
    assert rows(docs) == rows(docs.repartition(7, "text"))


@pytest.mark.parametrize("total", [10, 4096 * 50, 10**9 + 7, 3 * 10**11])
def test_draw_keeps_totals_at_every_size(total):
    """Counts of neighbouring shards follow each other, and are spread as a multinomial draw is."""
    totals = np.array([total, total // 3, 0, 1], np.int64)
    shards = max(1, -(-int(totals.sum()) // mixing.SHARD_SLOTS))
    few = min(shards, 400)
    got, counts = {}, []
    for shard, keys, n, before in mixing.shard_draws(0, few, shards, totals, 3):
        for key, count, first in zip(keys.tolist(), n.tolist(), before.tolist(), strict=True):
            assert first == got.get(key, 0)
            got[key] = first + count
        counts.append(int(n.sum()))
    if few == shards:
        assert got == {k: int(v) for k, v in enumerate(totals) if v}
    else:
        assert abs(np.mean(counts) - mixing.SHARD_SLOTS) < 30 and 40 < np.std(counts) < 90
    last = list(mixing.shard_draws(shards - 1, shards, shards, totals, 3))
    assert all(before + n <= total for _, keys, ns, befores in last for n, before in zip(ns, befores, strict=True))


def test_targets_of_many_sources():
    found = mixing.targets([1] * 50_000 + [10**6], [1.0] * 50_000 + [5.0])
    assert found[0] == 2 and found[-1] == pytest.approx(1.5 * (50_000 + 10**6) - 100_000)
