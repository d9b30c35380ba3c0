"""Operator 7: mixing sources to target weights, by blocks of words.

The documents of a source, in a fixed order, are one long row of words that is cut into blocks of ``block`` words.
Targets follow from the weights, capped at a multiple of the source's size. The output is dealt into shards: the slots
of each source fall on the shards by a multinomial draw, so that a shard's source counts are multinomial given its size
and the sources' totals are kept. The draw is made along a binary tree over the shards, a binomial draw at each node
with a seed of its own, at every size alike; so any task can work out the counts of its shards, and how many slots the
shards before took, without the others. A source's n-th block slot is mapped through the source's pseudorandom
permutation of its block indexes (a new one each pass), and the drawn indexes are joined with the blocks.

A document's place in its source is a sum over hash buckets of (doc_id, text) plus a sum within the bucket, so neither a
source that holds a third of the corpus nor a doc_id (or null) that many rows share is ordered in one task. Only one row
for each source reaches the driver.

Defined results: null text is empty text, of size 0, of which nothing is taken; null source is a source of its own;
an empty table gives no rows; repeated rows count each, though which of two equal rows gives its words is open; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, fresh, materialize, per_slice, power_of_two

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Block slots to an output shard, on average.
SHARD_SLOTS = 4096
ROWS_PER_BUCKET = 8192
#: Up to so many sources, their small table is broadcast.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Weighted shares of ``share`` times all sizes, none above ``most`` times its size; the excess is shared again."""
    size, weight, out = np.array(sizes, float), np.array(weights, float), np.zeros(len(sizes))
    free, left = size > 0, share * float(sum(sizes))
    while free.any():
        wanted = left / weight[free].sum() * weight
        full = free & (wanted > most * size)
        if not full.any():
            out[free] = wanted[free]
            break
        out[full] = most * size[full]
        left -= out[full].sum()
        free &= ~full
    return out.tolist()


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(size): four Feistel rounds, walked on until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), [np.uint64(_number(seed, i)) for i in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(size))).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_draws(low: int, high: int, shards: int, totals: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each of the shards from low to high: its number, the sources it gets slots of, how many, and how many the shards before got."""

    def walk(a: int, b: int, keys: np.ndarray, counts: np.ndarray, before: np.ndarray):
        if b <= low or a >= high or not len(keys):
            return
        if b - a == 1:
            yield a, keys, counts, before
            return
        middle = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).binomial(counts, (middle - a) / (b - a))
        some = left > 0
        yield from walk(a, middle, keys[some], left[some], before[some])
        some = counts > left
        yield from walk(middle, b, keys[some], (counts - left)[some], (before + left)[some])

    keys = np.flatnonzero(totals)
    yield from walk(0, shards, keys, totals[keys], np.zeros(len(keys), np.int64))


def sized(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size (words) and tag (hash of the text), written: uid names the row from here on."""
    return materialize(_sizes(docs.select(*(docs[c] for c in ("doc_id", "source", "text")), F.monotonically_increasing_id().alias("uid")), "uid"), "mixing-sizes")


def _sizes(docs: DataFrame, uid: str) -> DataFrame:
    """doc_id, source, tag, uid and size (words) of documents whose rows are named by the column ``uid``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = [len(t.split()) for t in batch.column("text").to_pylist()]  # of bytes: at the six ASCII blanks
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "tag", "uid")), pa.array(size, pa.int64())], names=["doc_id", "source", "tag", "uid", "size"])

    text = F.coalesce(docs["text"], F.lit(""))
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(text).alias("tag"), docs[uid].alias("uid"), text.cast("binary").alias("text"))
    return narrow.mapInArrow(per_slice(run), "doc_id long, source string, tag long, uid long, size long")


def source_table(rows: DataFrame, block: int, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple]:
    """(key, source, size, blocks, target, slots), one for each source, by code point, null last."""
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([s for _, s in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    out = []
    for i, ((source, size), target) in enumerate(zip(found, wanted, strict=True)):
        blocks = -(-size // block)
        slots = min(round(target * blocks / size), int(most * blocks)) if size else 0
        out.append((i, source, size, blocks, target, slots))
    return out


def _with_source(rows: DataFrame, sources: list[tuple]) -> DataFrame:
    small = rows.sparkSession.createDataFrame(sources, "key int, of string, source_size long, blocks long, target double, slots long")
    small = F.broadcast(small) if len(sources) <= BROADCAST_SOURCES else small
    return rows.join(small, rows["source"].eqNullSafe(small["of"])).drop("of", "slots")


def block_parts(rows: DataFrame, block: int) -> DataFrame:
    """Where each document meets each block: key, index, uid, first (word of the document) and n (words)."""
    buckets = power_of_two(rows.count() / ROWS_PER_BUCKET)
    rows = rows.where("size > 0").select("uid", "doc_id", "tag", "key", "size", bucket_of(buckets, "doc_id", "tag").alias("bucket"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("doc_id", "tag", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).hint("merge").join(bases, ["key", "bucket"])
    placed = placed.select("uid", "key", "size", (F.col("at") + F.col("base")).alias("at"))
    b = F.lit(block)
    spread = placed.select("uid", "key", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("index"))
    first = F.greatest(F.col("index") * b - F.col("at"), F.lit(0))
    end = F.least((F.col("index") + 1) * b - F.col("at"), F.col("size"))
    return spread.select("key", "index", "uid", first.alias("first"), (end - first).alias("n"))


def draw(spark: SparkSession, sources: list[tuple], seed: int) -> DataFrame:
    """The mix: shard, slot (its place among the shard's), key, pass and index of each drawn block."""
    totals, blocks = np.array([s[5] for s in sources], np.int64), [s[3] for s in sources]
    shards = max(1, -(-int(totals.sum()) // SHARD_SLOTS))
    tasks = min(shards, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    edges = [shards * i // tasks for i in range(tasks + 1)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for task in frame["id"].tolist():
                for shard, keys, counts, before in shard_draws(edges[task], edges[task + 1], shards, totals, seed):
                    yield slots(shard, keys.tolist(), counts, before)

    def slots(shard: int, keys: list[int], counts: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        parts = []
        for key, count, first in zip(keys, counts.tolist(), before.tolist(), strict=True):
            nth = np.arange(first, first + count)
            turn = nth // blocks[key]
            index = np.empty(count, np.int64)
            for t in np.unique(turn):
                at = turn == t
                index[at] = permuted(nth[at] % blocks[key], blocks[key], _number(seed, key, int(t)))
            parts.append(pd.DataFrame({"key": np.int32(key), "turn": turn.astype(np.int32), "index": index}))
        dealt = pd.concat(parts, ignore_index=True)
        order = np.random.default_rng([seed, shards, shard]).permutation(len(dealt))
        return dealt.iloc[order].assign(shard=shard, slot=np.arange(len(dealt)))[["shard", "slot", "key", "turn", "index"]]

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "shard long, slot long, key int, turn int, index long")


def taken_parts(rows: DataFrame, sources: list[tuple], block: int, seed: int) -> DataFrame:
    """uid, first, n, times: how often the mix takes each part of each document; parts not taken are left out."""
    times = draw(rows.sparkSession, sources, seed).groupBy("key", "index").agg(F.count("*").cast("int").alias("times"))
    # its size follows that of the corpus, which Spark can't see behind Python: never broadcast
    return block_parts(_with_source(rows, sources), block).hint("merge").join(times, ["key", "index"]).select("uid", "first", "n", "times")


def mix(docs: DataFrame, block: int = 64, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of it that the mix takes, repeats counted)."""
    rows = sized(docs)
    sources = source_table(rows, block, weights, share, most)
    taken = taken_parts(rows, sources, block, seed).groupBy("uid").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = _with_source(rows, sources).join(taken, "uid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = 64, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass over a document, its text what the pass takes.

    A pass that takes all words leaves the text as it is; otherwise the taken stretches follow each other, joined by a
    line end, and n_chars (if there is such a column) is counted again. Documents without words leave.
    """
    uid, taken, names = fresh("_uid", docs), fresh("_parts", docs), docs.columns
    kept = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "mixing-documents")
    rows = materialize(_sizes(kept, uid), "mixing-sizes")
    sources = source_table(rows, block, weights, share, most)
    parts = taken_parts(rows, sources, block, seed).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "n", "times"))).alias(taken))
    joined = kept.join(parts.withColumnRenamed("uid", uid), uid).drop(uid)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import pyarrow.compute  # noqa: F401

        from .common import slices

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            for few in slices(batch):
                index, texts = [], []
                for i, (text, parts_) in enumerate(zip(few.column("text").to_pylist(), few.column(taken).to_pylist(), strict=True)):
                    spans = None
                    for turn in range(max(p["times"] for p in parts_)):
                        runs: list[list[int]] = []
                        for p in parts_:
                            if p["times"] > turn:
                                if runs and runs[-1][1] == p["first"]:
                                    runs[-1][1] += p["n"]
                                else:
                                    runs.append([p["first"], p["first"] + p["n"]])
                        spans = spans or [m.span() for m in word.finditer(text)]
                        whole = runs == [[0, len(spans)]]
                        index.append(i)
                        texts.append(text if whole else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
                out = few.take(pa.array(index, pa.int64()))
                columns = []
                for name in names:
                    if name == "text":
                        columns.append(pa.array(texts, pa.string()))
                    elif name == "n_chars":
                        columns.append(pa.array([len(t) for t in texts], out.column(name).type))
                    else:
                        columns.append(out.column(name))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
