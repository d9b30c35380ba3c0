"""Operator 5: a quality classifier of supervised subword embeddings.

A document is the mean of the learned vectors of its features: its words and its character n-grams (of code points, also
across blanks), hashed into BUCKETS rows. A softmax over two classes follows. The vectors and the output layer are trained by stochastic gradient descent
in numpy, on SAMPLE labelled documents chosen by the hash of doc_id (the documented bound; the sample's features are
counted on the executors). For scoring, each feature's vector is multiplied into the output layer once, which leaves
one number a bucket; the mean of these numbers gives the same softmax as the mean of the vectors.

Defined results: null or empty text has no feature and gets the score of the bias, the labels' base rate; labels that
are null, or whose documents are missing, teach nothing; several labels of one doc_id count as the highest, and of
several texts of one doc_id the one with the smallest hash teaches; without any label every score is 0.5; an empty table
gives no rows; repeated rows are scored each. Long texts are read in parts of CHARS_AT_ONCE code points, cut at blanks; a
word that is longer counts as several.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_slice, powers, texts_of

BUCKETS, DIMENSIONS, NGRAMS = 1 << 16, 16, (3, 5)
#: Labelled documents learned from, passes over them, and the first learning rate.
SAMPLE, EPOCHS, RATE = 2000, 15, 0.5
ACCEPT_FROM = 0.3
CHARS_AT_ONCE = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _B
    return ((h ^ (h >> np.uint64(29))) * _A >> np.uint64(48)).astype(np.uint16)


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of all words and character n-grams, repeats included, for one part of the text after the other."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    begin = 0
    while begin < len(points):
        end = min(begin + CHARS_AT_ONCE, len(points))
        own = points[begin:end]
        blank = (own == 32) | (own >= 9) & (own <= 13)
        if end < len(points) and blank.any():
            own, blank = own[: len(own) - blank[::-1].argmax()], blank[: len(own) - blank[::-1].argmax()]
        codes = points[begin : begin + len(own) + max(NGRAMS) - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(len(codes), int(_A)), out=sums[1:])
        down = powers(len(codes), pow(int(_A), -1, 1 << 64))
        inside = np.concatenate([[False], ~blank, [False]])
        first, last = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        yield _bucket((sums[last] - sums[first]) * down[first], 1)
        for n in NGRAMS:
            count = min(len(own), len(codes) - n + 1)
            if count > 0:
                yield _bucket((sums[n : n + count] - sums[:count]) * down[:count], n + 1)
        begin += len(own)


def log_odds(text: str, weights: np.ndarray) -> float:
    """The mean weight of the features, which the mean of their vectors gives in the output layer."""
    total, count = 0.0, 0
    for buckets in features(text):
        total += float(weights[buckets].sum(dtype=np.float64))
        count += len(buckets)
    return total / count if count else 0.0


def probability(texts: list[str | None], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Of label 1, by the softmax over two classes."""
    weights, bias = model
    return 1 / (1 + np.exp(-np.clip(np.array([log_odds(t or "", weights) for t in texts]) + bias, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """``rows`` are (label, buckets, their counts). Returns one weight a bucket and the bias, for class 1 against class 0."""
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    ones = sum(label for label, _, _ in rows)
    bias = np.log(np.array([len(rows) - ones + 1, ones + 1], np.float32))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, counts = rows[i]
            shares = (counts / counts.sum()).astype(np.float32)
            lr = np.float32(rate * (1 - done / steps))
            mean = shares @ vectors[buckets]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= lr * np.outer(p, mean)
            bias -= lr * np.float32(0.1) * p
            vectors[buckets] -= (lr * np.float32(len(buckets)) ** np.float32(0.5)) * np.outer(shares, back)
            done += 1
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = []
        for text in batch.column("text").to_pylist():
            counts = np.zeros(BUCKETS, np.int64)
            for buckets in features(text):
                counts += np.bincount(buckets, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            counted.append((used.astype("<u2").tobytes(), counts[used].astype("<u4").tobytes()))
        columns = [pa.array([c[i] for c in counted], pa.binary()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tag", "quality")), *columns], names=["doc_id", "tag", "quality", "buckets", "counts"])

    taught = texts_of(docs).withColumn("tag", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    counted = taught.mapInArrow(per_slice(count), "doc_id long, tag long, quality int, buckets binary, counts binary")
    one = F.min(F.struct("tag", "quality", "buckets", "counts")).alias("one")
    rows = counted.groupBy("doc_id").agg(one).orderBy("doc_id").select("one.*").collect()
    return train([(r["quality"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in rows if r["counts"]])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score, the probability of label 1, of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(batch.column("text").to_pylist(), shared.value))], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(per_slice(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], least: float = ACCEPT_FROM) -> DataFrame:
    """The documents, with all their columns, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        from .common import slices

        for batch in batches:
            for few in slices(batch):
                yield few.filter(pa.array(probability(few.column("text").to_pylist(), shared.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT_FROM).cast("int").alias("predicted"))
