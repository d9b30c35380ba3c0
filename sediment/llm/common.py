"""What the operators of this subpackage share: tables, the shared folder, and Arrow helpers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release, shared_dir  # noqa: F401  handed on

#: Texts that one step of an Arrow function holds at once.
TEXTS_AT_ONCE = 256
TEXTS_BYTES_AT_ONCE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2 ** 64."""
    return _powers(power_of_two(n), base)[:n] if n <= 1 << 20 else _grown(n, base)


@cache
def _powers(size: int, base: int) -> np.ndarray:
    return _grown(size, base)


def _grown(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Rolling hashes are polynomials modulo this prime. Two different stretches of n values have equal hashes at fewer than n
#: of its bases, whatever they hold; modulo a power of two, repetitive stretches lose many bits at every base.
PRIME = (1 << 61) - 1
_31, _30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def folded(x: np.ndarray) -> np.ndarray:
    """Any numbers of 64 bits modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))  # below zero is very large


def _at_31(x: np.ndarray) -> np.ndarray:
    """``x`` times 2 ** 31, below 2 ** 62, equal to it modulo PRIME."""
    return ((x & _30) << np.uint64(31)) + (x >> np.uint64(30))


def times(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    x1, x0, y1, y0 = x >> np.uint64(31), x & _31, y >> np.uint64(31), y & _31
    return folded((x1 * y1 << np.uint64(1)) + _at_31(x1 * y0 + x0 * y1) + x0 * y0)


def prime_powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo PRIME."""
    return _prime_powers(power_of_two(n), base)[:n] if n <= 1 << 20 else _prime_powers.__wrapped__(n, base)


@cache
def _prime_powers(size: int, base: int) -> np.ndarray:
    out, known = np.ones(size, np.uint64), 1
    while known < size:
        more = out[known : 2 * known]
        more[:] = times(out[: len(more)], np.uint64(pow(base, known, PRIME)))
        known *= 2
    return out


def rolling(values: np.ndarray, base: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of begins and ends: the hash of those stretches of ``values``, numbers below PRIME that are not zero."""
    terms = times(values, prime_powers(len(values), base))
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(terms >> np.uint64(31), out=sums[0, 1:])
    np.cumsum(terms & _31, out=sums[1, 1:])
    down = prime_powers(len(values) + 1, pow(base, -1, PRIME))

    def hashed(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = (s[end] - s[begin] for s in sums)
        return times(folded(_at_31(high) + low), down[begin])

    return hashed


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; other columns, whatever their names, are left out. Null text is empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that long texts are not all decoded at once."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin >= TEXTS_AT_ONCE or total + (size or 0) > TEXTS_BYTES_AT_ONCE):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def per_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``f`` to bounded slices of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  binds pa.compute on the executor

        for batch in batches:
            for part in slices(batch, column):
                yield f(part)

    return run


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is named so (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_of(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
