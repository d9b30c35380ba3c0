"""Operator 1: best-fit packing by minimum bin slack.

Documents are tokenized, given an end id and cut into pieces of at most ``capacity`` ids. Only the histogram of
piece lengths (at most ``capacity`` rows at any size of corpus) reaches the driver. There a bitset subset-sum
finds, for the largest piece left, the combination of the lengths left that fills a bin best; the combination is
taken as often as the histogram allows, which is what repeating the search bin by bin would choose, so the number
of searches follows the number of distinct lengths and not that of documents. Pieces are then ranked within their
length and placed by arithmetic on the rank. The rank is taken in hash buckets with prefix offsets, so that a
length that a third of all pieces share is not sorted in one task.

Defined results: null text is empty text, which has one piece with the end id alone; an empty table gives no rows;
repeated rows (even of one doc_id) are packed each on its own; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, materialize, per_slice, power_of_two, texts_of

CAPACITY = 4096
ROWS_PER_BUCKET = 100_000


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32)."""
    end = int(end_id).to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if keep_ids else []

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        from .tokens import encoder

        rows: list[list] = [[] for _ in fields]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text").to_pylist()), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, (_, t) in zip(rows, fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return texts_of(docs).mapInArrow(per_slice(cut), schema)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: copies})``: each combination fills a bin as full as the lengths left allow."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    chosen = []
    while left:
        top = next(iter(left))
        room = capacity - top
        full, reach, steps = (1 << (room + 1)) - 1, 1, []
        for length, count in left.items():
            copies, step = min(count - (length == top), room // length), 1
            while copies > 0:
                step = min(step, copies)
                if (after := reach | (reach << (step * length)) & full) != reach:
                    steps.append((length, step, reach))
                    reach = after
                copies, step = copies - step, step * 2
            if reach >> room & 1:
                break
        take, at = {top: 1}, reach.bit_length() - 1
        for length, step, before in reversed(steps):
            if not before >> at & 1:
                take[length] = take.get(length, 0) + step
                at -= step * length
        times = min(left[length] // copies for length, copies in take.items())
        chosen.append((times, take))
        for length, copies in take.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
    return chosen


def _segments(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, copies a bin, offset in the bin), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for times, take in plan:
        offset = 0
        for length, copies in take.items():
            rows.setdefault(length, []).append((used.get(length, 0), bins, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += copies * length
        bins += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a written table with doc_id, piece, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("bucket", bucket_of(power_of_two(pieces.count() / ROWS_PER_BUCKET), "doc_id", "piece"))
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_segments(minimum_bin_slack(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order)).hint("merge").join(bases, ["length", "bucket"])
    names = [c for c in pieces.columns if c != "bucket"]
    ranked = ranked.select(*names, (F.col("base") + F.col("rank") - 1).alias("rank"))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                rows = plan.value[int(one)]
                first, bin_, copies, begin = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1].T
                nth = rank[at] - first
                sequence[at], offset[at] = bin_ + nth // copies, begin + nth % copies * one
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kinds = dict(pieces.dtypes)
    return ranked.mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """Packed sequences of pieces that kept their ids: sequence_id, n_ids, ids and the doc_id and offset of each part."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    gathered = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    return gathered.select("sequence_id", "n_ids", joined.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(tokenized_pieces(docs, tokenizer, end_id, capacity), "packing-pieces"), capacity)
