"""Operator 11: how five filters overlap, in every order of applying them.

Duplicates are found by sorting: rows are range-partitioned by text fingerprint (SHA-256) and doc_id, sorted by
fingerprint, full text and doc_id, and each row is compared with its predecessor. So a text that a third of all rows
share lies in as many partitions as it needs. Only the first text of a partition may have begun before it: its rows of
the smallest doc_id stay open until the first and the last text of every partition, two rows each, are compared by
fingerprint. The bounds of the range are fingerprints and doc_ids, so the driver samples no texts.

A row's failures are one mask; masks are counted by part, and all that the report says about the 120 orders follows from
those counts, at most 32 a part: a filter removes what it fails and no earlier filter failed, and of a mask of m failures
each filter is the first in 120 / m orders.

Defined results: null text is empty text; null source is the part ''; identical texts fail E where their doc_id is above
the smallest one, so rows repeated with that doc_id stay; rows without a doc_id never fail E and make none fail it. A
document is good or toxic if any of its label rows says so; labels without a document count nowhere. An empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
_DUPLICATE = 1 << FILTERS.index("E")
_SCHEMA = "doc_id long, part string, mask int, open_fingerprint binary, edge boolean"


def text_failures(text: Column) -> Column:
    """The mask of filters A to D: short, repetitive, upper-case, marked-up."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    total, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (total < 50, 100 * F.size(F.array_distinct(words)).cast("long") < 65 * total, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sort order with bit E set where a predecessor has the same text and a smaller doc_id; then the edges."""
    import pyarrow.compute as pc

    text = first = fingerprint = edge = None  # of the run at hand; edge: the first run's fingerprint, while it lasts
    edges: list[tuple[bytes, int]] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, prints, ids = batch.column("text"), batch.column("fingerprint"), batch.column("doc_id")
        begun = np.empty(n, bool)
        begun[0] = text is None or texts[0].as_py() != text
        begun[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(begun, np.arange(n), -1))
        valid, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        ran, known = start >= 0, np.full(n, first is not None)
        known[ran] = valid[start[ran]]
        least = np.full(n, first or 0, np.int64)
        least[ran] = values[start[ran]]
        known &= valid
        if text is None:
            edge = prints[0].as_py()
            if valid[0]:
                edges.append((edge, int(values[0])))
        in_first = np.zeros(n, bool)
        if edge is not None:
            later = np.flatnonzero(begun[1 if text is None else 0 :]) + (1 if text is None else 0)
            in_first[: later[0] if len(later) else n] = True
            held = edge
            edge = None if len(later) else edge
        is_open = in_first & known & (values == least)
        mask = batch.column("mask").to_numpy(zero_copy_only=False) | np.where(known & (values > least), _DUPLICATE, 0)
        opened = pa.array([held if o else None for o in is_open], pa.binary()) if is_open.any() else pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([ids, batch.column("part"), pa.array(mask.astype(np.int32)), opened, pa.array(np.zeros(n, bool))], names=_NAMES)
        at = int(start[-1])
        if at >= 0:
            first = int(values[at]) if valid[at] else None
        text, fingerprint = texts[n - 1].as_py(), prints[n - 1].as_py()
    if first is not None and (fingerprint, first) not in edges:
        edges.append((fingerprint, first))
    prints, firsts = [e[0] for e in edges], [e[1] for e in edges]
    yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array([""] * len(edges), pa.string()), pa.array([0] * len(edges), pa.int32()), pa.array(prints, pa.binary()), pa.array([True] * len(edges), pa.bool_())], names=_NAMES)


_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: the i-th of FILTERS fails), a row for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("fingerprint", F.unhex(F.sha2("text", 256)))
    placed = keyed.repartitionByRange(F.col("fingerprint"), F.col("doc_id").asc_nulls_last()).sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())
    masked = placed.select("doc_id", "part", text_failures(F.col("text")).alias("mask"), "fingerprint", "text")
    found = materialize(masked.mapInArrow(_compared, _SCHEMA), "audit-masks")
    # two rows at most for each partition of the sort
    edges = found.where("edge").groupBy(F.col("open_fingerprint").alias("fingerprint")).agg(F.min("doc_id").alias("least"))
    whole = found.where("not edge").join(F.broadcast(edges), F.col("open_fingerprint") == F.col("fingerprint"), "left")
    late = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return whole.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(_DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def _steps() -> str:
    """Every step of every order: its filter's bit and those of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = ["".join(p) for p in permutations(FILTERS)]
    return json.dumps([{"filter_order": o, "step": k + 1, "own": bit[f], "before": sum(bit[b] for b in o[:k])} for o in orders for k, f in enumerate(o)])


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part and cells: for each mask that occurs, n, good and toxic; the counts of two tables add up."""
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = materialize(said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad")), "audit-labels")
    counts = masks.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report: one row for each part, order and step."""
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = mask_counts(failure_masks(docs), labels).select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")

    def total(what: str, holds) -> Column:
        def add(so_far: Column, cell: Column) -> Column:
            mask = cell["mask"]
            return so_far + F.when(holds(mask), cell[what] if what != "shares" else cell["n"] * F.floor(120 / F.bit_count(mask)).cast("long")).otherwise(0)

        return F.aggregate("cells", F.lit(0).cast("long"), add)

    own = lambda mask: mask.bitwiseAND(F.col("own")) != 0
    passed = lambda mask: mask.bitwiseAND(F.col("before")) == 0
    here = lambda mask: own(mask) & passed(mask)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: passed(m) & ~own(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: own(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("shares", own).alias("shapley"),
    )
