"""Operator 4: document fingerprints by Order MinHash.

Every k-mer of a text is numbered by its occurrence, hashed together with that number, and dealt to one of BINS by
the hash. In each bin the TUPLE smallest are selected, put back into text order, and hashed as a tuple. Moving or
changing a stretch of text changes the tuples that it touches or whose order it breaks, so the share of equal tuples
follows the edit distance and not only the set of k-mers.

The edited text of the contract needs the next document in doc_id order: documents are range-partitioned and sorted,
each task carries one document over to the next, and the pairs across two tasks (one a task) are joined afterwards.

Defined results: null text is empty text, without tuples, its fingerprint all zeros; two empty texts have likeness 1,
an empty and another text 0; a text shorter than a k-mer is one k-mer of its own length; rows with equal doc_id are
ordered by text; the document after the last is the first, for a lone document itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of

K, BINS, TUPLE = 8, 64, 2
#: A hash keeps 40 bits, so that it sorts in one word together with a position of 24 bits.
_POSITION = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)
#: Odd multipliers of two public mixing functions.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def _sorted_with_position(hashes: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes in order, and the positions that belong to them."""
    if len(hashes) <= 1 << 24:
        keys = np.sort(hashes << _POSITION | position)
        return keys >> _POSITION, keys & _MASK
    order = np.lexsort((position, hashes))
    return hashes[order], position[order]


def order_minhash(text: str) -> np.ndarray:
    """BINS 16-bit tuple hashes; 0 where a bin has no k-mer."""
    out = np.zeros(BINS, np.uint16)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(h):
        return out
    k, power, width = min(K, len(h)), int(_A), 1
    if k == K:
        while width < K:
            h = h[:-width] * np.uint64(power) + h[width:]
            power, width = power * power & (1 << 64) - 1, 2 * width
    else:
        h = np.array([sum(int(c) * pow(int(_A), i, 1 << 64) for i, c in enumerate(h)) & (1 << 64) - 1], np.uint64)
    h, position = _sorted_with_position(_mix(h) >> _POSITION, np.arange(len(h), dtype=np.uint64))
    at = np.arange(len(h))
    begins = np.concatenate([[True], h[1:] != h[:-1]])
    occurrence = at - np.maximum.accumulate(np.where(begins, at, 0))
    h, position = _sorted_with_position(_mix(h * _A + occurrence.astype(np.uint64) * _C) >> _POSITION, position)
    edges = np.searchsorted(h, np.arange(BINS + 1, dtype=np.uint64) << np.uint64(40 - 6))
    pick = edges[:-1, None] + np.arange(TUPLE)
    has = pick < edges[1:, None]
    pick = np.minimum(pick, len(h) - 1)
    chosen = np.where(has, h[pick] + np.uint64(1), np.uint64(0))
    place = np.where(has, position[pick], np.uint64(1 << 62))
    chosen = np.take_along_axis(chosen, np.argsort(place, axis=1, kind="stable"), axis=1)
    value = np.zeros(BINS, np.uint64)
    for i in range(TUPLE):
        value = _mix(value * _A + chosen[:, i])
    value = (value >> np.uint64(48)).astype(np.uint16)
    return np.where(has[:, 0], np.maximum(value, 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([*_SCHEMA, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def _row(doc_id: int | None, text: str, fp: np.ndarray, following: str, following_fp: np.ndarray) -> tuple:
    other = edited(text, following)
    other_fp = fp if other == text else order_minhash(other)
    return doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), _printed(fp), _printed(other_fp), likeness(fp, other_fp), likeness(fp, following_fp)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    edge = lambda name, doc_id, text: (doc_id, *[None] * 6, part, name, text)
    for batch in batches:
        for few in slices(batch):
            rows = []
            for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True):
                fp = order_minhash(text)
                rows.append((*_row(*last, text, fp), None, None, None) if last else edge("first", doc_id, text))
                last = doc_id, text, fp
            yield _batch(rows, _EDGES)
    if last:
        yield _batch([edge("last", *last[:2])], _EDGES)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield _batch([_row(doc_id, text, order_minhash(text), following, order_minhash(following))], _SCHEMA)


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    first = F.col("doc_id").asc_nulls_first()
    ordered = texts_of(docs).repartitionByRange(first).sortWithinPartitions(first, "text")
    walked = materialize(ordered.mapInArrow(_walk, _DDL + ", part int, edge string, text string"), "order-minhash")
    edges = walked.where("edge is not null").select("doc_id", "part", "edge", "text")  # two rows a task
    parts = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())
    following = walked.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    nexts = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = edges.where("edge = 'last'").join(following, "part").join(nexts, "next").select("doc_id", "text", "following")
    return walked.where("edge is null").select(*_SCHEMA.names).union(pairs.mapInArrow(_pairs, _DDL))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint alone, without any shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array([_printed(order_minhash(t)) for t in few.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fingerprint string")
