"""Operator 8: line dedup by winnowing over line hashes.

1. Select. A window is a shortest run of lines with at least ``least_words`` words; a long line is a window alone. The
   smallest line hash of a window is its fingerprint, and its line the position that is kept. Neighbouring windows mostly
   share their smallest line, so few positions are kept; and every repeated run of enough words holds a whole window,
   so it has a position of equal fingerprint at each of its places: that is winnowing's guarantee.
2. Join positions. Only positions whose fingerprint has another place go on.
3. Extend. From each such position, matches grow both ways, line by line, as far as runs of just enough words around it
   reach: all those runs (forward from a line before it, backward from a line behind it) are hashed whole to 128 bits, and
   the earliest place of each is found by an aggregate. So a position is held against all its equals at once and
   never pair by pair. A maximal match is the union of such runs.
4. Delete. A run that has an earlier place (by doc_id, then line) is a later repeat, and all its lines go.

The lines of a document travel as an array of hashes; its text is read for the hashes and for the cut, no more.
Blank lines are not part of a run: they stay and do not interrupt one. Lines compare without blanks at their ends.

Defined results: null text is empty text; a document may lose all its lines and is then an empty text; rows with equal
doc_id and equal text are one document for the comparison and keep the same lines; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, folded, fresh, materialize, release, rolling, slices

LEAST_WORDS = 50


def windows(words: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last index of each shortest run with enough words, forward ones first; and the number of those.

    ``words`` are positive.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    begin = np.arange(np.searchsorted(total, total[-1] - least_words, "right"))
    end = np.searchsorted(total, total[begin] + least_words)
    last = np.arange(np.searchsorted(total, least_words), len(total))
    first = np.searchsorted(total, total[last] - least_words, "right") - 1
    return np.concatenate([begin, first]), np.concatenate([end, last]) - 1, len(begin)


def selected(hashes: np.ndarray, words: np.ndarray, least_words: int) -> np.ndarray:
    """Positions of the smallest hash of each forward window, the first of equal ones, each once."""
    first, last, forward = windows(words, least_words)
    first, last = first[:forward], last[:forward]
    if not forward:
        return first
    _, rank = np.unique(hashes, return_inverse=True)
    edges = np.stack([first, last + 1], axis=1).ravel()
    least = np.minimum.reduceat(np.append(rank, len(rank)), edges)[::2]
    keys = np.sort(rank * (len(rank) + 1) + np.arange(len(rank)))
    return np.unique(keys[np.searchsorted(keys, least * (len(rank) + 1) + first)] % (len(rank) + 1))


def _line_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, hash and words of each line that is not blank."""
    from xxhash import xxh3_64_digest

    lines = [(i, stripped) for i, line in enumerate(text.split("\n")) if (stripped := line.strip())]
    hashes = np.frombuffer(b"".join([xxh3_64_digest(line.encode("utf-8", "surrogatepass")) for _, line in lines]), np.uint64)
    return np.array([i for i, _ in lines], np.int32), hashes, np.array([len(line.split()) for _, line in lines], np.int32)


def hashed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, tag (hash of the text), packed numbers, hashes and words of the lines, and picks: the positions selected
    and their fingerprints. Documents without a window are left out."""
    names = ["doc_id", "tag", "numbers", "hashes", "words", "picks"]
    pick = pa.list_(pa.struct([("at", pa.int32()), ("fingerprint", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                rows = []
                for doc_id, tag, text in zip(*(few.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                    numbers, hashes, words = _line_hashes(text)
                    if words.sum() >= least_words:
                        at = selected(hashes, words, least_words)
                        picks = [{"at": a, "fingerprint": f} for a, f in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True)]
                        rows.append((doc_id, tag, numbers.tobytes(), hashes.tobytes(), words.tobytes(), picks))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pick]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return _tagged(docs).mapInArrow(run, "doc_id long, tag long, numbers binary, hashes binary, words binary, picks array<struct<at:int,fingerprint:long>>")


def extended(hits: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, tag, first and last (line numbers), low and high (hash of the run): all runs of just enough words around
    the positions in ``ats``."""
    names = ["doc_id", "tag", "first", "last", "low", "high"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from xxhash import xxh3_128_digest

        for batch in batches:
            for few in slices(batch, "hashes"):
                rows: list[list] = [[] for _ in names]
                for doc_id, tag, numbers, hashes, words, ats in zip(*(few.column(c).to_pylist() for c in ("doc_id", "tag", "numbers", "hashes", "words", "ats")), strict=True):
                    numbers, ats = np.frombuffer(numbers, np.int32), np.sort(np.array(ats, np.int64))
                    first, last, _ = windows(np.frombuffer(words, np.int32), least_words)
                    first, last = np.unique(np.stack([first, last])[:, np.searchsorted(ats, first) < np.searchsorted(ats, last, "right")], axis=1)
                    whole = np.frombuffer(b"".join([xxh3_128_digest(hashes[8 * a : 8 * b + 8]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                    for column, values in zip(rows, ([doc_id] * len(first), [tag] * len(first), numbers[first], numbers[last], whole[:, 0], whole[:, 1]), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return hits.mapInArrow(run, "doc_id long, tag long, first int, last int, low long, high long")


def _tagged(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _shared(positions: DataFrame, key: str) -> DataFrame:
    """The keys that occur twice at least; written, so that a key of very many positions is skewed on one side of a join
    only, which Spark splits. (That a document's position may stand in two equal rows only adds to what is compared.)"""
    return materialize(positions.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "line-shared")


def _earliest(runs: DataFrame) -> DataFrame:
    """low, high and the earliest place (doc_id, tag, at) of the runs that occur twice at least; written as above."""
    found = runs.groupBy("low", "high").agg(F.min(F.struct("doc_id", "tag", "at")).alias("earliest"), F.count("*").alias("n"))
    return materialize(found.where("n > 1").select("low", "high", "earliest"), "line-earliest")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, tag and runs (array of first, last): the lines to delete in each document that has any; written."""
    lines = materialize(hashed_lines(docs, least_words), "line-hashes")
    positions = lines.select("doc_id", "tag", F.explode("picks").alias("pick")).select("doc_id", "tag", "pick.*")
    shared = _shared(positions, "fingerprint")
    # what grows with the corpus is merged, also while it is small: a broadcast that ends at some size is a step in the costs
    hits = positions.hint("merge").join(shared, "fingerprint", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("ats"))
    hits = hits.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "ats")
    around = lines.drop("picks").hint("merge").join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag"))).drop("of", "of_tag")
    runs = materialize(extended(around, least_words).withColumn("at", F.col("first")), "line-runs")
    release(lines, shared)
    earliest = _earliest(runs)
    later = runs.hint("merge").join(earliest, ["low", "high"]).where(F.struct("doc_id", "tag", "at") > F.col("earliest"))
    out = materialize(later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "line-repeats")
    release(runs, earliest)
    return out


def _join_runs(docs: DataFrame, runs: DataFrame, name: str, how: str = "left") -> DataFrame:
    """The documents with their runs in a column of that name."""
    text = F.coalesce(docs["text"], F.lit(""))
    tag, doc_id, of = (fresh(n, docs) for n in ("_tag", "_doc_id", "_of"))
    right = runs.select(F.col("doc_id").alias(doc_id), F.col("tag").alias(of), F.col("runs").alias(name))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.col(tag) == F.col(of))
    return docs.withColumn(tag, F.xxhash64(text)).hint("merge").join(right, same, how).drop(tag, doc_id, of)


def _without(text: str, runs: list[dict] | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    gone = {i for r in runs for i in range(r["first"], r["last"] + 1) if lines[i].strip()}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


def _cut(joined: DataFrame, docs: DataFrame, runs: str, cut) -> DataFrame:
    """``docs`` with ``cut`` applied to each text and its runs; n_chars, if there, is counted again."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                texts = [t if t is None else cut(t, r) for t, r in zip(few.column("text").to_pylist(), few.column(runs).to_pylist(), strict=True)]
                columns = {name: few.column(name) for name in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], few.column("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.mapInArrow(run, docs.schema)


def without_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, with all their columns, without repeated lines; n_chars, if there, is counted again."""
    runs = fresh("_runs", docs)
    return _cut(_join_runs(docs, repeats(docs, least_words), runs), docs, runs, lambda text, r: _without(text, r)[0])


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed (lines) and kept_sha256 of the text that is left."""
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                kept = [_without(t or "", r) for t, r in zip(few.column("text").to_pylist(), few.column("_runs").to_pylist(), strict=True)]
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _, _ in kept]
                columns = [few.column("doc_id"), pa.array([n for _, n, _ in kept], pa.int64()), pa.array([n for _, _, n in kept], pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return _join_runs(narrow, repeats(docs, least_words), "_runs").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bases of the two rolling hashes of runs of words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of 64 bits of each word."""
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join([xxh3_64_digest(w) for w in data.split()]), np.uint64)  # bytes split at the six ASCII blanks


def run_hashes(hashes: np.ndarray, n: int, base: int = _BASES[0]) -> np.ndarray:
    """A rolling hash (61 bits, mixed to 64) of each run of ``n`` words, equal wherever the run stands."""
    begin = np.arange(max(0, len(hashes) - n + 1))
    total = rolling(folded(hashes), base % PRIME)(begin, begin + n)
    total = (total ^ (total >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return total ^ (total >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value, the first of equal ones, of each window of ``width`` values."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at, span = np.where(values[right] < values[left], right, left), span + step
    return at


def anchor_words(least_words: int) -> int:
    """Longer anchors are shared by chance less often, shorter ones are fewer."""
    return max(1, least_words // 3)


def anchors(hashes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shorter runs of words that are the smallest in some run of ``least_words`` words (winnowing)."""
    k = anchor_words(least_words)
    if len(hashes) < least_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = run_hashes(hashes, k)
    at = np.unique(window_minima(short, least_words - k + 1))
    return at, short[at]


def _rows_of(docs: DataFrame, find, names: list[str]) -> DataFrame:
    """doc_id, tag, at and the named longs that ``find`` gives for each text (and its _ats, if there are any)."""
    columns = ["doc_id", "tag", "at", *names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                given = few.column("_ats").to_pylist() if "_ats" in few.schema.names else [None] * few.num_rows
                found = [find(word_hashes(text), ats) for text, ats in zip(few.column("text").to_pylist(), given, strict=True)]
                index = pa.array(np.repeat(np.arange(few.num_rows), [len(f[0]) for f in found]))
                parts = [np.concatenate([f[i] for f in found]) for i in range(1 + len(names))]
                arrays = [few.column("doc_id").take(index), few.column("tag").take(index), pa.array(parts[0].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in parts[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, "doc_id long, tag long, at int" + "".join(f", {n} long" for n in names))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, tag and runs (array of places): where runs of ``least_words`` words begin that occur earlier; written.

    Equal runs share an anchor at the same place in them. Only around anchors that occur twice are runs hashed whole and
    compared; all of them are, so that a passage is found word by word past any line's edges.
    """
    k = anchor_words(least_words)

    def chosen(hashes: np.ndarray, _: None) -> tuple[np.ndarray, ...]:
        return anchors(hashes, least_words)

    def around(hashes: np.ndarray, ats: list[int]) -> tuple[np.ndarray, ...]:
        begins = np.unique((np.array(ats)[:, None] - np.arange(least_words - k + 1)).ravel())
        begins = begins[(begins >= 0) & (begins <= len(hashes) - least_words)]
        return begins, *(run_hashes(hashes, least_words, base)[begins] for base in _BASES)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    found = materialize(_rows_of(_tagged(docs).withColumn("text", text), chosen, ["anchor"]), "passage-anchors")
    shared = _shared(found, "anchor")
    hits = found.hint("merge").join(shared, "anchor", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("runs"))
    likely = _join_runs(docs.select("doc_id", "text"), hits, "_ats", "inner")
    likely = likely.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), text, "_ats")
    runs = materialize(_rows_of(likely, around, ["low", "high"]), "passage-runs")
    release(found, shared)
    earliest = _earliest(runs)
    later = runs.hint("merge").join(earliest, ["low", "high"]).where(F.struct("doc_id", "tag", "at") > F.col("earliest"))
    # a run that overlaps its first occurrence is part of it
    itself = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("tag") == F.col("earliest.tag")) & (F.col("at") < F.col("earliest.at") + least_words)
    out = materialize(later.where(~itself).groupBy("doc_id", "tag").agg(F.collect_set("at").alias("runs")), "passages")
    release(runs, earliest)
    return out


def _without_words(text: str, begins: list[int] | None, least_words: int) -> str:
    if not begins:
        return text
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    parts, at, covered = [], 0, -1  # covered: the last word that is gone
    for begin in sorted(begins):
        if begin > covered + 1 or covered < 0:
            if covered >= 0:
                at = spans[covered][1]
            parts.append(data[at : spans[begin][0]])
        covered = begin + least_words - 1
    parts.append(data[spans[covered][1] :])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def without_repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, with all their columns, without runs of words that occur earlier, wherever they begin or end in a line."""
    runs = fresh("_runs", docs)
    joined = _join_runs(docs, repeated_passages(docs, least_words), runs)
    return _cut(joined, docs, runs, lambda text, begins: _without_words(text, begins, least_words))
