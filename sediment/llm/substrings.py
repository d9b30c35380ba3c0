"""Operator 9: repeated byte strings, by longest previous factors in suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. A start's
longest previous factor is the longest prefix of its suffix that also starts in a smaller document. In suffix order it
is the larger of the common prefixes with the nearest smaller owner before and the nearest one after; where it reaches
``length``, the string goes. Suffix order is made within groups that hold all matches that matter:

1. Each window of ``length`` bytes is named by an anchor, the smallest hash of its GRAM-byte strings. Equal windows
   have equal anchors at equal places. The bytes that hold an anchor's windows are its region. Anchors travel to
   buckets as packed arrays of (hash, sides, digest of the region, document, place).
2. Of equal regions, all but those of the smallest document are covered whole; that is settled within each task first,
   then in the buckets. What is left is one document for each different region. It is compared only if another
   document has the same anchor with equal bytes before or after it; the other regions have no earlier match.
3. Regions to compare are gathered by their anchor's hash. There their starts are put in suffix order, and longest
   previous factors say which of them repeat a smaller document.
4. The covered stretches go back to the documents, where the bytes are removed and the rest is hashed.

An anchor with very many different regions, in a task or in all, is never gathered: its windows are hashed whole (128
bits), and Spark aggregates the smallest document of each hash, partially before its shuffle. A task that meets so many
says so by a mark in the anchor's bucket, so that all its regions take the same way, which gives the same result.

A document equal to a smaller one's whole text has equal regions everywhere, so step 2 covers it without any bytes.
Regions count as equal if their digests (polynomials modulo a prime of 61 bits) and 32 or more bits of the anchor's hash
(40 at half a GB, 56 at 100 TB) agree; bytes are compared in step 3 only.

Defined results: null text is empty text; texts shorter than ``length`` lose nothing; rows with equal doc_id never
remove each other's bytes; rows with a null doc_id neither lose bytes nor count as earlier; an empty table gives no
rows; other input columns are ignored. Long texts are read in parts of a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, materialize, power_of_two, release, rolling, slices

LENGTH, GRAM = 50, 16
#: Anchors packed into one set of arrays, anchors to a bucket, and bytes of regions put in suffix order at once.
ANCHORS_AT_ONCE, ANCHORS_PER_BUCKET, REGION_BYTES_AT_ONCE = 1 << 18, 1 << 18, 1 << 20
#: Regions of one anchor, in a packed set and in a bucket, above which its windows go by whole hashes; entries that a
#: bucket holds before it looks for such anchors; windows that a task hashes at once.
MOST_IN_SET, MOST_IN_BUCKET, HELD_AT_ONCE, WINDOWS_AT_ONCE = 256, 4096, 1 << 20, 1 << 16
#: Bytes of a text that are read at once, and bytes of texts for one task of the buckets.
_CHUNK, _BYTES_PER_TASK = (1 << 20) - 256, 1 << 29
_A, _B, _C = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def _context(part: np.ndarray, before: np.ndarray, after: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte of hash for the GRAM bytes before and for those after each anchor's own (the lower byte is the one
    before), and a digest (61 bits, mixed to 64) for the bytes from begin to end.

    A window of LENGTH bytes holds, besides its anchor, one of these two stretches whole, so two equal windows agree in
    one byte at least. (That holds for lengths of three GRAMs minus one or more.) Beyond the text's ends zeros are taken.
    """
    padded = np.concatenate([np.zeros(GRAM - len(before), np.uint8), before, part, after, np.zeros(2 * GRAM - len(after), np.uint8)])
    polynomial = rolling(padded.astype(np.uint64) + np.uint64(1), _A % PRIME)

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(polynomial(a, b))

    left, right = (hashed(a, a + GRAM) >> np.uint64(56) for a in (at, at + 2 * GRAM))
    return (left | right << np.uint64(8)).astype(np.uint16), hashed(begin + GRAM, end + GRAM)


def _anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, power, width = raw.astype(np.uint64) + np.uint64(1), _A, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, 2 * width
    h = _mix(h)
    least = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], at[first], first


def regions(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, sides, digest, begin and size of the region of each anchor, for one part of the text after the other."""
    raw = np.frombuffer(data, np.uint8)
    for begin in range(0, max(0, len(raw) - length + 1), _CHUNK):
        part = raw[begin : begin + _CHUNK + length - 1]
        h, at, first = _anchors(part, length)
        last = np.concatenate([first[1:], [len(part) - length + 1]]) - 1
        end = begin + len(part)
        sides, digest = _context(part, raw[max(0, begin - GRAM) : begin], raw[end : end + 2 * GRAM], at, first, last + length)
        # minima are small numbers: mixed again, they fall evenly on the buckets
        yield _mix(h * np.uint64(_A)), sides, digest, first + begin, last + length - first


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # without an alias where none is needed: Spark drops it from one of two equal plans only, and then does not see them as equal
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.xxhash64(text).alias("tag"), text.cast("binary").alias("data"))


def _few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        yield from slices(batch, "data")


_PACKED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("n", pa.int32()), ("entries", pa.binary()), ("kind", pa.string())])
_PACKED_DDL = "bucket int, docs binary, tags binary, n int, entries binary, kind string"
_MARKS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("covered", pa.binary()), ("compare", pa.binary()), ("windows", pa.binary())])
_MARKS_DDL = "doc_id long, tag long, covered binary, compare binary, windows binary"
#: Type and bytes kept of: anchor (as differences), sides, digest, row in docs and tags, begin, size; and of stretches.
_ENTRY = (("<u4", 4), ("<u2", 2), ("<u8", 8), ("<u4", 4), ("<u4", 4), ("<u2", 2))
_STRETCH = (("<u4", 4), ("<u4", 4), ("<u4", 4))
_COMPARE = np.dtype([("key", "<u8"), ("begin", "<u4"), ("size", "<u4")])


def _squeeze(kinds: tuple, *columns: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes() for (kind, width), x in zip(kinds, columns, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(kinds: tuple, data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * sum(w for _, w in kinds)), np.uint8), [], 0
    for kind, width in kinds:
        column = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        column[:, :width] = raw[at : at + width * n].reshape(width, n).T
        out.append(column.view(kind).ravel())
        at += width * n
    return out


def _begins(*ordered: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    apart = np.zeros(len(ordered[0]), bool)
    apart[:1] = True
    for column in ordered:
        apart[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(apart)


def _later(key: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a smaller document with an equal region."""
    order = np.lexsort((digest, key))
    begins = _begins(key[order], digest[order])
    out = np.empty(len(key), bool)
    out[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], begins), np.diff(begins, append=len(key)))
    return out


def _met(key: np.ndarray, sides: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries share their key and one of their side bytes with another document."""
    out = np.zeros(len(key), bool)
    for shift in (0, 8):
        side = sides >> np.uint16(shift) & np.uint16(255)
        order = np.lexsort((side, key))
        begins = _begins(key[order], side[order])
        if len(begins):
            several = np.minimum.reduceat(doc[order], begins) != np.maximum.reduceat(doc[order], begins)
            out[order] |= np.repeat(several, np.diff(begins, append=len(key)))
    return out


def _merged(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches (the last two columns are begin and end) of each document (the columns before), those that touch joined.

    Where a stretch lies within another, some that touch may stay apart.
    """
    order = np.lexsort(columns[::-1])
    *who, begin, end = (c[order] for c in columns)
    apart = np.ones(len(begin), bool)
    if len(begin):
        apart[1:] = begin[1:] > end[:-1]
        for column in who:
            apart[1:] |= column[1:] != column[:-1]
    at = np.flatnonzero(apart)
    return *(c[at] for c in who), begin[at], np.maximum.reduceat(end, at) if len(at) else end


def _often(key: np.ndarray, most: int) -> np.ndarray:
    """Which entries have a key that more than ``most`` of them have."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] > most


def _pack(buckets: int, length: int, most: int):
    """Packed anchors of all documents."""
    bits = np.uint64(buckets.bit_length() - 1)

    def flush(docs: list, tags: list, parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, sides, digest, begin, size, who = (np.concatenate([p[i] for p in parts]) for i in range(6))
        doc, tag = np.array(docs, np.int64), np.array(tags, np.int64)
        key = key >> (np.uint64(32) - bits)
        rows: dict[str, list] = {n: [] for n in _PACKED.names}

        def add(number: int, names: np.ndarray, kind: str, before: tuple, after: tuple) -> None:
            used, index = np.unique(names, return_inverse=True)
            entries = _squeeze(_ENTRY if kind == "anchors" else _STRETCH, *before, index, *after)
            for column, value in zip(rows.values(), (number, doc[used].tobytes(), tag[used].tobytes(), len(names), entries, kind), strict=True):
                column.append(value)

        def stretches(at: np.ndarray, kind: str) -> None:
            for b, some in enumerate(at[i : i + (1 << 16)] for i in range(0, len(at), 1 << 16)):
                names, a, z = _merged(who[some], begin[some], begin[some] + size[some])
                add(b % buckets, names, kind, (), (a, z))

        later = _later(key, digest, doc[who])
        stretches(np.flatnonzero(later), "covered")
        sent = np.flatnonzero(~later)
        many = _often(key[sent], most)
        stretches(sent[many], "windows")
        told = sent[many][np.unique(key[sent[many]], return_index=True)[1]]
        size[told] = 0  # an entry without bytes tells the bucket that this anchor's windows go by whole hashes
        sent = np.concatenate([sent[~many], told])
        sent = sent[np.argsort(key[sent], kind="stable")]
        bucket, small = (key[sent] >> np.uint64(32)).astype(np.int64), (key[sent] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            x, k = sent[edges[b] : edges[b + 1]], small[edges[b] : edges[b + 1]]
            add(int(b), who[x], "anchors", (np.diff(k, prepend=np.uint32(0)), sides[x], digest[x]), (begin[x], size[x]))
        yield pa.RecordBatch.from_pydict(rows, schema=_PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tags, parts, held = [], [], [], 0
        for few in _few(batches):
            for doc_id, tag, data in zip(*(few.column(c).to_pylist() for c in ("doc_id", "tag", "data")), strict=True):
                for found in regions(data, length):
                    if not docs or docs[-1] != doc_id or tags[-1] != tag:
                        docs.append(doc_id)
                        tags.append(tag)
                    parts.append((*found, np.full(len(found[0]), len(docs) - 1, np.int64)))
                    held += len(found[0])
                    if held >= ANCHORS_AT_ONCE:
                        yield from flush(docs, tags, parts)
                        docs, tags, parts, held = [], [], [], 0
        yield from flush(docs, tags, parts)

    return run


def _marks(column: str, doc: np.ndarray, tag: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row for each document, with its values packed into one of the columns."""
    order = np.lexsort((tag, doc))
    doc, tag, values = doc[order], tag[order], values[order]
    begins = _begins(doc, tag)
    packed = [values[a:b].tobytes() for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(doc)], strict=False)]
    nothing = [None] * len(packed)
    return pa.RecordBatch.from_arrays([pa.array(doc[begins]), pa.array(tag[begins]), *(pa.array(packed if c == column else nothing, pa.binary()) for c in _MARKS.names[2:])], schema=_MARKS)


def _stretches(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.stack([begin, end], axis=1).astype("<u4")


def _stretch_marks(column: str, doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    doc, tag, begin, end = _merged(doc, tag, begin.astype(np.int64), end.astype(np.int64))
    return _marks(column, doc, tag, _stretches(begin, end))


class _Bucket:
    """The entries of one bucket, as they arrive: those settled leave at once if too many gather."""

    def __init__(self, number: int, most: int, hold: int):
        self.number, self.most, self.hold = number, most, hold
        self.parts, self.held, self.thin_from, self.crowded = [], 0, hold, np.zeros(0, np.uint64)

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        steps, sides, digest, who, begin, size = _unsqueeze(_ENTRY, row["entries"], row["n"])
        key = np.cumsum(steps, dtype=np.uint32) | np.uint64(self.number) << np.uint64(32)
        if (told := size == 0).any():
            self.crowded = np.union1d(self.crowded, key[told])
        doc, tag = np.frombuffer(row["docs"], np.int64)[who], np.frombuffer(row["tags"], np.int64)[who]
        self.parts.append(tuple(x[~told] for x in (key, sides, digest, doc, tag, begin, size)))
        self.held += row["n"]
        if self.held > self.thin_from:
            yield from self.thin()
            self.thin_from = max(self.hold, 2 * self.held)

    def thin(self) -> Iterator[pa.RecordBatch]:
        """Let go of regions that a smaller document has too, and of those of crowded anchors."""
        key, _, digest, doc, tag, begin, size = columns = [np.concatenate([p[i] for p in self.parts]) for i in range(7)]
        later = _later(key, digest, doc)
        if later.any():
            yield _stretch_marks("covered", doc[later], tag[later], begin[later], begin[later] + size[later].astype(np.uint32))
        if self.held > self.hold:
            self.crowded = np.union1d(self.crowded, key[~later][_often(key[~later], self.most)])
        whole = ~later & np.isin(key, self.crowded)
        if whole.any():
            yield _stretch_marks("windows", doc[whole], tag[whole], begin[whole], begin[whole] + size[whole].astype(np.uint32))
        self.parts = [tuple(c[~later & ~whole] for c in columns)]
        self.held = len(self.parts[0][0])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.thin()
        met = _met(self.parts[0][0], self.parts[0][1], self.parts[0][3])
        key, _, _, doc, tag, begin, size = (c[met] for c in self.parts[0])
        whole = _often(key, self.most)
        if whole.any():
            yield _stretch_marks("windows", doc[whole], tag[whole], begin[whole], begin[whole] + size[whole].astype(np.uint32))
        compare = np.empty(int((~whole).sum()), _COMPARE)
        compare["key"], compare["begin"], compare["size"] = key[~whole], begin[~whole], size[~whole]
        yield _marks("compare", doc[~whole], tag[~whole], compare)


def _find_marks(most: int, hold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["kind"] != "anchors":
                    who, begin, end = _unsqueeze(_STRETCH, row["entries"], row["n"])
                    yield _marks(row["kind"], np.frombuffer(row["docs"], np.int64)[who], np.frombuffer(row["tags"], np.int64)[who], _stretches(begin, end))
                    continue
                if bucket is None or bucket.number != row["bucket"]:
                    if bucket is not None:
                        yield from bucket.close()
                    bucket = _Bucket(row["bucket"], most, hold)
                yield from bucket.add(row)
        if bucket is not None:
            yield from bucket.close()

    return run


def marks(texts: DataFrame, n_bytes: int, length: int = LENGTH) -> DataFrame:
    """doc_id, tag and packed: covered (stretches of bytes), compare (anchors and regions), windows (stretches whose
    windows are hashed whole); a document possibly in many rows."""
    buckets = power_of_two(n_bytes / ((length - GRAM) / 2 + 1) / ANCHORS_PER_BUCKET)
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // _BYTES_PER_TASK))
    packed = texts.where("doc_id is not null").mapInArrow(_pack(buckets, length, MOST_IN_SET), _PACKED_DDL)
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_find_marks(MOST_IN_BUCKET, HELD_AT_ONCE), _MARKS_DDL)


def _region_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each region to compare."""
    kinds = {"key": pa.int64(), "region": pa.binary(), "doc_id": pa.int64(), "tag": pa.int64(), "begin": pa.int64()}
    for batch in _few(batches):
        rows: list[tuple] = []
        for doc_id, tag, data, compare in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "data", "compare")), strict=True):
            found = np.frombuffer(b"".join(compare or []), _COMPARE)
            for key, begin, size in zip(found["key"].view(np.int64).tolist(), found["begin"].tolist(), found["size"].tolist(), strict=True):
                rows.append((key, data[begin : begin + size], doc_id, tag, begin))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def suffix_order(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their first ``length`` bytes (equal ones by owner), and the common prefix of each with
    the one before it, up to ``length``."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    codes = np.zeros(len(text), np.uint64)
    for i in range(8):
        codes = codes << np.uint64(8) | padded[i : i + len(text)].astype(np.uint64)
    offsets = [min(8 * i, length - 8) for i in range(-(-length // 8))]
    columns = [codes[starts + o] for o in offsets]
    order = np.lexsort((owner, *columns[::-1]))
    common = np.full(len(order), length, np.int64)
    common[:1] = 0
    open_ = np.arange(1, len(order))
    for offset, column in zip(offsets, columns, strict=True):
        apart = column[order[open_]] ^ column[order[open_ - 1]]
        differ = apart != 0
        # the number of equal bytes in front: float64 keeps the place of the highest bit of the upper half
        high = apart[differ] >> np.uint64(32)
        half = np.where(high != 0, high, apart[differ] & np.uint64(0xFFFFFFFF))
        equal = np.where(high != 0, 0, 4) + (32 - np.frexp(half.astype(np.float64))[1]) // 8
        common[open_[differ]] = offset + equal
        open_ = open_[~differ]
    return order, common


def _nearest_smaller(owner: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The common prefix of each start, in suffix order, with the nearest one before it that has a smaller owner; below
    ``least`` it is only known to be below.

    Pointers jump over owners that are not smaller, together with the least common prefix on the way.
    """
    before, reach = np.arange(-1, len(owner) - 1), common.copy()
    open_ = np.flatnonzero(reach >= least)
    while len(open_ := open_[owner[before[open_]] >= owner[open_]]):
        over = before[open_]
        reach[open_], before[open_] = np.minimum(reach[open_], reach[over]), before[over]
        open_ = open_[reach[open_] >= least]
    return reach


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each start, the longest prefix of its suffix, up to ``length``, that also starts at a smaller owner; values
    below ``length`` are only known to be below."""
    order, common = suffix_order(text, starts, owner, length)
    previous = _nearest_smaller(owner[order], common, length)
    following = np.concatenate([common[1:], [0]])[::-1][: len(order)]
    following = _nearest_smaller(owner[order][::-1], following, length)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(previous, following)
    return out


def _judge(length: int):
    """The stretches of each region whose starts repeat a smaller document."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        doc, tag, place = np.array([r[1:] for r in rows], np.int64).T
        starts_in = sizes - length + 1
        which = np.repeat(np.arange(len(rows)), starts_in)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(starts_in) - starts_in, starts_in)
        starts = (np.cumsum(sizes) - sizes)[which] + offset
        factors = longest_previous_factors(np.frombuffer(b"".join(r[0] for r in rows), np.uint8), starts, doc[which], length)
        hit = factors >= length
        at = place[which[hit]] + offset[hit]
        return _stretch_marks("covered", doc[which[hit]], tag[which[hit]], at, at + length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "region", "doc_id", "tag", "begin")), strict=True):
                if key != last and held >= REGION_BYTES_AT_ONCE:
                    yield judged(rows)
                    rows, held = [], 0
                last = key
                held += len(row[0])
                rows.append(tuple(row))
        if rows:
            yield judged(rows)

    return run


def _hashed_windows(length: int):
    """A row for each run of equal windows (one, as a rule) of the stretches: two halves of the hash, document, first start
    and the start behind the last."""
    names = ["low", "high", "doc_id", "tag", "start", "end"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for few in _few(batches):
            for doc_id, tag, data, windows in zip(*(few.column(c).to_pylist() for c in ("doc_id", "tag", "data", "windows")), strict=True):
                _, begins, ends = _merged(np.zeros(sum(map(len, windows)) // 8, np.int8), *np.frombuffer(b"".join(windows), "<u4").reshape(-1, 2).astype(np.int64).T)
                for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
                    for b in range(a, z - length + 1, WINDOWS_AT_ONCE):
                        starts = range(b, min(b + WINDOWS_AT_ONCE, z - length + 1))
                        halves = np.frombuffer(b"".join([xxh3_128_digest(data[i : i + length]) for i in starts]), np.int64).reshape(-1, 2)
                        first = np.flatnonzero(np.concatenate([[True], (halves[1:] != halves[:-1]).any(axis=1)]))
                        n = len(first)
                        edges = b + np.append(first, len(halves))
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[first, i])) for i in (0, 1)] + [pa.array(x) for x in (np.full(n, doc_id), np.full(n, tag), edges[:-1], edges[1:])], names=names)

    return run


def _window_marks(named: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Marks of the windows hashed whole, by their smallest document, which Spark aggregates before it shuffles."""
    some = found.where("size(windows) > 0").select("doc_id", "tag", "windows")
    windows = materialize(named.join(some, ["doc_id", "tag"]).mapInArrow(_hashed_windows(length), "low long, high long, doc_id long, tag long, start long, end long"), "substring-windows")
    # written, so that a window of very many documents is skewed on one side of the join only, which Spark splits
    least = materialize(windows.groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("low", "high", "least"), "substring-least")
    later = windows.join(least, ["low", "high"]).where("doc_id > least")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, tag, start, end = (batch.column(c).to_numpy() for c in ("doc_id", "tag", "start", "end"))
                yield _stretch_marks("covered", doc, tag, start, end + length - 1)

    out = materialize(later.select("doc_id", "tag", "start", "end").mapInArrow(pack, _MARKS_DDL), "substring-window-marks")
    release(windows, least)
    return out


def _without(data: bytes, packed: list[bytes]) -> tuple[list[bytes], int, int]:
    """The parts of a text that stay, and the number of bytes and of maximal stretches that go."""
    begin, end = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).T
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else begin
    begins, ends = begin[first].tolist(), end[np.concatenate([first[1:] - 1, [len(end) - 1]])].tolist() if len(first) else []
    kept = [data[a:b] for a, b in zip([0, *ends], [*begins, len(data)], strict=True)]
    return kept, sum(ends) - sum(begins), len(begins)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``, kept (the remaining bytes)."""
    if length < 3 * GRAM - 1:
        raise ValueError(f"strings of at least {3 * GRAM - 1} bytes are needed")
    texts = _texts(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = marks(texts, n_bytes, length).groupBy("doc_id", "tag").agg(*(F.collect_list(c).alias(c) for c in _MARKS.names[2:]))
    found = materialize(found, "substring-marks")

    named = texts.where("doc_id is not null")  # the same left side for all joins, so that Spark shuffles the texts once
    compared = named.join(found.select("doc_id", "tag", "compare"), ["doc_id", "tag"], "left").mapInArrow(_region_rows, "key long, region binary, doc_id long, tag long, begin long")
    judged = compared.repartition("key").sortWithinPartitions("key").mapInArrow(_judge(length), _MARKS_DDL)
    if found.where("size(windows) > 0").head(1):
        judged = judged.union(_window_marks(named, found, length))
    judged = judged.groupBy("doc_id", "tag").agg(F.collect_list("covered").alias("judged"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + keep]
        for batch in _few(batches):
            rows = []
            for doc_id, data, covered, judged in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "covered", "judged")), strict=True):
                kept, n_gone, spans = _without(data, [*(covered or []), *(judged or [])])
                sha = hashlib.sha256()
                for part in kept:
                    sha.update(part)
                rows.append((doc_id, len(data), n_gone, spans, sha.hexdigest(), *[b"".join(kept)] * keep))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep])

    joined = named.join(found.select("doc_id", "tag", "covered"), ["doc_id", "tag"], "left").join(judged, ["doc_id", "tag"], "left").select("doc_id", "data", "covered", "judged")
    none = F.lit(None).cast("array<binary>")
    unnamed = texts.where("doc_id is null").select("doc_id", "data", none.alias("covered"), none.alias("judged"))
    return joined.union(unnamed).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
