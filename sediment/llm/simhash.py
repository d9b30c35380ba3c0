"""Operator 2: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a linear code on 64 bits whose dimension grows with the number of different fingerprints. (A
code with mixed weights covers as well as Reed-Muller subcodes of the same size and needs a third of the replicas,
since a point's distances to it are not all even or all odd.) A fingerprint at distance r from its nearest anchor (its home) is replicated to every anchor within r plus the
threshold. Of two fingerprints within the threshold, let x be the one with the smaller r: the other is at most r plus
the threshold from x's home, hence replicated there. So comparing, per anchor, those at home with all replicas finds
every link. (The distance r of the point itself takes the place of the code's covering radius, its upper bound.)

Only different fingerprints take part, so groups of exact copies are one point. An anchor with very many replicas is
dealt out in cells of home block by replica block. Each cell reports a spanning set of its links, never all pairs.

Defined results: null or empty text has no word and fingerprint zero, linked like any other; repeated rows share a
component; a null doc_id is ignored as a component's name unless it is alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, per_slice, release, texts_of
from .components import connected_components

SEED = 42
#: Replicas of an anchor that one cell compares; beyond it the anchor is dealt out.
CELL_ROWS = 200_000
#: Replicas of a point at a slack of four bits, roughly.
TYPICAL_REPLICAS = 50
_COMPARED_AT_ONCE = 1 << 21
_LINKS_AT_ONCE = 1 << 16


def shingle_hashes(text: str, k: int) -> list[int]:
    """XXH64 of each run of ``k`` words, repeats included; fewer words: of all of them."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # for bytes: A-Z only, and the six ASCII blanks
    if not words:
        return []
    if len(words) <= k:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority_bits(hashes: list[int] | np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(values)).tolist())


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The hashes themselves for ``i`` = 0, else mixed again in the ``i``-th way."""
    if not i:
        return hashes
    h = hashes + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def printed(text: str, shingle: int, words: int) -> list[int]:
    """The fingerprint's words of 64 bits: the first of the hashes themselves, the others of the hashes mixed again."""
    hashes = np.array(shingle_hashes(text, shingle), np.uint64)
    return [majority_bits(mixed(hashes, i)) for i in range(words)]


def _names(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id and the fingerprint, 64 bits as a long in each of fp0, fp1, ..."""
    names = _names(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([printed(t, shingle, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).reshape(-1, words)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(words))], names=["doc_id", *names])

    return texts_of(docs).mapInArrow(per_slice(run), ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def linear_code(dimension: int) -> np.ndarray:
    """The words of a linear code on 64 bits with generators drawn once and for all."""
    words = np.zeros(1, np.uint64)
    for generator in np.random.default_rng(5).integers(0, 1 << 64, size=dimension, dtype=np.uint64):
        words = np.concatenate([words, words ^ generator])
    return words


def code_dimension(points: int) -> int:
    """Looking up a point's anchors costs as many comparisons as there are anchors; about as many follow at them."""
    return min(20, max(6, round(math.log2(max(points, 1) * TYPICAL_REPLICAS) / 2)))


def anchors_of(fps: np.ndarray, words: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index in ``fps``, anchor, and whether it is the home, for every anchor within the nearest's distance plus ``slack``."""
    parts = []
    step = max(1, _COMPARED_AT_ONCE // len(words))
    for at in range(0, len(fps), step):
        apart = np.bitwise_count(fps[at : at + step, None] ^ words)
        nearest = apart.argmin(axis=1)
        index, anchor = np.nonzero(apart <= apart[np.arange(len(apart)), nearest, None] + np.uint8(slack))
        parts.append((index + at, anchor, anchor == nearest[index]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))  # type: ignore[return-value]


def halves(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of two linear codes on 32 bits each; their product has 2 ** dimension words, which need no list."""
    low = np.uint64((1 << 32) - 1)
    return linear_code(dimension // 2) & low, linear_code((dimension + 1) // 2) >> np.uint64(32)


def anchors_of_halves(fps: np.ndarray, codes: tuple[np.ndarray, np.ndarray], slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As anchors_of, for the product of two codes: looking up costs the sum of their sizes, not the product."""
    low, parts = np.uint64((1 << 32) - 1), []
    step = max(1, _COMPARED_AT_ONCE // len(codes[1]))
    for at in range(0, len(fps), step):
        some = fps[at : at + step, None]
        apart = [np.bitwise_count(part ^ code) for part, code in zip((some & low, some >> np.uint64(32)), codes, strict=True)]
        nearest = [a.argmin(axis=1) for a in apart]
        first, second = (a - a.min(axis=1)[:, None] for a in apart)
        for over in range(slack + 1):
            i, a = np.nonzero(first == over)
            j, b = np.nonzero(second <= slack - over)
            n = np.bincount(j, minlength=len(some))
            begin = np.cumsum(n) - n
            index = np.repeat(i, n[i])
            nth = np.arange(len(index)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            b = b[begin[index] + nth]
            a = np.repeat(a, n[i])
            parts.append((index + at, a * len(codes[1]) + b, (a == nearest[0][index]) & (b == nearest[1][index])))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))  # type: ignore[return-value]


def spanning_links(home: np.ndarray, points: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of "within ``threshold`` of a point at home"; ``home`` are row numbers of ``points``."""
    label = np.arange(len(points))
    a, b = [], []
    step = max(1, _COMPARED_AT_ONCE // max(1, len(points)))
    for at in range(0, len(home), step):
        own = home[at : at + step]
        apart = np.bitwise_count(points[own, None, 0] ^ points[:, 0]).astype(np.uint16)
        for i in range(1, points.shape[1]):
            apart += np.bitwise_count(points[own, None, i] ^ points[:, i])
        near = apart <= threshold
        for row in np.flatnonzero(near.sum(axis=1) > 1):
            found = np.flatnonzero(near[row])
            labels, first = np.unique(label[found], return_index=True)
            if len(labels) > 1:
                others = found[first][labels != label[own[row]]]
                a.append(np.full(len(others), own[row]))
                b.append(others)
                label[np.isin(label, labels)] = labels[0]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _cells(points: DataFrame, carried: list[str], words: int, anchored: Iterable[int], anchors: Callable[[np.ndarray], tuple], part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Rows of anchor, h, r, home, the carried columns and c0, c1, ...: the words of the fingerprint from the anchor's own on.

    Of the words numbered ``anchored``, and of the anchors those that leave ``part[0]`` modulo ``part[1]``.
    """
    fps, shown = _names(words), [f"c{i}" for i in range(words)]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    ddl = "anchor int, " + "".join(f"{n} {kinds[n]}, " for n in carried) + "".join(f"{n} long, " for n in shown) + "home boolean"

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                few = batch.slice(at, 2048)
                columns = {n: few.column(n).to_numpy(zero_copy_only=False) for n in (*carried, *fps)}
                for i in anchored:
                    index, anchor, home = anchors(columns[fps[i]].view(np.uint64))
                    if part[1] > 1:
                        own = anchor % part[1] == part[0]
                        index, anchor, home = index[own], anchor[own], home[own]
                    rows = {"anchor": (anchor * words + i).astype(np.int32)} | {c: columns[c][index] for c in carried}
                    rows |= {c: columns[fps[(i + k) % words]][index] for k, c in enumerate(shown)} | {"home": home}
                    yield pa.RecordBatch.from_pydict(rows)

    # made twice, once to be counted: that is cheaper than writing them
    replicas = points.select(*carried, *fps).mapInArrow(replicate, ddl)
    # at most (number of replicas / CELL_ROWS) anchors are listed here
    crowded = replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("cells"))
    dealt = replicas.join(crowded, "anchor", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    block = F.pmod(F.xxhash64("name"), F.col("cells")).cast("int")
    cell = lambda h, r, home: F.struct(h.alias("h"), r.alias("r"), home.alias("home"))
    span = F.sequence(F.lit(0), F.col("cells") - 1)
    as_replica = F.transform(span, lambda h: cell(h, block, F.lit(False)))
    as_home = F.transform(span, lambda r: cell(block, r, F.lit(True)))
    spread = F.when(F.col("cells") == 1, F.array(cell(F.lit(0), F.lit(0), F.col("home")))).when(F.col("home"), F.concat(as_replica, as_home)).otherwise(as_replica)
    cells = dealt.select("anchor", *carried, *shown, F.explode(spread).alias("cell")).select("anchor", *carried, *shown, "cell.*")
    return cells.repartition("anchor", "h", "r").sortWithinPartitions("anchor", "h", "r")


def _of_each_cell(cells: DataFrame, links: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> DataFrame:
    """Different links a, b that ``links`` finds in the cells, one cell at a time."""

    def compare(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return links(pd.concat(parts) if len(parts) > 1 else parts[0])

        held: list[pd.DataFrame] = []
        key = None
        for frame in frames:
            keys = frame[["anchor", "h", "r"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found, rows = [], 0
            for begin, end in zip([0, *cuts], [*cuts, len(frame)], strict=True):
                if held and tuple(keys[begin]) != key:
                    for some in of(held):
                        found.append(some)
                        rows += len(some)
                        if rows > _LINKS_AT_ONCE:
                            yield pd.concat(found)
                            found, rows = [], 0
                    held = []
                held.append(frame.iloc[begin:end])
                key = tuple(keys[begin])
            if found:
                yield pd.concat(found)
        if held:
            yield from of(held)

    return cells.mapInPandas(compare, "a long, b long").distinct()


def fingerprint_links(points: DataFrame, threshold: int = 4) -> DataFrame:
    """Spanning links a, b between the names of a written table of different fingerprints (name, fp0)."""

    def links(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        name, first, inverse = np.unique(cell["name"].to_numpy(), return_index=True, return_inverse=True)
        values = cell["c0"].to_numpy().view(np.uint64)[first]
        a, b = spanning_links(np.unique(inverse[cell["home"].to_numpy()]), values[:, None], threshold)
        yield pd.DataFrame({"a": name[a], "b": name[b]})

    code = linear_code(code_dimension(points.count()))
    return _of_each_cell(_cells(points, ["name"], 1, [0], lambda fps: anchors_of(fps, code, threshold)), links)


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fp0 and component_id, the smallest doc_id that links of at most ``threshold`` bits reach; no link is missed."""
    printed_ = materialize(fingerprints(docs, shingle), "simhash-fingerprints")
    points = materialize(printed_.groupBy("fp0").agg(F.min("doc_id").alias("name")), "simhash-points")
    # a row without doc_id has a place in a component only if no row with one has its fingerprint
    roots = connected_components(fingerprint_links(points.where("name is not null"), threshold))
    named = points.join(roots, points["name"] == roots["node"], "left").select("fp0", F.coalesce("root", "name").alias("component_id"))
    return printed_.join(named, "fp0").select("doc_id", "fp0", "component_id")


#: The stage's parameters: texts are alike from a Jaccard similarity of 4/5 of their sets of five-word shingles on. That
#: means a cosine of 0.89 and 15.1 % differing bits: 58 of the 384 of six words, with a deviation of 7; the threshold
#: lies three deviations above. The first half of the words is looked at first, with more room.
STAGE_SHINGLE, STAGE_WORDS, STAGE_THRESHOLD, STAGE_FIRST_THRESHOLD = 5, 6, 80, 48
#: Words whose anchors are looked up; all six are compared there.
STAGE_ANCHORED = 4
#: Up to so many points: dimension of the code, slack, and replicas of a word at its anchors, roughly. The chance that one
#: of the four words of a pair at the limit meets at an anchor is 0.924, 0.981, 0.966 and 0.973 (simulated): it does not
#: fall as the table grows. Together with the shared keys (below) it is over 0.999.
STAGE_CODES = ((1 << 20, 12, 2, 9), (1 << 24, 12, 3, 19), (1 << 26, 14, 3, 26), (1 << 62, 20, 4, 560))
#: Dimensions whose codes are listed; of larger ones, two halves are.
STAGE_LISTED = 14
#: Replicas of a point that are on disk at once: with its fingerprint a replica takes some 80 bytes.
STAGE_ROUND = 40


def stage_code(points: int) -> tuple[int, int, int]:
    return next(code for most, *code in STAGE_CODES if points <= most)


def stage_anchors(points: int) -> Callable[[np.ndarray], tuple]:
    dimension, slack, _ = stage_code(points)
    if dimension <= STAGE_LISTED:
        code = linear_code(dimension)
        return lambda fps: anchors_of(fps, code, slack)
    codes = halves(dimension)
    return lambda fps: anchors_of_halves(fps, codes, slack)


def stage_rounds(points: int) -> list[tuple[list[int], tuple[int, int]]]:
    """The words and the part of the anchors that each round looks at; together all anchors of all words, each once."""
    replicas = stage_code(points)[2]
    if 2 * replicas <= STAGE_ROUND:
        at_once = STAGE_ROUND // replicas
        return [(list(range(i, min(STAGE_ANCHORED, i + at_once))), (0, 1)) for i in range(0, STAGE_ANCHORED, at_once)]
    parts = math.ceil(replicas / STAGE_ROUND)
    return [([i], (p, parts)) for i in range(STAGE_ANCHORED) for p in range(parts)]


def shingle_set(text: str, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text) and text of the rows that have a doc_id."""
    return texts_of(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")


def set_prints(docs: DataFrame) -> DataFrame:
    """doc_id, tag, digest of the shingle set (low, high), its size, fp0, ... of the set, and keys k0, ... that like sets often share."""
    fps, keys = _names(STAGE_WORDS), [f"k{i}" for i in range(STAGE_WORDS)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        rows = np.zeros((batch.num_rows, 3 + 2 * STAGE_WORDS), np.uint64)
        for at, text in enumerate(batch.column("text").to_pylist()):
            hashes = shingle_set(text)
            rows[at, :2], rows[at, 2] = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.uint64), len(hashes)
            if len(hashes):
                mixes = [mixed(hashes, i) for i in range(STAGE_WORDS)]
                rows[at, 3 : 3 + STAGE_WORDS] = [majority_bits(m) for m in mixes]
                least = np.array([m.min() for m in mixes])
                rows[at, 3 + STAGE_WORDS :] = least ^ np.roll(least, 1) * np.uint64(0x9E3779B97F4A7C15)
        parts = (pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(rows.shape[1]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *parts], names=["doc_id", "tag", "low", "high", "size", *fps, *keys])

    return _keyed(docs).mapInArrow(per_slice(run), ", ".join(f"{n} long" for n in ("doc_id", "tag", "low", "high", "size", *fps, *keys)))


def candidate_pairs(points: DataFrame) -> DataFrame:
    """All pairs a, b of names of different labels that meet at an anchor, whose fingerprints differ little and whose
    sizes allow the similarity; written round by round, so that never all replicas are on disk.

    ``points`` is a written table of name, label, size, fp0, ...
    """
    shown = [f"c{i}" for i in range(STAGE_WORDS)]
    half = STAGE_WORDS // 2

    def links(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        name, label, size = (cell[n].to_numpy() for n in ("name", "label", "size"))
        values = np.stack([cell[n].to_numpy().view(np.uint64) for n in shown])
        home = np.flatnonzero(cell["home"].to_numpy())
        step = max(1, _COMPARED_AT_ONCE // max(1, len(name)))
        for at in range(0, len(home), step):
            own = home[at : at + step]
            apart = np.bitwise_count(values[0, own, None] ^ values[0])
            for v in values[1:half]:
                apart += np.bitwise_count(v[own, None] ^ v)
            i, j = np.nonzero(apart <= STAGE_FIRST_THRESHOLD)
            apart = apart[i, j].astype(np.uint16)
            i = own[i]
            for v in values[half:]:
                apart += np.bitwise_count(v[i] ^ v[j])
            found = (apart <= STAGE_THRESHOLD) & (label[i] != label[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
            if found.any():
                one, two = name[i[found]], name[j[found]]
                yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    n = points.count()
    carried, anchors = ["name", "label", "size"], stage_anchors(n)
    rounds = [materialize(_of_each_cell(_cells(points, carried, STAGE_WORDS, words, anchors, part), links), "simhash-round") for words, part in stage_rounds(n)]
    return reduce(DataFrame.union, rounds).distinct()


def alike(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b of point names whose shingle sets have a Jaccard similarity of 4/5 or more, counted exactly; written.

    ``pairs`` is written; ``points`` has name and place, the (doc_id, tag) of a row with the point's text.
    """
    nodes = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(points, "name").select("name", "place.doc_id", "place.tag"), "simhash-wanted")
    texts = _keyed(docs).hint("merge").join(wanted, ["doc_id", "tag"]).select("name", "text")  # merged at every size, so that its costs have no step

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sets, pa.list_(pa.int64()))], names=["name", "hashes"])

    written = materialize(texts.mapInArrow(per_slice(run), "name long, hashes array<long>"), "simhash-sets")
    sets = written.dropDuplicates(["name"])
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    out = materialize(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "simhash-alike")
    release(wanted, written)
    return out


def near_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and tag of the rows that leave, and of those that stay but occur more than once.

    Points are the different shingle sets. Sets that share a key are first compared with the smallest of them, which
    joins most of any large group of near copies in as many steps as it has members. Then all candidate pairs that this
    left apart are compared. Only exactly verified pairs join points.
    """
    prints = materialize(set_prints(docs), "simhash-prints")
    fps, keys = _names(STAGE_WORDS), [f"k{i}" for i in range(STAGE_WORDS)]
    points = prints.groupBy("low", "high").agg(F.min(F.struct("doc_id", "tag")).alias("place"), *(F.first(n).alias(n) for n in ("size", *fps, *keys)))
    points = materialize(points.withColumn("name", F.monotonically_increasing_id()), "simhash-points")
    keyed = points.select("name", F.posexplode(F.array(*keys)).alias("at", "key"))
    least = materialize(keyed.groupBy("at", "key").agg(F.min("name").alias("a"), F.max("name").alias("most")).where("a < most").select("at", "key", "a"), "simhash-least")
    stars = materialize(keyed.join(least, ["at", "key"]).where("a < name").select("a", F.col("name").alias("b")).distinct(), "simhash-stars")
    release(least)
    near = alike(stars, points, docs)
    roots = connected_components(near)
    labelled = points.join(roots, points["name"] == roots["node"], "left").select("name", "size", F.coalesce("root", "name").alias("label"), *fps)
    labelled = materialize(labelled, "simhash-labelled")
    pairs = materialize(candidate_pairs(labelled).join(stars, ["a", "b"], "left_anti"), "simhash-pairs")
    release(labelled, stars)
    more = alike(pairs, points, docs)
    release(pairs)
    roots = connected_components(near.union(more))
    of = points.join(roots, points["name"] == roots["node"], "left").select("low", "high", "place", F.coalesce("root", "name").alias("component"))
    kept = of.groupBy("component").agg(F.min("place").alias("kept"))
    rows = prints.groupBy("doc_id", "tag", "low", "high").agg(F.count("*").alias("n"))
    marked = rows.join(of.select("low", "high", "component"), ["low", "high"]).join(kept, "component")
    marked = marked.withColumn("leaves", F.struct("doc_id", "tag") != F.col("kept")).where("leaves or n > 1")
    marked = materialize(marked.select("doc_id", "tag", "leaves"), "simhash-marked")
    release(prints, points, near, more)
    return marked.where("leaves").select("doc_id", "tag"), marked.where("not leaves").select("doc_id", "tag")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each near-duplicate group: that of the smallest doc_id; null doc_ids stay."""
    doc_id, tag = fresh("_leaving", docs), fresh("_text_tag", docs)
    leaving, repeated = near_rows(docs)
    key = lambda df: df.select(F.col("doc_id").alias(doc_id), F.col("tag").alias(tag))
    same = (docs["doc_id"].cast("long") == F.col(doc_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(tag))
    once = docs.join(key(leaving.union(repeated)), same, "left_anti")
    return once.union(docs.join(key(repeated), same).dropDuplicates([doc_id, tag]).drop(doc_id, tag))
