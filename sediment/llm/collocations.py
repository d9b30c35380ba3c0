"""Operator 12: phrases whose words occur together more often than their parts would by chance.

Texts are cut into pieces, and equal pieces of a language become one row with its multiplicity. N-grams are counted level
by level: tasks add up the weights of the n-grams in their pieces, a shuffle deals these by hash into buckets, and in each
bucket duckdb adds them up out of core (bounded memory, a file of its own that is gone with the task). A level
only looks at stretches of words all of whose shorter n-grams are frequent, known from a bitmap of their hashes: at
most FILTER_BITS bits, so bounded; a hash too many costs work and changes no count. What a candidate needs of its parts
goes as requests to the bucket where the part's count lies, and the answers are shuffled back by candidate; a word
that a third of all candidates hold is skewed on the requests' side only, which Spark splits at run time.

Defined results: null text is empty text, null lang is ``und``; repeated rows count as often as they occur; a language
without candidates has no rows, nor has an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, power_of_two, release, slices

#: Bytes of pieces that a task counts at once; memory of a bucket's duckdb; bits of the largest bitmap.
PIECES_AT_ONCE, BUCKET_MEMORY, FILTER_BITS = 8 << 20, "256MB", 1 << 29
#: Partial ranks are taken in so many parts of a language before the last.
RANK_PARTS = 64
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MARKS = b".,;:!?\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _MARKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_MARKS) + b" ")
_COUNTS = "lang string, phrase string, f long, hash long"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their different pieces, with how often each occurs in the slice. Only ASCII bytes change."""
    import pyarrow.compute as pc

    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").cast(pa.string())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_TABLE)
            lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)), "\n")
            table = pa.table({"lang": part.column("lang").take(pc.list_parent_indices(lists)), "piece": pc.ascii_trim(lists.flatten(), " ")})
            table = table.filter(pc.greater(pc.binary_length(table["piece"]), 0)).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            for out in table.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([out.column("lang"), out.column("piece"), out.column("count_all")], names=["lang", "piece", "times"])


def pieces_of(docs: DataFrame) -> DataFrame:
    """lang, piece, times: the different pieces of words, blanks at their ends removed."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


class _Words:
    """The words of some pieces as codes, with the piece that each belongs to."""

    def __init__(self, langs: pa.Array, pieces: pa.Array):
        import pyarrow.compute as pc

        lists = pc.split_pattern(pieces, " ")
        flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        some = pc.greater(pc.binary_length(flat), 0)  # blanks in a row
        encoded = flat.filter(some).dictionary_encode()
        self.of, self.codes, self.vocabulary = of[some.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
        lang = langs.dictionary_encode()
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.word_hashes, self.lang_hashes = (pd.util.hash_array(x.to_numpy(zero_copy_only=False).astype(object), categorize=False) for x in (self.vocabulary, lang.dictionary))

    def whole(self, n: int) -> np.ndarray:
        """Places where n words of one piece begin."""
        return np.flatnonzero(self.of[n - 1 :] == self.of[: max(0, len(self.of) - n + 1)]) if len(self.of) >= n else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each place on, and their language."""
        out = self.lang_hashes[self.lang[self.of[at]]]
        for j in range(n):
            out = (out ^ (out >> np.uint64(29))) * _MULTIPLIER + self.word_hashes[self.codes[at + j]]
        return (out ^ (out >> np.uint64(32))) * _MIXER

    def numbered(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different n-gram, and the number of the n-gram at every place."""
        number, first = self.lang[self.of[at]], np.zeros(0, np.int64)
        for j in range(n):
            _, first, number = np.unique(number * len(self.vocabulary) + self.codes[at + j], return_index=True, return_inverse=True)
        return at[first], number

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        import pyarrow.compute as pc

        return pc.binary_join_element_wise(*(self.vocabulary.take(pa.array(self.codes[at + j])) for j in range(n)), " ")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, up to PIECES_AT_ONCE; a longer piece alone."""
    held, total = [], 0
    for batch in batches:
        if held and total + batch.nbytes > PIECES_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words_of(table: pa.Table) -> tuple[_Words, np.ndarray]:
    lang, piece = (table[c].combine_chunks().cast(pa.string()) for c in ("lang", "piece"))
    return _Words(lang, piece), table["times"].to_numpy()


def _weighed(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Different n-grams of a task's pieces with their weights; for words also the total of each language, as ''."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            words, times = _words_of(table)
            at = words.whole(n)
            first, number = words.numbered(at, n)
            weight = np.zeros(len(first), np.int64)
            np.add.at(weight, number, times[words.of[at]])
            lang = table["lang"].combine_chunks().take(pa.array(words.of[first]))
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), words.phrases(first, n), pa.array(weight)], names=["lang", "phrase", "f"])
            if n == 1:
                per = pa.table({"lang": table["lang"].take(pa.array(words.of)), "f": times[words.of]}).group_by("lang").aggregate([("f", "sum")]).combine_chunks()
                for out in per.to_batches():
                    yield pa.RecordBatch.from_arrays([out.column("lang").cast(pa.string()), pa.array([""] * out.num_rows), out.column("f_sum")], names=["lang", "phrase", "f"])

    return run


def _added_up(n: int, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n-grams of a bucket with ``least`` occurrences, added up by duckdb in a file of this task's own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as own:
            settings = {"memory_limit": BUCKET_MEMORY, "threads": "1", "temp_directory": own, "preserve_insertion_order": "false"}
            with duckdb.connect(f"{own}/bucket.db", config=settings) as db:
                db.execute("CREATE TABLE parts (lang VARCHAR, phrase VARCHAR, f BIGINT)")
                for held in _gathered(batches):
                    db.register("held", held)
                    db.execute("INSERT INTO parts SELECT lang, phrase, f FROM held")
                    db.unregister("held")
                totals = f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(f) >= {int(least)} OR phrase = ''"
                for out in db.sql(totals).to_arrow_reader(1 << 16):
                    words = _Words(out.column("lang"), out.column("phrase"))
                    hashes = np.zeros(out.num_rows, np.uint64)  # of a total: never looked up
                    at = words.whole(n)
                    hashes[words.of[at]] = words.hashes(at, n)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hashes.view(np.int64))], names=["lang", "phrase", "f", "hash"])

    return run


def frequent(pieces: DataFrame, n: int, least: int) -> DataFrame:
    """lang, phrase, f and hash of all n-grams with ``least`` occurrences; for n = 1 also each language's total, as ''."""
    weighed = pieces.mapInArrow(_weighed(n), "lang string, phrase string, f long")
    return weighed.repartition("lang", "phrase").mapInArrow(_added_up(n, least), _COUNTS)


def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each n-gram; built in parts of 4 KB by Spark, at most FILTER_BITS / 8 bytes in all."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    parts = found.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((max(1, bits >> 15), 4096), np.uint8)
    for row in parts.collect():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def stretches(pieces: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The longest runs of words, n + 1 at least, all of whose n-grams may be frequent; equal ones as one row again."""
    spark = pieces.sparkSession
    bits = min(FILTER_BITS, max(1 << 15, power_of_two(16 * found.count())))
    known = spark.sparkContext.broadcast(_bitmap(found, bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        bitmap, ones = known.value, np.uint64(bits - 1)
        for table in _gathered(batches):
            words, times = _words_of(table)
            at = words.whole(n)
            place = words.hashes(at, n) & ones
            at = at[bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
            # n-grams follow each other in a run if they begin at neighbouring words of a piece
            new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (words.of[at] != words.of[at - 1])) if len(at) else at
            size = np.diff(new, append=len(at)) + n - 1
            first, size = at[new][size > n], size[size > n]
            ends = np.cumsum(size)
            inside = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words.vocabulary.take(pa.array(words.codes[inside])))
            of = words.of[first]
            yield pa.RecordBatch.from_arrays([table["lang"].combine_chunks().take(pa.array(of)).cast(pa.string()), pc.binary_join(lists, " "), pa.array(times[of])], names=["lang", "piece", "times"])

    return pieces.mapInArrow(run, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def phrase_counts(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, words and f of all phrases of up to ``longest`` words with ``least`` occurrences; words = 0: all words."""
    pieces, levels = materialize(pieces_of(docs), "collocation-pieces"), []
    for n in range(1, longest + 1):
        found = materialize(frequent(pieces, n, least), f"collocation-{n}")
        levels.append(found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(n).alias("words"), "f"))
        if n < longest:
            shorter = materialize(stretches(pieces, found.where("phrase <> ''"), n), "collocation-pieces")
            release(pieces)
            pieces = shorter
    release(pieces)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language by the score of their weakest cut.

    A candidate inside a longer one that occurs in ``absorbed`` percent of the candidate's places is left out. A score is
    floor(1000 * a * n / (l * r)) in decimals of 38 digits, which hold 1000 * a * n up to 10 ** 17 words.
    """
    counts = materialize(phrase_counts(docs, least, longest), "collocation-counts")
    candidates = counts.where("words >= 2")
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _joined(words, F.lit(1), k).alias("first"), _joined(words, k + 1, F.col("words") - k).alias("rest")))
    asked = candidates.select("lang", "phrase", F.explode(cuts).alias("c")).select("lang", "phrase", F.explode(F.array(F.struct("c.k", F.lit("l").alias("side"), F.col("c.first").alias("part")), F.struct("c.k", F.lit("r").alias("side"), F.col("c.rest").alias("part")))).alias("q"))
    # every part of a frequent phrase is frequent, so each request is answered
    held = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    answers = asked.select("lang", "phrase", "q.*").join(held, ["lang", "part"])
    parts = answers.groupBy("lang", "phrase", "k").agg(F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"))
    totals = materialize(counts.where("words = 0").select("lang", F.col("f").alias("n")), "collocation-totals")  # a row a language

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _joined(words, i, m))))
    holders = candidates.where("words >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("f").alias("holder_f")).groupBy("lang", "phrase").agg(F.max("holder_f").alias("holder_f"))
    kept = candidates.join(holders, ["lang", "phrase"], "left").where(f"holder_f is null or 100 * holder_f < {absorbed} * f").select("lang", "phrase", F.col("f").alias("a"))
    score = F.expr("(cast(1000 * cast(a as decimal(38,0)) * n as decimal(38,0))) div (cast(l as decimal(38,0)) * r)")
    cut = kept.join(parts, ["lang", "phrase"]).join(totals, "lang")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.score", "w.a", "w.l", "w.r", "w.n")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    best = weakest.withColumn("_some", F.row_number().over(some)).where(F.col("_some") <= top).drop("_some")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
