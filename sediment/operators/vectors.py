"""Vectors: validation, cache joins, incremental embedding, upsert, exact search."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import Embedder
from ..scratch import materialize, release
from ..sources.pacing import Lane, Pace
from .order import batches

#: Rows of a cell and most cells of an index; bytes of the sample that gives their centres; cells each query looks into first.
CELL_ROWS, MOST_CELLS, SAMPLE_BYTES, FIRST_CELLS = 512, 1024, 32 << 20, 2
#: Rows and queries of a block; scores that a task holds at once; room for rounding.
BLOCK_ROWS, SCORES_AT_ONCE, ROOM = 4096, 1 << 21, 2e-6
#: Inputs that are embedded before they are committed: what a failure may cost.
ROUND_ROWS = 4096


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / norm(vector))


def vector_fault(vector: Column, dimensions: int) -> Column:
    """What is wrong with a vector, or null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNull() | (F.size(vector) != dimensions), "wrong_shape").when(~finite, "not_finite").when(norm(vector) <= 0, "zero_norm")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def checked_cache(cache: DataFrame, chunks: DataFrame, dimensions: int) -> DataFrame:
    """The cache, if every entry belongs to a chunk, has its input's hash, occurs once and is a valid vector; else an error naming one."""
    known = chunks.select("cache_key", F.col("input_sha256").alias("expected"))
    joined = cache.join(known, "cache_key", "left")
    fault = F.when(F.col("expected").isNull() | (F.col("expected") != F.col("input_sha256")), "unexpected_input").otherwise(vector_fault(F.col("vector"), dimensions))
    bad = joined.select("cache_key", fault.alias("fault")).where("fault is not null").union(cache.groupBy("cache_key").count().where("count > 1").select("cache_key", F.lit("duplicate")))
    first = bad.head(1)
    if first:
        raise ValueError(f"invalid cache entry {first[0]['cache_key']}: {first[0]['fault']}")
    return cache


def pending(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed(chunks: DataFrame, embedder: Embedder, batch_size: int = 16, pace: Pace | None = None) -> DataFrame:
    """cache_key, input_sha256 and normalized vector; batches are formed inside each task. With a pace, the chunks go
    through its lanes, at one rate for all of them, and refusals (``pacing.Refused``) are waited out."""
    if not 1 <= batch_size <= 100:
        raise ValueError("a batch holds 1 to 100 inputs")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = Lane(pace, TaskContext.get().partitionId()) if pace else None
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                texts = part["embedding_input"].tolist()
                vectors = lane.request(lambda texts=texts: embedder.embed(texts)) if lane else embedder.embed(texts)
                if len(vectors) != len(part):
                    raise ValueError("one vector for each input is expected")
                yield pd.DataFrame({"cache_key": part["cache_key"], "input_sha256": part["input_sha256"], "vector": vectors})

    if pace:
        chunks = chunks.repartition(pace.lanes, "cache_key")
    out = chunks.select("cache_key", "input_sha256", "embedding_input").mapInPandas(run, "cache_key string, input_sha256 string, vector array<float>")
    fault = vector_fault(F.col("vector"), embedder.dimensions)
    checked = F.when(fault.isNull(), normalized(F.col("vector"))).otherwise(F.raise_error(F.concat(F.lit("invalid vector: "), fault)))
    return out.withColumn("vector", checked.cast("array<float>"))


CACHE = "cache_key string, input_sha256 string, vector array<float>"
_LEDGER = "round string, vectors long, fingerprint string"


def _summed(vectors: DataFrame) -> list[Column]:
    """How many vectors, and a sum over all of them that any altered, lost or added one changes."""
    return [F.count("*").alias("vectors"), F.coalesce(F.sum(F.xxhash64("cache_key", "input_sha256", "vector").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint")]


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """cache_key, input_sha256, vector and round of all rounds, which lie in folders of their own."""
    spark.createDataFrame([], CACHE).write.mode("overwrite").parquet(f"{cache_path}/round=none")  # so that there is something to read
    return spark.read.schema(CACHE + ", round string").option("basePath", cache_path).parquet(cache_path)


def add_round(vectors: DataFrame, cache_path: str, name: str) -> int:
    """Write a round, read it back, and note it in the ledger beside the cache; returns its number of vectors.

    A round that was begun before under the same name is written anew.
    """
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{cache_path}/round={name}")
    back = spark.read.schema(CACHE).parquet(f"{cache_path}/round={name}").agg(*_summed(vectors)).first()
    spark.createDataFrame([(name, *back)], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{cache_path}-ledger/{name}")
    return back["vectors"]


def checked_rounds(spark: SparkSession, cache_path: str, chunks: DataFrame, dimensions: int) -> DataFrame:
    """The cache, if every round in the ledger is there as it was noted, and every entry is valid; else an error naming one.

    A round that is not in the ledger was written by a run that ended before noting it: its entries are checked like all.
    """
    cache = read_cache(spark, cache_path)
    spark.createDataFrame([], _LEDGER).write.mode("overwrite").parquet(f"{cache_path}-ledger/none")
    ledger = spark.read.schema(_LEDGER).parquet(f"{cache_path}-ledger/*")
    there = cache.groupBy("round").agg(*_summed(cache)).withColumnsRenamed({"vectors": "n", "fingerprint": "f"})
    wrong = ledger.join(there, "round", "left").where("vectors > 0 and not (vectors <=> n and fingerprint <=> f)").select("round").head(1)
    if wrong:
        raise ValueError(f"checksum of the vectors of round {wrong[0]['round']} differs")
    return checked_cache(cache.drop("round"), chunks, dimensions)


def embed_pending(chunks: DataFrame, embedder: Embedder, cache_path: str, batch_size: int = 16, max_new: int | None = None, round_rows: int = ROUND_ROWS, pace: Pace | None = None) -> dict:
    """Embed what the cache lacks, in rounds of at most ``round_rows`` inputs; returns vectors, expected, complete and rounds.

    Each round is committed, read back and noted before the next begins, so a failure loses one round at most, and a
    repeated run embeds only what no round holds.
    """
    spark = chunks.sparkSession
    cache = checked_rounds(spark, cache_path, chunks, embedder.dimensions)
    todo = pending(chunks, cache)
    if max_new is not None:
        todo = todo.orderBy("lesson_id", "chunk_number").limit(max_new)
    todo = materialize(batches(todo.select("lesson_id", "chunk_number", "cache_key", "input_sha256", "embedding_input"), round_rows, "lesson_id", "chunk_number", "cache_key"), "pending")
    last, run = todo.agg(F.max("batch")).first()[0], uuid.uuid4().hex[:12]
    rounds = 0 if last is None else last + 1
    for n in range(rounds):
        part = todo.where(F.col("batch") == n)
        if add_round(embed(part, embedder, batch_size, pace), cache_path, f"{run}-{n:06d}") != part.count():
            raise ValueError(f"round {n} has not a vector for each of its inputs")
    release(todo)
    have = checked_rounds(spark, cache_path, chunks, embedder.dimensions).count()  # as read back
    expected = chunks.count()
    return {"vectors": have, "expected": expected, "complete": have == expected, "rounds": rounds}


def build_index(chunks: DataFrame, cache: DataFrame, dimensions: int) -> DataFrame:
    """Chunks with their vectors, if none lacks one."""
    checked_cache(cache, chunks, dimensions)
    missing = pending(chunks, cache).select("cache_key").head(1)
    if missing:
        raise ValueError(f"embedding is not complete: {missing[0]['cache_key']} has no vector")
    return chunks.drop("embedding_input").join(cache.select("cache_key", "vector"), "cache_key").drop("cache_key")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, the one of the highest version; partial maxima are taken before the shuffle."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in (key, version)]
    latest = both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("row"))
    return latest.select(key, f"row.{version}", *(f"row.{c}" for c in rest))


@dataclass(frozen=True)
class Cells:
    """An index cut into cells: ``rows`` (parent, child, vector, cell) and, for each cell, its centre, the largest distance
    from it, the largest norm and the number of rows. At most MOST_CELLS cells, so these fit the driver at any size."""

    rows: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    norms: np.ndarray
    counts: np.ndarray


def _matrix(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) and (vectors.null_count or pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(vectors), size)).as_py()):
        raise ValueError("index and query vectors differ in size")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)


def _centres(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Means of a bounded sample; which ones they are decides the work only, never the result."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=cells)
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def cells_of(index: DataFrame, parent: str, child: str, vector: str = "vector", cell_rows: int = CELL_ROWS) -> Cells | None:
    """The cells of an index, written to the shared folder; None if it has no rows."""
    rows = index.select(F.col(parent).alias("parent"), F.col(child).alias("child"), F.col(vector).alias("vector"))
    n, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return None
    cells = int(min(MOST_CELLS, max(1, n // cell_rows)))
    sample = rows.select("vector", F.xxhash64("child").alias("h")).orderBy("h").limit(max(cells, SAMPLE_BYTES // (8 * size)) if cells > 1 else 1).select("vector").toArrow()
    centres = _centres(_matrix(sample.column(0), size), cells)
    known = index.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = known.value
        for batch in batches:
            x = _matrix(batch.column(2), size)
            cell = np.argmin((middle**2).sum(1) - 2 * x @ middle.T, axis=1)
            away = np.sqrt(((x - middle[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x**2).sum(1)))], names=[*batch.schema.names, "cell", "away", "length"])

    kinds = dict(rows.dtypes)
    placed = materialize(rows.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", cell int, away double, length double"), "index-cells")
    reach, norms, counts = np.zeros(cells), np.zeros(cells), np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.max("length").alias("length"), F.count("*").alias("n")).collect():  # a row a cell
        reach[r["cell"]], norms[r["cell"]], counts[r["cell"]] = r["away"], r["length"], r["n"]
    return Cells(placed.drop("away", "length"), centres, reach, norms, counts)


def _probes(cells: Cells, near: bool):
    """Cells that a query looks into: the nearest ones, or all others whose bound reaches its ``floor``.

    No score in a cell exceeds the centre's score and the query's norm times the cell's reach, nor the product of the norms.
    """
    spark = cells.rows.sparkSession
    known = spark.sparkContext.broadcast((cells.centres, cells.reach, cells.norms, cells.counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach, norms, counts = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SCORES_AT_ONCE // len(centres))):
                part = batch.slice(at, max(1, SCORES_AT_ONCE // len(centres)))
                q = _matrix(part.column(1), centres.shape[1])
                size, score = np.sqrt((q**2).sum(1))[:, None], q @ centres.T
                bound = np.where(counts > 0, np.minimum(score + size * reach, size * norms), -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_CELLS]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, True, axis=1)
                floor = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                query, cell = np.nonzero((first if near else ~first & (bound >= floor - ROOM)) & (counts > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(query)), part.column(1).take(pa.array(query)), pa.array(cell.astype(np.int32))], names=["query_id", "query_vector", "cell"])

    return run


def _best_of_block(k: int, size: int, names: list[str]):
    """Children of a block of the index that may be the best of one of a query's best k parents, for a block of queries."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        matrix, queries = _matrix(rows["vector"], size), _matrix(asked["query_vector"], size)
        found: list[list] = [[], [], []]
        if len(matrix) and len(queries):
            codes = rows["parent"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
            step = max(1, SCORES_AT_ONCE // len(matrix))
            for at in range(0, len(queries), step):
                scores = matrix @ queries[at : at + step].T
                best = np.maximum.reduceat(scores[order], begins, axis=0)  # a row for each parent
                least = np.partition(best, -k, axis=0)[-k] if len(best) > k else np.full(scores.shape[1], -np.inf)
                child, query = np.nonzero(scores >= np.maximum(best[codes], least) - ROOM)
                for out, x in zip(found, (query + at, child, scores[child, query]), strict=True):
                    out.append(x)
        query, child, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        return pa.table([asked["query_id"].take(pa.array(query)), rows["parent"].take(pa.array(child)), rows["child"].take(pa.array(child)), pa.array(score.astype(np.float64))], names=names)

    return run


def _scored(cells: Cells, probes: DataFrame, k: int) -> DataFrame:
    """query_id, parent, child, raw of what may count among a query's probed cells.

    Rows and queries of a cell meet in blocks of at most about BLOCK_ROWS each, however many a cell has of either.
    """
    spark, kinds = probes.sparkSession, dict(cells.rows.dtypes)
    parts = [(i, int(-(-n // BLOCK_ROWS))) for i, n in enumerate(cells.counts.tolist()) if n]
    blocks = F.broadcast(spark.createDataFrame(parts, "cell int, row_blocks int"))  # a row a cell
    asked = F.broadcast(probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("query_blocks")))  # a row a cell
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = cells.rows.join(asked, "cell").join(blocks, "cell").select("parent", "child", "vector", "cell", dealt("row_blocks", "child", "parent").alias("rb"), spread("query_blocks").alias("qb"))
    right = probes.join(asked, "cell").join(blocks, "cell").select("query_id", "query_vector", "cell", spread("row_blocks").alias("rb"), dealt("query_blocks", "query_id").alias("qb"))
    names = ["query_id", "parent", "child", "raw"]
    ddl = f"query_id {dict(probes.dtypes)['query_id']}, parent {kinds['parent']}, child {kinds['child']}, raw double"
    key = ("cell", "rb", "qb")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best_of_block(k, cells.centres.shape[1], names), ddl)


def top_parents(index: DataFrame | Cells, queries: DataFrame, k: int, parent: str = "parent", child: str = "child", vector: str = "vector", digits: int = 6) -> DataFrame:
    """query_id, rank, parent, child, score: the k best parents of each query by their best child, exactly.

    ``queries`` (query_id, query_vector) is written once and never passes through the driver. Each query first looks into the
    cells that may hold its best scores, and from what it finds there it knows a score that its k-th parent has at least;
    then into those other cells that may reach that score. Scores are rounded afterwards, so what rounding may tie is kept.
    Ties go to the smaller child, then parent.
    """
    if digits < 6:
        raise ValueError("scores are kept to six digits at least")
    asked = materialize(queries.select("query_id", "query_vector"), "asked")
    cells = index if isinstance(index, Cells) else cells_of(index, parent, child, vector)
    if cells is None:
        kinds = dict(index.dtypes)
        return asked.select("query_id", F.lit(None).cast(kinds[parent]).alias("parent"), F.lit(None).cast(kinds[child]).alias("child"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where("false")
    ddl = f"query_id {dict(asked.dtypes)['query_id']}, query_vector {dict(asked.dtypes)['query_vector']}, cell int"
    none = asked.withColumn("floor", F.lit(0.0))
    near = materialize(none.mapInArrow(_probes(cells, True), ddl), "probes")
    found = first = materialize(_scored(cells, near, k), "scored")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("raw"))
    best = found.groupBy("query_id", "parent").agg(F.max("raw").alias("raw")).withColumn("n", F.row_number().over(by_score))
    floors = best.where(F.col("n") == k).select("query_id", F.col("raw").alias("floor"))
    with_floor = asked.join(floors, "query_id", "left").select("query_id", "query_vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    far = materialize(with_floor.mapInArrow(_probes(cells, False), ddl), "probes")
    found = found.unionByName(_scored(cells, far, k))
    scored = found.withColumn("score", F.round("raw", digits)).drop("raw")
    best = scored.groupBy("query_id", "parent").agg(F.max_by("child", F.struct("score", -F.col("child"))).alias("child"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "child", "parent")
    top = materialize(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top-parents")
    release(asked, near, first, far, *([] if cells is index else [cells.rows]))
    return top


def probed_share(index: Cells, queries: DataFrame, found: DataFrame, k: int) -> float:
    """The share of all pairs of a query and a cell that an exact search looks into, given its result ``found``."""
    floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = queries.join(floors, "query_id", "left").select("query_id", "query_vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    ddl = f"query_id {dict(queries.dtypes)['query_id']}, query_vector {dict(queries.dtypes)['query_vector']}, cell int"
    probes = sum(asked.mapInArrow(_probes(index, near), ddl).count() for near in (True, False))
    return probes / max(1, queries.count() * int((index.counts > 0).sum()))
