"""A stored index: points by id, what it is made of, and runs that end in the middle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sediment.contracts import ChunkConfig, HashedWordEmbedder
from sediment.operators import stored_index, vectors
from sediment.plans import corpus


def _points(spark, rows):
    return spark.createDataFrame([(i, run, [float(x), 1.0]) for i, run, x in rows], "id string, run string, vector array<float>")


def _rows(df):
    return sorted((r["id"], r["run"], r["vector"][0]) for r in df.collect())


def _files(spark, root):
    return {r["f"] for r in spark.read.parquet(f"{root}/points").select(F.input_file_name().alias("f")).distinct().collect()}


def test_points_replace_those_of_their_id(spark, tmp_path):
    root = str(tmp_path / "index")
    first = [(f"p{i}", "a", i) for i in range(200)]
    assert stored_index.upsert(_points(spark, first), root, 2, buckets=8) == {"points": 200, "added": 200, "replaced": 0}
    before = _files(spark, root)
    assert stored_index.upsert(_points(spark, [("p7", "b", 70), ("new", "b", 1)]), root, 2) == {"points": 201, "added": 1, "replaced": 1}
    assert _rows(stored_index.opened(spark, root, 2)) == sorted([p for p in first if p[0] != "p7"] + [("p7", "b", 70), ("new", "b", 1)])
    assert len(before) == 8 and len(before & _files(spark, root)) >= 6  # buckets that nothing fell into are as they were
    now = _files(spark, root)
    assert stored_index.upsert(_points(spark, [("p7", "c", 1), ("new", "c", 1)]), root, 2, only_new=True) == {"points": 201, "added": 0, "replaced": 0} and _files(spark, root) == now
    assert stored_index.upsert(_points(spark, []), root, 2) == {"points": 201, "added": 0, "replaced": 0}


def test_faults_are_named_and_nothing_is_written(spark, tmp_path):
    root = str(tmp_path / "index")
    stored_index.upsert(_points(spark, [("p", "a", 1)]), root, 2)
    bad = {"twice": [("x", "b", 1), ("x", "b", 2)], "null_id": [(None, "b", 1)], "not_finite": [("y", "b", float("nan"))]}
    for fault, rows in bad.items():
        with pytest.raises(ValueError, match=fault):
            stored_index.upsert(_points(spark, [("p", "b", 5), *rows]), root, 2)
    with pytest.raises(ValueError, match="wrong_shape"):
        stored_index.upsert(spark.createDataFrame([("z", "b", [1.0])], "id string, run string, vector array<float>"), root, 2)
    assert _rows(stored_index.opened(spark, root, 2)) == [("p", "a", 1)]


def test_an_index_of_something_else_is_an_error(spark, tmp_path):
    root, points = str(tmp_path / "index"), _points(spark, [("p", "a", 1)])
    with pytest.raises(ValueError, match="no index"):
        stored_index.opened(spark, root, 2)
    stored_index.upsert(points, root, 2, facts={"dataset": "d", "sizes": (1, 2)})
    stored_index.upsert(points, root, 2, facts={"dataset": "d", "sizes": (1, 2)})
    for change, named in (({"dimensions": 3}, "dimensions"), ({"distance": "dot"}, "distance"), ({"facts": {"dataset": "e", "sizes": (1, 2)}}, "dataset"), ({"facts": None}, "dataset")):
        given = {"dimensions": 2, "distance": "cosine", "facts": {"dataset": "d", "sizes": (1, 2)}} | change
        with pytest.raises(ValueError, match=named):
            stored_index.upsert(points, root, **given)
        with pytest.raises(ValueError, match=named):
            stored_index.opened(spark, root, **given)


def test_a_run_that_ends_in_the_middle_is_completed_by_the_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    first = [(f"p{i}", "a", i) for i in range(40)]
    stored_index.upsert(_points(spark, first), root, 2, buckets=4)

    def stopped(*_):
        if stored_index._status(spark, root)["done"]:
            return
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(stored_index, "_complete", stopped)
        with pytest.raises(RuntimeError):
            stored_index.upsert(_points(spark, [("p3", "b", 30), ("q", "b", 1)]), root, 2)
    with pytest.raises(ValueError, match="not complete"):
        stored_index.opened(spark, root, 2)
    assert stored_index.upsert(_points(spark, [("r", "c", 1)]), root, 2) == {"points": 42, "added": 1, "replaced": 0}
    assert _rows(stored_index.opened(spark, root, 2)) == sorted([p for p in first if p[0] != "p3"] + [("p3", "b", 30), ("q", "b", 1), ("r", "c", 1)])


def test_search_of_a_stored_index(spark, tmp_path):
    root, embedder, config = str(tmp_path / "index"), HashedWordEmbedder(64), ChunkConfig(dimensions=64)
    texts = spark.createDataFrame([("a", "1", "pumps leak at night"), ("b", "2", "valves freeze in winter")], "cache_key string, lesson_id string, embedding_input string").withColumn("input_sha256", F.lit(""))
    points = texts.join(vectors.embed(texts, embedder).select("cache_key", "vector"), "cache_key").select(F.col("cache_key").alias("id"), "lesson_id", "vector")
    stored_index.upsert(points, root, 64, facts={"dataset": "d", "configuration": config.as_dict()})
    questions = spark.createDataFrame([("q", "pumps leak at night")], "query_id string, question string")
    assert [r["parent"] for r in corpus.search_stored(spark, root, questions, embedder, config, "d", 1).collect()] == ["1"]
    with pytest.raises(ValueError, match="dataset"):
        corpus.search_stored(spark, root, questions, embedder, config, "e", 1)


def test_questions_are_checked_as_they_are_embedded(spark):
    embedder, config = HashedWordEmbedder(64), ChunkConfig(dimensions=64)
    points = spark.createDataFrame([("a", "1", [1.0] * 64)], "id string, lesson_id string, vector array<float>")
    ask = lambda *texts: corpus.search(points, spark.createDataFrame(list(enumerate(texts)), "query_id int, question string"), embedder, config, 1)
    room = 20_000 - len(config.query_prefix)
    assert ask("\u00a0 pump \n", "x" * room, " " + "x" * room + "\t").count() == 3
    for bad in (None, "", "\u00a0\n ", "x" * (room + 1), "\u00e9" * (room // 2 + 1)):
        with pytest.raises(ValueError, match="20,000 bytes"):
            ask("pump", bad)
