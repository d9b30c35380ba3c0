"""A JSON value read in byte ranges gives what reading it whole gives."""

from __future__ import annotations

import json
import random

import pytest

from sediment.sources import readers, split_json


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("150", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _response(rng: random.Random, n: int) -> dict:
    odd = ["{", "}", "[", "]", '"', "\\", ",", ":", "hits", "é𝄞", "\n", '{"hits": [', "plain"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    value = lambda d: rng.choice([text(), 1.5, None, True, {text(): text()}, {"hits": {"hits": [{"a": {}}]}}, [{"hits": [{}, []]}, text()], "x" * rng.randrange(400)]) if d else text()
    hits = [{"_id": str(i), "_source": {"a" + text(): value(1), "n": i, "hits": value(1)}} for i in range(n)]
    return {"took": 3, "_shards": {"total": 1, "successful": 1, "failed": 0, "failures": [{"hits": [{"no": "hit"}]}]}, "hits": {"hits" if rng.random() < 0 else "total": {"value": n, "relation": "eq"}, "max": {"hits": [{}]}, "hits": hits}, "timed_out": False}


@pytest.mark.parametrize(("seed", "indent", "ascii_only"), [(1, None, True), (2, 3, False), (3, None, False)])
def test_ranges_equal_the_whole(spark, tmp_path, small_ranges, seed, indent, ascii_only):
    response = _response(random.Random(seed), 60)
    path = tmp_path / "response.json"
    path.write_text(json.dumps(response, indent=indent, ensure_ascii=ascii_only))
    rest, objects = split_json.read_array(spark, str(path))
    found = {r["idx"]: json.loads(r["json"]) for r in objects.collect()}
    assert found == dict(enumerate(response["hits"]["hits"]))
    assert json.loads(rest) == response | {"hits": response["hits"] | {"hits": []}}
    assert split_json._fragments(spark, str(path)).rdd.getNumPartitions() > 3
    hits = readers.read_hits(spark, str(path), 60)
    assert {r["doc_id"] for r in hits.select("doc_id").collect()} == {str(i) for i in range(60)}


@pytest.mark.parametrize("text", ['{"hits": {"hits": [{"a": 1}', '{"hits": {"hits": [{"a": 1]}}}', '{"hits": {"hits": [{"a": "1}]}}', '{"hits": {}}}', ""])
def test_broken_values_are_refused(spark, tmp_path, small_ranges, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON value"):
        split_json.read_array(spark, str(tmp_path / "bad.json"))


def test_hits_that_are_no_objects_are_refused(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"timed_out": false, "_shards": {"failed": 0}, "hits": {"total": 2, "hits": [{"_id": "1", "_source": {"a": 1}}, 7]}}')
    with pytest.raises(ValueError, match="no object"):
        readers.read_hits(spark, str(tmp_path / "r.json"))
    (tmp_path / "empty.json").write_text('{"hits": {"total": 0, "hits": []}}')
    with pytest.raises(ValueError, match="complete and exact"):
        readers.read_hits(spark, str(tmp_path / "empty.json"))
