"""Rules of the corpus operators on small fixtures."""

from __future__ import annotations

import json
import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sediment import scratch
from sediment.contracts import Answer, ChunkConfig, HashedWordEmbedder
from sediment.functions import text as T
from sediment.operators import chunking, evaluate, order, quality, vectors
from sediment.operators.normalize import normalize
from sediment.plans import corpus
from sediment.sources import readers, sinks
from sediment.streaming.embedding import embed_new_chunks

BASE = "https://example.org/"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests on their path


def _hit(number, **fields):
    source = {"lesson_number": number, "title": "A title", "lesson_date": "2001-01-02", "lessonDate": "Tue Jan 02 00:00:00 GMT 2001"} | fields
    return {"_id": str(number), "_source": source}


def _response(path, hits, **more):
    path.write_text(json.dumps({"timed_out": False, "_shards": {"total": 1, "successful": 1, "failed": 0}, "hits": {"total": {"value": len(hits), "relation": "eq"}, "hits": hits}} | more))
    return str(path)


def test_text_rules(spark):
    row = spark.createDataFrame([(" a  b \r\n\r\n\r\n\r\nc ", "quota", "Same as in  Lesson Learned.")], "a string, b string, c string").select(T.tidy(F.col("a")), T.broken_quote(F.col("b")), T.is_reference_only(F.col("c"))).first()
    assert tuple(row) == ("a b\n\nc", True, True)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    hits = [
        _hit(1, title="None", lesson="<p>A</p>", lesson_learned="A"),
        _hit(2, drivingEvent=None, description_event="Recovered", lesson="x"),
        _hit(3, lesson="First", lesson_learned="Second", other=7, documentUrl0="/f.pdf"),
        _hit(4, lessonDate="Wed Jan 03 00:00:00 GMT 2001", lesson="<p>A</p>"),
        _hit(5, lesson="<img src='/i.jpg'>", lessonDate="2001-01-02 16:56:38.056"),
        {"_id": "q", "_source": {"query": {}}},
        _hit(True),
    ]
    path = _response(tmp_path_factory.mktemp("raw") / "r.json", hits)
    return normalize(readers.read_hits(spark, path), BASE)


def test_normalize(made):
    rows = {r["lesson_id"]: r for r in made.lessons.collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5"] and made.quarantine.count() == 2
    assert rows["1"]["display_title"] == "Record 1" and rows["1"]["display_title_generated"]
    assert rows["2"]["sections"]["driving_event"]["source"]["field"] == "description_event"
    variant = made.variants.collect()
    assert [(v["lesson_id"], v["selected"]["text"], v["alternate"]["text"]) for v in variant] == [("3", "First", "Second")]
    assert json.loads(rows["3"]["metadata_raw"])["other"] == 7 and len(rows["3"]["attachments"]) == 1
    assert rows["4"]["lesson_date"] == "2001-01-02" and "date_field_variant" in rows["4"]["quality_flags"]
    assert "same_body_text_as_other_lesson" in rows["4"]["quality_flags"] and "same_body_text_as_other_lesson" in rows["1"]["quality_flags"]
    assert not rows["5"]["has_core_body_text"] and "unparsed_display_date" not in rows["5"]["quality_flags"]


def test_duplicates_and_bad_responses(spark, tmp_path):
    hits = [_hit(1), _hit(1) | {"_id": "2"}]
    with pytest.raises(ValueError):
        normalize(readers.read_hits(spark, _response(tmp_path / "a.json", hits)), BASE)
    with pytest.raises(ValueError):
        readers.read_hits(spark, _response(tmp_path / "b.json", [_hit(1)], timed_out=True))
    with pytest.raises(ValueError):
        readers.verify_file(spark, str(tmp_path / "a.json"), 1, "x")
    with pytest.raises(ValueError):
        sinks.guard_outside("/raw/x", "/raw")


def _record(spark, lesson_id, **texts):
    names = ["abstract", "driving_event", "lesson", "recommendation", "evidence", "related_policy"]
    cols = ", ".join(f"{n}:struct<text:string>" for n in names)
    schema = f"lesson_id string, title struct<text:string>, display_title string, text_extraction_succeeded boolean, has_core_body_text boolean, sections struct<{cols}>, quality_flags array<string>, lesson_date string, source struct<public_lesson_url:string>"
    return spark.createDataFrame([(lesson_id, ("T",), "T", True, True, tuple((texts.get(n),) for n in names), [], None, ("u",))], schema)


def test_chunks_are_lossless_and_within_budget(spark):
    long, config = " ".join(f"term{i}." for i in range(600)), ChunkConfig(max_words=70, max_input_bytes=1000)
    table = "[Table 1]\n" + "\n".join(f"{i} | x" for i in range(10)) + "\n[End table 1]"
    lessons = _record(spark, "1", lesson=long, evidence=f"Before.\n\n{table}\n\nAfter.", recommendation="See lesson learned.")
    chunks = chunking.plan_chunks(lessons, "a", config)
    chunking.check_plan(chunks, config)
    rows = sorted(chunks.collect(), key=lambda r: r["chunk_number"])
    covered = " ".join(long[s["start"] : s["end"]] for r in rows for s in r["spans"] if s["section"] == "lesson")
    assert covered.split() == long.split() and any(table in r["text"] for r in rows) and rows[0]["omitted_reference_sections"] == ["recommendation"]
    assert "See lesson learned." in evaluate.contexts(lessons).first()["text"]
    whole = chunking.plan_chunks(_record(spark, "2", lesson="short"), "a").collect()
    assert len(whole) == 1 and whole[0]["whole_lesson"]
    ids = {tuple(r["id"] for r in chunking.plan_chunks(_record(spark, "2", lesson="short"), d, c).collect()) for d, c in (("a", ChunkConfig()), ("b", ChunkConfig()), ("a", ChunkConfig(max_words=1000)))}
    assert len(ids) == 3
    with pytest.raises(ValueError):
        ChunkConfig(max_words=3)


def test_index_search_evaluate(spark, tmp_path):
    lessons = _record(spark, "1", lesson="pumps leak at night").union(_record(spark, "2", lesson="valves freeze in winter"))
    config, embedder = ChunkConfig(), HashedWordEmbedder(256)
    chunks = chunking.plan_chunks(lessons, "d", config)
    assert vectors.embed_pending(chunks, embedder, str(tmp_path / "c"), max_new=1) == {"vectors": 1, "expected": 2, "complete": False, "rounds": 1}
    with pytest.raises(ValueError):
        vectors.build_index(chunks, spark.read.parquet(str(tmp_path / "c")), 256)
    assert vectors.embed_pending(chunks, embedder, str(tmp_path / "c"))["complete"]
    points = vectors.build_index(chunks, spark.read.parquet(str(tmp_path / "c")), 256)
    cases = spark.createDataFrame([("q1", "pumps leak", ["1"]), ("q2", "valves winter", ["2"]), ("q3", "pumps", ["9"])], "query_id string, question string, expected_ids array<string>")
    assert tuple(corpus.evaluated(points, cases, embedder, config).first()) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    found = corpus.search(points, cases, embedder, config).join(cases.select("query_id", "question"), "query_id")
    assert json.loads(evaluate.prompts(found, evaluate.contexts(lessons)).first()["payload"])["source_records"]
    with pytest.raises(ValueError):
        corpus.search(points, cases, embedder, config, k=21)
    bad = spark.read.parquet(str(tmp_path / "c")).withColumn("vector", F.transform("vector", lambda x: x * 0))
    with pytest.raises(ValueError, match="zero_norm"):
        vectors.checked_cache(bad, chunks, 256)
    chunks.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        embed_new_chunks(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "ck"), embedder)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert sinks.write_run(chunks, str(tmp_path / "runs"), {"a": 1}) == sinks.write_run(chunks, str(tmp_path / "runs"), {"a": 1})


def test_metrics_without_cases(spark):
    ranks = spark.createDataFrame([], "query_id string, first_relevant_rank int")
    assert tuple(evaluate.metrics(ranks).first()) == (0, None, None)


def _snapshot(spark, tmp_path, hits):
    text = json.dumps({"timed_out": False, "_shards": {"total": 1, "successful": 1, "failed": 0}, "hits": {"total": {"value": len(hits), "relation": "eq"}, "hits": hits}})
    counts = iter([len(hits)] * 2)
    found, n = readers.consistent(lambda: next(counts), lambda _: text)
    folder = str(tmp_path / "snapshot")
    sinks.write_snapshot(spark, found, n, folder, "2001-01-02T00:00:00Z", ["lesson"])
    return folder


def test_snapshot_is_verified_in_every_layer(spark, tmp_path):
    folder = _snapshot(spark, tmp_path, [_hit(1, lesson="x"), _hit(2, lesson="y")])
    manifest, hits = readers.load_snapshot(spark, folder)
    assert manifest["record_count"] == 2 and hits.count() == 2
    with pytest.raises(Exception, match="exist"):
        _snapshot(spark, tmp_path, [_hit(1)])
    facts = manifest["files"].asDict(recursive=True)
    for layer, key, value in (("compressed", "bytes", 1), ("compressed", "sha256", "0"), ("uncompressed", "bytes", 1), ("uncompressed", "sha256", "0")):
        wrong = facts | {layer: facts[layer] | {key: value}}
        sinks.write_json(spark, {"record_count": 2, "files": wrong}, f"{folder}/manifest.json")
        with pytest.raises(ValueError, match="mismatch"):
            readers.load_snapshot(spark, folder)
    sinks.write_json(spark, {"record_count": 3, "files": facts}, f"{folder}/manifest.json")
    with pytest.raises(ValueError, match="agree"):
        readers.load_snapshot(spark, folder)


def test_sources_that_change_or_are_hollow_are_refused(spark, tmp_path):
    counts = iter([5, 6])
    with pytest.raises(ValueError, match="changed"):
        readers.consistent(lambda: next(counts), lambda _: "")
    with pytest.raises(ValueError):
        readers.consistent(lambda: 10_001, lambda _: "")
    for source in ({}, None, 5):
        with pytest.raises(ValueError, match="sources"):
            readers.read_hits(spark, _response(tmp_path / "h.json", [_hit(1), {"_id": "2", "_source": source}]))


def test_ingest_writes_products_manifest_and_report(spark, tmp_path):
    folder, out = _snapshot(spark, tmp_path, [_hit(1, lesson="a", lesson_learned="b"), _hit(2), {"_id": "q", "_source": {"query": 1}}]), str(tmp_path / "out")
    made = corpus.ingest(spark, folder, out, BASE)
    facts = json.loads("\n".join(r["value"] for r in spark.read.text(f"{out}/manifest").collect()))
    assert made.lessons.count() == 2 and facts["products"]["lessons"]["records"] == 2 and facts["products"]["quarantine"]["records"] == 1
    assert facts["statistics"]["input_hits"] == 3 and facts["statistics"]["field_variant lesson"] == 1 and facts["statistics"]["missing_section lesson"] == 1
    assert "query" in facts["source_fields"] and "| input_hits | 3 |" in "\n".join(r["value"] for r in spark.read.text(f"{out}/report").collect())
    fields = facts["statistics"]["fields lesson"]
    assert fields["records"] == 2 and fields["both_fields_present"] == fields["different_nonempty_variants"] == 1
    with pytest.raises(ValueError, match="protected"):
        corpus.ingest(spark, folder, f"{folder}/../snapshot/x", BASE, protected=folder)
    (tmp_path / "link").symlink_to(folder)
    with pytest.raises(ValueError, match="protected"):
        sinks.guard_outside(str(tmp_path / "link" / "x"), folder)


def test_canonical_lines_and_redaction(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([("é", None, 1)], "b string, c string, a int"), str(tmp_path / "j"), canonical=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1,"b":"é","c":null}']
    row = spark.createDataFrame([("the key s3cret failed " + "x" * 900,)], "m string").select(sinks.redacted(F.col("m"), "s3cret").alias("m")).first()
    assert "s3cret" not in row["m"] and "[removed]" in row["m"] and len(row["m"]) == 600


def test_index_run_steps_and_answers(spark, tmp_path):
    class Echo:
        def generate(self, prompts):
            return [json.loads(p)["question"].upper() for p in prompts]

    lessons = _record(spark, "1", lesson="pumps leak at night").union(_record(spark, "2", lesson="valves freeze in winter"))
    config, embedder = ChunkConfig(), HashedWordEmbedder(256)
    points = corpus.index(lessons, str(tmp_path / "runs"), "d", embedder, config)
    assert points.count() == 2 and corpus.index(lessons, str(tmp_path / "runs"), "d", embedder, config).count() == 2
    cases = readers.checked_cases(spark.createDataFrame([("q1", "pumps leak", ["1"]), ("q2", "valves winter", ["1"])], "query_id string, question string, expected_ids array<string>"), lessons)
    once = corpus.evaluated(points, cases, embedder, config)
    steps = [corpus.evaluated_in_steps(points, cases, embedder, config, str(tmp_path / "e"), at_once=1) for _ in range(2)]
    assert [tuple(s.first()) for s in steps] == [tuple(once.first())] * 2 and '"complete": true' in "".join(r["value"] for r in spark.read.text(str(tmp_path / "e/report")).collect())
    with pytest.raises(ValueError, match="unknown record 9"):
        readers.checked_cases(spark.createDataFrame([("q", ["1", "9"])], "query_id string, expected_ids array<string>"), lessons)
    with pytest.raises(ValueError, match="dimensions"):
        corpus.search(points, cases, HashedWordEmbedder(64), config)
    said = {r["query_id"]: (r["answer"], r["source_ids"][0]) for r in corpus.answers(points, lessons, cases, embedder, Echo(), config).collect()}
    assert said == {"q1": ("PUMPS LEAK", "1"), "q2": ("VALVES WINTER", "2")}


def test_longest_prefixes_equal_trying_each(spark):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "é", "漢", "😀", " ", "  ", "\n", ". ", "\xa0"]) for _ in range(rng.randrange(1, 60)))
        begin, words, size = rng.randrange(len(text)), rng.randrange(0, 9), rng.randrange(0, 40)
        fits = [n for n in range(len(text) - begin + 1) if len(text[begin : begin + n].split()) <= words and len(text[begin : begin + n].encode()) <= size]
        assert chunking.longest_prefix(text, begin, len(text), words, size) == max(fits), (text, begin, words, size)


def _best_parents(vec, asked, parents, k):
    expected = set()
    for q, a in enumerate(asked):
        best: dict = {}
        for i, v in enumerate(vec):
            best.setdefault(parents[i], []).append((-round(float(v @ a), 6), i))
        expected |= {(q, p, c, -s, n + 1) for n, (s, c, p) in enumerate(sorted((*min(rows), p) for p, rows in best.items())[:k])}
    return expected


def _vectors(spark, vec, parents, asked):
    index = spark.createDataFrame([(parents[i], i, [float(x) for x in v]) for i, v in enumerate(vec)], "parent int, child int, vector array<double>").repartition(3)
    return index, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id int, query_vector array<double>")


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(512, 4096), (20, 7)])
def test_search_equals_brute_force(spark, monkeypatch, cell_rows, block_rows):
    """Ties after rounding, several cells, several blocks of rows and queries in a cell."""
    rng = np.random.default_rng(2)
    vec, asked = np.round(rng.normal(size=(300, 5)), 1), np.round(rng.normal(size=(30, 5)), 1)
    vec[200:] = vec[200]  # a third of all rows are one vector
    parents = [i % 17 for i in range(300)]
    index, queries = _vectors(spark, vec, parents, asked)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    found = vectors.top_parents(vectors.cells_of(index, "parent", "child", cell_rows=cell_rows), queries, 4)
    assert {(r["query_id"], r["parent"], r["child"], r["score"], r["rank"]) for r in found.collect()} == _best_parents(vec, asked, parents, 4)


def test_search_skips_cells_that_can_not_matter(spark):
    """Of clustered vectors most cells are never looked into, and the result stays that of brute force; few parents, too."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 16)) * 3
    vec = np.concatenate([m + rng.normal(size=(40, 16)) * 0.1 for m in middles])
    asked = np.concatenate([middles[:8] + 0.05, np.zeros((1, 16))])
    parents = [i // 10 for i in range(len(vec))]
    index, queries = _vectors(spark, vec, parents, asked)
    cells = vectors.cells_of(index, "parent", "child", cell_rows=20)
    found = vectors.top_parents(cells, queries, 3)
    assert {(r["query_id"], r["parent"], r["child"], r["score"], r["rank"]) for r in found.collect()} == _best_parents(vec, asked, parents, 3)
    assert vectors.probed_share(cells, queries.where("query_id < 8"), found, 3) < 0.3
    few = vectors.top_parents(index.where("parent < 2"), queries, 5, "parent", "child")
    assert few.groupBy("query_id").count().select("count").distinct().collect() == [(2,)]
    assert vectors.top_parents(index.where("false"), queries, 5, "parent", "child").collect() == []
    assert vectors.top_parents(index, queries.where("false"), 5, "parent", "child").collect() == []
    with pytest.raises(Exception, match="differ in size"):
        vectors.top_parents(index, queries.select("query_id", F.array(F.lit(1.0)).alias("query_vector")), 3, "parent", "child")


class _Counting(HashedWordEmbedder):
    """Notes each text that it embeds in a file; fails at the text ``stop``, if any."""

    def __init__(self, path, stop=None):
        super().__init__()
        object.__setattr__(self, "path", str(path))
        object.__setattr__(self, "stop", stop)

    def embed(self, texts):
        if self.stop and any(self.stop in t for t in texts):
            raise RuntimeError("no more quota")
        with open(self.path, "a") as f:
            f.write("".join(f"{len(t)}:{t}\x1e" for t in texts))
        return super().embed(texts)

    def seen(self):
        with open(self.path) as f:
            return [x.split(":", 1)[1] for x in f.read().split("\x1e") if x]


def test_a_question_is_embedded_once(spark, tmp_path):
    embedder = _Counting(tmp_path / "seen")
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(str(i), str(i % 5), [float(x) for x in rng.normal(size=256)]) for i in range(40)], "id string, lesson_id string, vector array<double>")
    questions = spark.createDataFrame([(i, f"question {i}") for i in range(12)], "query_id int, question string")
    assert corpus.search(points, questions, embedder, ChunkConfig(), 3).count() == 36
    assert sorted(embedder.seen()) == sorted(f"task: search result | query: question {i}" for i in range(12))


def _inputs(spark, n):
    return spark.createDataFrame([(str(i), 0, f"key{i:03d}", f"sha{i}", f"text {i:03d}") for i in range(n)], "lesson_id string, chunk_number int, cache_key string, input_sha256 string, embedding_input string").repartition(3)


def test_rounds_before_a_failure_are_kept(spark, tmp_path):
    """Round 3 of 5 fails; the first two are there, and another run embeds only what they lack, each input once."""
    chunks, path = _inputs(spark, 25), str(tmp_path / "cache")
    keys = sorted((str(i) for i in range(25)))  # rounds go by record, then unit
    failing = _Counting(tmp_path / "first", stop=f"text {int(keys[12]):03d}")
    with pytest.raises(Exception, match="no more quota"):
        vectors.embed_pending(chunks, failing, path, batch_size=2, round_rows=5)
    kept = {r["cache_key"] for r in vectors.read_cache(spark, path).collect()}
    assert kept == {f"key{int(k):03d}" for k in keys[:10]}
    rest = _Counting(tmp_path / "second")
    assert vectors.embed_pending(chunks, rest, path, batch_size=2, round_rows=5) == {"vectors": 25, "expected": 25, "complete": True, "rounds": 3}
    assert sorted(rest.seen()) == sorted(f"text {int(k):03d}" for k in keys[10:])
    assert set(failing.seen()) >= {f"text {int(k):03d}" for k in keys[:10]}
    again = _Counting(tmp_path / "third")
    assert vectors.embed_pending(chunks, again, path)["rounds"] == 0 and not (tmp_path / "third").exists()


def test_an_altered_vector_stops_the_next_run(spark, tmp_path):
    chunks, path = _inputs(spark, 6), str(tmp_path / "cache")
    assert vectors.embed_pending(chunks, HashedWordEmbedder(), path, round_rows=3)["rounds"] == 2
    name = vectors.read_cache(spark, path).where("round <> 'none'").first()["round"]
    rows = [tuple(r) for r in spark.read.schema(vectors.CACHE).parquet(f"{path}/round={name}").collect()]
    altered = [(k, sha, [v[1], v[0], *v[2:]]) for k, sha, v in rows]
    spark.createDataFrame(altered, vectors.CACHE).write.mode("overwrite").parquet(f"{path}/round={name}")
    unused = _Counting(tmp_path / "seen")
    with pytest.raises(ValueError, match="checksum"):
        vectors.embed_pending(chunks, unused, path)
    assert not (tmp_path / "seen").exists()


def test_ordered_fingerprint(spark):
    """The same order in other partitions has one fingerprint; two rows that change places have another, found by its leaf."""
    rows = [(i, f"v{i}") for i in range(300)]
    tree = lambda r, n=2: order.merkle_tree(spark.createDataFrame(r, "i int, v string").repartition(n), F.col("v"), "i", leaf_rows=4, fan=3)
    one, other = tree(rows), tree(random.Random(3).sample(rows, 300), 5)
    assert order.fingerprint(one) == order.fingerprint(other) and order.first_difference(one, other, fan=3) is None
    swapped = [*rows[:201], (201, "v202"), (202, "v201"), *rows[203:]]
    assert order.first_difference(one, tree(swapped), fan=3) == 201 // 4
    assert order.first_difference(one, tree(rows[:-1]), fan=3) == 299 // 4 and order.first_difference(one, tree(rows[:9]), fan=3) == 2
    assert order.fingerprint(tree([])) != order.fingerprint(one) and one.where("level = 0").agg(F.sum("rows")).first()[0] == 300


def test_plan_manifest_follows_the_order_of_units(spark):
    lessons = _record(spark, "10", lesson="word " * 400).union(_record(spark, "9", lesson="valves freeze"))
    config = ChunkConfig(max_words=60, max_input_bytes=2000)
    chunks = chunking.plan_chunks(lessons, "d", config)
    one = chunking.plan_manifest(chunks, config, "d").first()
    assert (one["indexed_lessons"], one["whole_lessons"], one["split_lessons"], one["chunks"]) == (2, 1, 1, chunks.count())
    assert chunking.plan_manifest(chunks.repartition(5, "id"), config, "d").first() == one
    swapped = chunks.withColumn("chunk_number", F.when(F.col("chunk_number") < 2, 1 - F.col("chunk_number")).otherwise(F.col("chunk_number")))
    assert chunking.plan_manifest(swapped.where("lesson_id = '10'"), config, "d").first()["fingerprint"] != chunking.plan_manifest(chunks.where("lesson_id = '10'"), config, "d").first()["fingerprint"]


def test_field_comparison_and_missing_content(made):
    rows = {r["section"]: r.asDict() for r in quality.field_comparison(made.comparisons).collect()}
    assert rows["lesson"] == {"section": "lesson", "records": 5, "both_fields_present": 2, "equivalent_after_rendering": 1, "different_nonempty_variants": 1, "one_variant_empty": 0, "one_or_no_field_present": 3}
    assert rows["driving_event"]["both_fields_present"] == rows["driving_event"]["one_variant_empty"] == 1
    missing = {r["field"]: r["missing"] for r in quality.missing_content(made.lessons).collect()}
    assert missing["title"] == 1 and missing["lesson"] == 0 and missing["driving_event"] == 4 and missing["evidence"] == 5


def test_report_has_all_its_sections():
    stats = {"lessons": 1200, "total": 5000, "median": 3.5, "maximum": 9, "over": 0, "missing title": 2, "flag missing_title": 2, "missing_section evidence": 7, "fields lesson": {"both_fields_present": 4, "one_variant_empty": 1}}
    text = sinks.report(stats, "2001-01-02T00:00:00Z")
    assert text == sinks.report(dict(reversed(stats.items())), "2001-01-02T00:00:00Z")
    heads = [line for line in text.splitlines() if line.startswith("#")]
    assert heads == ["# Corpus quality", "## Reconciliation", "## Missing content", "## Two fields of one section", "## Review signals", "## Size in words"]
    for row in ("| lessons | 1,200 |", "| title | 2 |", "| lesson | 4 | 0 | 0 | 1 |", "| missing_title | 2 |", "| missing_section evidence | 7 |", "| median | 3.5 |"):
        assert row in text
    assert "2001-01-02T00:00:00Z" in text and sinks.report({}).count("##") == 5


def test_products_follow_identifiers_as_numbers(spark, tmp_path):
    hits = [_hit(n, lesson=f"a{n}", lesson_learned=f"b{n}", drivingEvent="x", description_event=f"y{n}") for n in (10, 9, 100, 1)]
    made = corpus.ingest(spark, _response(tmp_path / "r.json", hits), str(tmp_path / "out"), BASE)
    assert [r["lesson_id"] for r in made.lessons.coalesce(1).collect()] == ["1", "9", "10", "100"]
    assert [(r["lesson_id"], r["section"]) for r in made.variants.coalesce(1).collect()] == [(i, s) for i in ("1", "9", "10", "100") for s in ("driving_event", "lesson")]


def test_files_in_order(spark, tmp_path):
    for name in ("b/2.txt", "a/10.txt", "a/9.bin", "b/1.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = readers.files_in_order(spark, str(tmp_path), "*.txt").orderBy("position").collect()
    assert [(r["position"], r["path"].rpartition(str(tmp_path))[2], r["bytes"]) for r in rows] == [(0, "/a/10.txt", 8), (1, "/b/1.txt", 7), (2, "/b/2.txt", 7)]


_PROMPT = "query_id string, question string, prompt_version string, source_ids array<string>"


def test_generated_answers_say_why_they_stopped(spark):
    class Cut:
        def generate(self, prompts):
            return [Answer(None, "blocked") if "bad" in p else Answer(p.upper(), "length") if "long" in p else p for p in prompts]

    asked = spark.createDataFrame([("1", "q", "v2", ["1"], "bad"), ("2", "q", "v2", ["1"], "long"), ("3", "q", "v2", ["1"], "fine")], f"{_PROMPT}, payload string")
    assert {r["query_id"]: (r["answer"], r["finish_reason"]) for r in evaluate.generated(asked, Cut()).collect()} == {"1": (None, "blocked"), "2": ("LONG", "length"), "3": ("fine", None)}


def test_batches_before_and_after_are_compared(spark):
    row = lambda i, version, sources, answer: (i, f"question {i}", version, sources, answer, "stop")
    before = [row("a", "v1", ["1", "2"], "x"), row("b", "v1", ["1"], "x"), row("c", "v1", ["1"], None), row("d", "v1", ["1"], "x"), row("e", "v1", ["1"], "x"), row("f", "v1", [], None)]
    after = [row("a", "v2", ["2", "1"], "x"), row("b", "v2", ["3"], "y"), row("c", "v2", ["1"], "y"), row("d", "v2", ["1"], None), row("f", "v2", [], None), row("g", "v2", ["1"], "x")]
    kind = f"{_PROMPT}, answer string, finish_reason string"
    rows = {r["query_id"]: r for r in evaluate.compared(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()}
    assert {i: r["outcome"] for i, r in rows.items()} == {"a": "same", "b": "changed", "c": "gained", "d": "lost", "e": "only_before", "f": "none", "g": "only_after"}
    assert [i for i in sorted(rows) if rows[i]["same_sources"]] == ["a", "c", "d", "f"] and rows["g"]["question"] == "question g" and rows["e"]["prompt_version_before"] == "v1"


def test_history_is_appended(spark, tmp_path):
    path, kind = str(tmp_path / "h"), f"{_PROMPT}, answer string, finish_reason string"
    for answer in ("yes", None):
        evaluate.append_history(spark.createDataFrame([("1", "why?", "v2", ["3", "4"], answer, None)], kind), path)
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["answer"] or "")
    assert [r["answer"] for r in rows] == [None, "yes"] and all(re.fullmatch(r"\d{8}-\d{6}-[0-9a-f]{8}", r["stem"]) for r in rows) and rows[0]["stem"] != rows[1]["stem"]
    assert rows[1]["markdown"] == "## why?\n\nyes\n\nSources: 3, 4\n" and "(no answer)" in rows[0]["markdown"]
    assert json.loads(rows[0]["json"])["answer"] is None and json.loads(rows[1]["json"])["source_ids"] == ["3", "4"]


def test_a_cluster_needs_a_shared_folder():
    class Named:
        def __init__(self, **conf):
            self.conf = self
            self.values = {k.replace("_", "."): v for k, v in conf.items()}

        def get(self, name, default=None):
            return self.values.get(name, default)

    warehouse = {"spark_sql_warehouse_dir": "file:/w"}
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(Named(spark_master="spark://a:7077", **warehouse))
    assert scratch.shared_dir(Named(spark_master="local[4]", **warehouse)) == "file:/w/_shared"
    assert scratch.shared_dir(Named(spark_master="yarn", spark_sql_warehouse_dir="hdfs://n/w/")) == "hdfs://n/w/_shared"
    assert scratch.shared_dir(Named(spark_master="yarn", spark_checkpoint_dir="s3a://b/c", **warehouse)) == "s3a://b/c"
