"""Operators against brute-force versions on a small fixture with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sediment.llm import lines, media, mixing, order_minhash, packing, pii, quality, queries, simhash, substrings, token_files
from sediment.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, size string, offset string"


def _texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma.", "it's", "don't", "naïve", "x", "10.0.0.1", "écoute", "zeta!!"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = make(60), make(6000)
    near = long.split()
    near[3] = "changed"
    return [None, "", " ", make(3), passage, make(20) + "\n" + passage + "\n" + make(9), long, long, " ".join(near), "a\tb  c\n\nd\x1ce ", make(80), "mail a.b@c.de or +1 (555) 123-4567, card 4111 1111 1111 1111", "9" * 5000, passage + "\n" + passage]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(name: str, end: int) -> dict[int, bytes]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes() for i, t in enumerate(_texts())}


def test_packing(docs, none):
    expected = _ids("word_bpe_49k.json", 1)
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in rows) == sum(len(v) // 4 for v in expected.values())
    bins: dict[int, list] = {}
    for r in rows:
        part = expected[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert (zlib.crc32(part), r["start"]) == (r["ids_crc32"], 4096 * r["piece"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_minimum_bin_slack_fills_bins():
    chosen = packing.minimum_bin_slack({7: 3, 5: 2, 3: 4, 2: 1}, 10)
    assert sum(t * sum(k * c for k, c in take.items()) for t, take in chosen) == 7 * 3 + 5 * 2 + 3 * 4 + 2
    assert all(sum(k * c for k, c in take.items()) <= 10 for _, take in chosen) and chosen[0] == (3, {7: 1, 3: 1})


def test_token_files(docs, none, tmp_path):
    expected = _ids("byte_bpe_50k.json", 0)
    files = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder=str(tmp_path))
    rows, start = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["doc_id"]), 0
    assert len(rows) == len(expected)
    for r in rows:
        ids = expected[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_files.read_token_files(token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"), folder=str(tmp_path))).count() == 0


def test_damaged_frame_is_refused(tmp_path):
    path = str(tmp_path / "x.zst")
    writer = token_files.FrameWriter(token_files._open(path, "wb"))
    writer.add(1, b"\1\0\0\0" * 50)
    writer.close()
    data = bytearray(open(path, "rb").read())
    data[12] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError), token_files._open(path, "rb") as source:
        list(token_files.FrameReader(source).documents({1}))


def test_simhash_links_equal_brute_force(spark, docs, none):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.majority_bits(simhash.shingle_hashes(t or "", 4)) for i, t in enumerate(_texts())}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r["component_id"] for i, r in rows.items()} == root
    assert all(rows[i]["fp0"] & (1 << 64) - 1 == fps[i] for i in fps)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_dealt_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 3)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 20)
    values = sorted({int(b) ^ (1 << int(x)) for b in base for x in rng.integers(0, 60, 8)} | {int(b) for b in base})
    points = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "name long, fp0 long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.fingerprint_links(points)).collect()}
    root = list(range(len(values)))
    for _ in range(4):
        for a in range(len(values)):
            for b in range(len(values)):
                if (values[a] ^ values[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert [found.get(i, i) for i in range(len(values))] == root


def test_stage_keeps_one_of_each_group(docs):
    kept = {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()}
    assert 6 in kept and not kept & {7, 8} and {3, 4, 10, 11} <= kept


def test_order_minhash(docs, none):
    texts = [t or "" for t in _texts()]
    rows = {r["doc_id"]: r for r in order_minhash.fingerprints_with_edits(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= rows[i]["near_edited"] <= 1
    assert rows[6]["fingerprint"] == rows[7]["fingerprint"] and rows[6]["near_next"] == 1.0 and rows[7]["near_next"] > 0.8
    assert order_minhash.fingerprints_with_edits(none).count() == 0


def test_order_matters_for_order_minhash():
    a, b = "".join(random.Random(1).choices("abcdefgh", k=900)), "".join(random.Random(2).choices("abcdefgh", k=900))
    same, swapped = order_minhash.order_minhash(a + b), order_minhash.order_minhash(b + a)
    assert order_minhash.likeness(same, same) == 1 and order_minhash.likeness(same, swapped) < 0.8


def test_quality(spark, sf_dir, none):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.train([])).limit(5).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def test_media(docs, none):
    rows = {r["doc_id"]: r for r in media.documents_as_media(docs).collect()}
    for i, t in enumerate(_texts()):
        payload = media.payload_of(t or "")
        assert len(payload) % 192 == 0 and len(payload) > 0
        assert (rows[i]["payload_sha256"], rows[i]["tail_crc32"], rows[i]["position"], rows[i]["caption"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), 1, "Its bytes, 192 to a row")
    assert media.documents_as_media(none).count() == 0


def test_sequence_order_and_captions():
    html = "<p>One</p><figure><img src='sha256:ab'><figcaption>Cap</figcaption></figure>Two<img src='http://x/y.png' alt='Alt'>"
    items = [(x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse_sequence(html)]
    assert items == [("text", "One", None, None), ("media", None, "ab", "Cap"), ("text", "Two", None, None), ("media", None, None, "Alt")]


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    sizes = {i: len((t or "").encode().split()) for i, t in enumerate(_texts())}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    by: dict[int, list] = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source_size"], []).append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 128
    assert rows == mixing.mix(docs).collect() or sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0
    words = sum(len(r["text"].split()) for r in mixing.mixed_documents(docs.select("doc_id", "text", "source", "n_chars")).where("doc_id not in (9)").collect())
    assert words > 0


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])


def test_permutation():
    assert sorted(mixing.permuted(np.arange(1000), 1000, 5).tolist()) == list(range(1000))


def _repeated_lines(texts: list[str], least: int) -> list[set[int]]:
    docs = [[(n, x.strip(), len(x.split())) for n, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    gone = [set() for _ in docs]
    for x, later in enumerate(docs):
        for i in range(len(later)):
            for y in range(x + 1):
                for j in range(len(docs[y]) if y < x else i):
                    n = 0
                    while i + n < len(later) and j + n < len(docs[y]) and later[i + n][1] == docs[y][j + n][1]:
                        n += 1
                    if sum(w for _, _, w in later[i : i + n]) >= least:
                        gone[x] |= {k for k, _, _ in later[i : i + n]}
    return gone


def test_lines_equal_brute_force(docs, none):
    texts = [t or "" for t in _texts()]
    gone = _repeated_lines(texts, 50)
    for r in lines.line_report(docs).collect():
        kept = "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if n not in gone[r["doc_id"]])
        assert (r["n_removed"], r["kept_sha256"]) == (len(gone[r["doc_id"]]), hashlib.sha256(kept.encode()).hexdigest())
    assert lines.line_report(none).count() == 0
    assert lines.without_repeated_lines(docs).columns == docs.columns


def test_substrings_equal_brute_force(docs, none):
    texts, first = [(t or "").encode() for t in _texts()], {}
    for i, b in enumerate(texts):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for r in substrings.remove_repeats(docs).collect():
        b = texts[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = True
        assert bytes(r["kept"]) == np.frombuffer(b, np.uint8)[~gone].tobytes() and r["n_removed"] == gone.sum()
        assert r["n_spans"] == len(re.findall("1+", "".join(map(str, gone.astype(int)))))
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("limits", [{}, {"MOST_IN_SET": 0}, {"MOST_IN_SET": 3}, {"MOST_IN_BUCKET": 0}, {"MOST_IN_BUCKET": 5}, {"MOST_IN_BUCKET": 4, "HELD_AT_ONCE": 50}, {"MOST_IN_SET": 4, "MOST_IN_BUCKET": 3, "HELD_AT_ONCE": 9}])
def test_substrings_of_many_overlapping_copies(spark, monkeypatch, limits):
    """Parts of a few passages in all documents, dealt over partitions, with ids that are repeated; also with all or some anchors crowded."""
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abc d") for _ in range(400)) for _ in range(4)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(330)
            parts += [rng.choice(passages)[a : a + rng.randrange(20, 200)], rng.choice(["", "x", "é", "\n"])]
        texts.append("".join(parts))
    rows = [(i // 2 if i % 10 == 0 else i, t) for i, t in enumerate(texts)]
    first: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t.encode()) - 49):
            w = t.encode()[p : p + 50]
            first[w] = min(i, first.get(w, i))
    expected = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        expected.append((i, len(b), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    found = substrings.remove_repeats(docs, keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_pii(docs, none):
    row = pii.pii_report(docs).where("doc_id = 11").first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 0, 1, 1)
    text = _texts()[11]
    place = lambda kind, part: f"{kind}:{text.index(part)}:{text.index(part) + len(part)}"
    expected = ",".join([place("email", "a.b@c.de"), place("phone", "+1 (555) 123-4567"), place("card", "4111 1111 1111 1111")])
    assert row["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest() and row["spans"] == expected
    assert pii.pii_report(none).count() == 0


#: The base patterns.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _confirmed(kind: str, found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_pii_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    pieces = ["a", "B", "_", "1", "23", "256", "007", "@", ".", "-", "+", " ", "(", ")", "%", "é", "", "😀", "\n", "b.c", "x@y.z", "10.0.0.1", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 555 123 4567"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 70))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(200)) for _ in range(300)]
    rows = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = [(m.start(), nth, f"{kind}:{m.start()}:{m.end()}", kind) for nth, (kind, pattern) in enumerate(_BASE.items()) for m in re.finditer(pattern, text) if _confirmed(kind, m.group())]
        expected = [s[2] for s in sorted(spans)]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in _BASE] == [sum(s[3] == k for s in spans) for k in _BASE]
        assert set(expected) <= set(rows[i]["spans"].split(","))


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e", None), (1, "a b c d e", "s"), (1, "a b c d e", "s"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 4
    assert simhash.near_duplicates(docs).count() == 4
    assert order_minhash.fingerprints_with_edits(docs).count() == 4
    assert mixing.mix(docs).count() == 4
    assert lines.line_report(docs).count() == 4
    assert substrings.remove_repeats(docs).count() == 4
    assert media.documents_as_media(docs).count() == 4
    assert pii.pii_report(docs).count() == 4


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf_dir, name):
    rows = {"pages_interleaved": "count(*) FROM '{}/pages.parquet'", "op13_chat_formatting": "count(DISTINCT conv_id) + 1 FROM '{}/conversations.parquet'"}
    n = duckdb.sql("SELECT " + rows.get(name, "count(*) FROM '{}/documents.parquet'").format(sf_dir)).fetchall()[0][0]
    if name == "op12_phrase_collocations":  # a row a phrase: as many as its SQL has
        n = len(oracle.sql_rows(sf_dir, queries.oracle_sql()[name])[1])
    assert queries.queries()[name](spark, sf_dir).count() >= n


def test_stages_on_hard_rows(spark, sf_dir, docs, none):
    """Nulls in every column, empty tables, and extra columns named like those that the stages make."""
    import corpus_pipeline

    extra = ["uid", "_uid", "_parts", "_tag", "_doc_id", "_of", "_runs", "_leaving", "first", "n", "tag", "name", "fp0"]
    blank = spark.createDataFrame([(None,) * len(docs.columns), (None,) * len(docs.columns)], SCHEMA)
    add = lambda df: df.selectExpr("*", *(f"'x' AS {c}" for c in extra))
    for name, stage in corpus_pipeline.STAGES:
        for df in (add(docs.union(blank)), add(none)):
            out = stage(spark, df, sf_dir)
            rows = out.collect()
            assert name == "best_fit_packing" or out.columns == df.columns
            if name == "line_dedup":
                assert all(r["n_chars"] == len(r["text"]) and r["_runs"] == "x" for r in rows)
            if name == "source_mixing":
                assert all(r["n_chars"] == len(r["text"]) and r["uid"] == r["_uid"] == "x" for r in rows)
        assert not rows


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.run(spark, sf_dir).groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
