"""A text of 20 MB, and rows without a doc_id, through the operators that other tests give short ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sediment.llm import lines, media, mixing, packing, quality, simhash, token_files

KIND = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def text():
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    some = "\n".join(line() for _ in range(2000))
    return "\n".join([some] + [line() for _ in range(60000)] + [some])


@pytest.fixture(scope="module")
def docs(spark, text):
    return spark.createDataFrame([(1, text, "s"), (2, text[-400:], None), (3, None, "s")], KIND).repartition(2)


def _ids(name, text, end):
    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, end], "<u4")


def test_long_text_is_packed_whole(docs, text):
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1").orderBy("piece").collect()
    ids = _ids("word_bpe_49k.json", text, 1)
    assert len(text) > 20_000_000 and [p["length"] for p in pieces[:-1]] == [4096] * (len(pieces) - 1) and sum(p["length"] for p in pieces) == len(ids)
    assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)


def test_long_text_in_token_files(docs, text):
    rows = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)).collect()}
    ids = _ids("byte_bpe_50k.json", text, 0)
    assert (rows[1]["start"], rows[1]["n_tokens"], rows[1]["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes())) and rows[2]["start"] == len(ids)


def test_long_text_elsewhere(docs, text):
    prints = {r["doc_id"]: r["fp0"] & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()}
    hashes = np.array(simhash.shingle_hashes(text, 4), np.uint64)
    assert prints[1] == sum(1 << i for i in range(64) if 2 * int((hashes >> np.uint64(i) & np.uint64(1)).sum()) > len(hashes))
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}[1] == len(text.split())
    stored = {r["doc_id"]: r for r in media.documents_as_media(docs).collect()}[1]
    data = text.encode()
    assert stored["n_bytes"] == len(data) and stored["payload_sha256"] == hashlib.sha256(data + b" " * (-len(data) % 192)).hexdigest()
    report = {r["doc_id"]: r for r in lines.line_report(docs).collect()}
    kept = "\n".join(text.split("\n")[:-2000])
    assert (report[1]["n_lines"], report[1]["n_removed"]) == (64000, 2000) and report[1]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_rows_without_doc_id_in_token_files_and_scores(spark):
    docs = spark.createDataFrame([(None, "a b c", "s"), (None, "a b c", "s"), (1, "good words here", "s"), (2, None, None)], KIND)
    rows = token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)).collect()
    assert len(rows) == 4 and sum(r["doc_id"] is None for r in rows) == 2
    at = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if r["doc_id"] is None}) == 1
