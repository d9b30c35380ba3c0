"""Personal data in long texts, and account numbers before other capitals."""

from __future__ import annotations

import re
import time

from sediment.llm import pii


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte of addresses in seconds, with every place right; also where groups of matches meet."""
    text = " ".join(f"user{i}.x@mail{i % 7}.example.com" for i in range(30_000))
    few = " ".join(f"a{i}@b.c" for i in range(2 * pii.MATCHES_AT_ONCE + 1))
    docs = spark.createDataFrame([(1, text), (2, few), (3, "x" * 20_000_000)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    took = time.time() - began
    for i, t in ((1, text), (2, few)):
        assert rows[i]["spans"].split(",") == [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", t)]
    assert rows[3]["n_spans"] == 0
    assert took < 60, took


def test_account_numbers_and_context(spark):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32 NOW", "GB82WEST12345698765432", "GB82WEST12345698765433", "DE89 3704 0044 0532 0130 00 AND MORE",
        "SSNs: 123-45-6789, 234-56-7890", "numbers 123-45-6789", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", None,
    ]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(9)] == ["iban:5:32", "iban:0:22", "", "iban:0:27", "ssn:6:17,ssn:19:30", "", "secret:9:49", "", ""]
