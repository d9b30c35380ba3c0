"""Media columns against a decoder of another make, and resolved sequences in order."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

from sediment.llm import media


def _stored_bytes(payload: bytes) -> bytes:
    """The image's bytes, put together anew: 64 pixels of three samples to a row, no filter."""
    lines = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">II", 64, len(payload) // 192) + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def test_columns_equal_brute_force(spark):
    texts = [None, "", "a", "x" * 192, "y" * 193, "naïve 漢字 😀" * 400, "x" * 192, "z" * 3_000_000]
    rows = {r["doc_id"]: r for r in media.documents_as_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        stored = _stored_bytes(payload)
        samples = np.frombuffer(payload, np.uint8).astype(float)
        edges = [k * len(samples) // 64 for k in range(65)]
        bits = "".join("01"[bool(samples[a:b].mean() > samples.mean())] for a, b in zip(edges, edges[1:], strict=False))
        feature = f"{int(bits, 2):016x}:{samples.mean():.3f}:{samples.std():.3f}"
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)
    assert rows[3][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]


def test_interleaved_pages(spark):
    """Items stay in order, captions with their image; a digest that is not stored, and repeated or null pages, have a result."""
    stored = media.store_texts(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"))
    one, two = (r["digest"] for r in stored.orderBy("doc_id").collect())
    html = f"<h1>T</h1><figure><img src='sha256:{two}'><figcaption>C2</figcaption></figure>mid<img src='sha256:{one}' alt='A1'>end<img src='sha256:00'>"
    pages = spark.createDataFrame([(7, html), (7, html), (8, None), (None, "<p>x")], "page_id long, html string")
    rows = media.interleaved(pages, media.read_store(stored)).collect()
    seen = sorted(((r["page_id"] or 0, [(x["position"], x["text"], x["caption"], x["digest"], (x["media"] or {"media_sha256": None})["media_sha256"]) for x in r["items"]]) for r in rows), key=repr)
    items = [(0, "T", None, None, None), (1, None, "C2", two, two), (2, "mid", None, None, None), (3, None, "A1", one, one), (4, "end", None, None, None), (5, None, None, "00", None)]
    assert seen == sorted([(7, items), (7, items), (8, []), (0, [(0, "x", None, None, None)])], key=repr)
