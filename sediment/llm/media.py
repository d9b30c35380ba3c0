"""Operator 6: interleaved document sequences with media resolved by digest.

HTML is parsed into an ordered sequence of text and media-reference items. A reference names its payload by digest
(``sha256:...``); a join on the digest resolves it against a media store, while position and caption stay with the
reference. The store keeps lossless images (PNG, 8-bit samples); it is read back, decoded and described where it lies,
and only the small descriptions are joined, never the payloads. They are written first, so that a digest which a third
of all references name is skewed on one side of the join only, which Spark splits at run time.

Defined results: null HTML is an empty page without items; a reference whose digest is not in the store keeps null
media columns; equal payloads have one digest and one description; null text is an empty text, whose payload is one
row of blanks; an empty table gives no rows; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_slice, slices, texts_of

#: A row of the image: 64 pixels of three 8-bit samples.
ROW_BYTES = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
_SKIPPED = {"script", "style", "head", "template"}
_VOID = {"img", "br", "hr", "source", "embed", "wbr", "input", "meta", "link", "col", "area", "base", "param", "track"}
_BREAKS = {"p", "div", "br", "hr", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "blockquote", "pre", "ul", "ol", "table"}


def payload_of(text: str) -> bytes:
    """UTF-8 with blanks added up to a positive multiple of a row."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes, level: int = 6) -> bytes:
    """A 64-pixel-wide RGB image whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_decode(media: bytes) -> bytes:
    """The samples of an image written by ``png_encode``; a damaged one raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], 3 * shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are supported")
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """A 64-bit average hash over 64 stretches of the samples, then their mean and deviation."""
    samples = np.frombuffer(payload, np.uint8)
    sums = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    edges = np.arange(65) * len(samples) // 64
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    bits = np.packbits(means > sums[-1] / len(samples)).tobytes().hex()
    return f"{bits}:{samples.mean():.3f}:{samples.std():.3f}"


class _Sequence(HTMLParser):
    """Collects (kind, text, source, caption) in document order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self._text: list[str] = []
        self._skip = 0
        self._figures: list[int] = []
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.items.append(["text", text, None, None])
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self._skip += 1
        elif not self._skip:
            values = dict(attrs)
            if tag in _BREAKS:
                self._flush()
            if tag == "figure":
                self._figures.append(len(self.items))
            elif tag == "figcaption":
                self._flush()
                self._caption = []
            elif tag in _MEDIA_TAGS and values.get("src"):
                self._flush()
                self.items.append(["media", None, values["src"], values.get("alt") or None])

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif not self._skip:
            if tag == "figcaption" and self._caption is not None:
                caption, self._caption = " ".join("".join(self._caption).split()), None
                for item in self.items[self._figures[-1] if self._figures else len(self.items) :]:
                    if item[0] == "media":
                        item[3] = caption
            elif tag == "figure" and self._figures:
                self._figures.pop()
            if tag in _BREAKS:
                self._flush()

    def handle_data(self, data):
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)

    def close(self):
        super().close()
        self._flush()


_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("source", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
_ITEM_DDL = "array<struct<position:int,kind:string,text:string,source:string,digest:string,caption:string>>"


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    names = ("kind", "text", "source", "caption")
    return [{"position": i, **dict(zip(names, item, strict=True)), "digest": item[2][7:] if (item[2] or "").startswith("sha256:") else None} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, *carried: str) -> DataFrame:
    """The carried columns (numbers that name the page) and items: each page's ordered text and media references."""
    kinds = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array([parse_sequence(h) for h in batch.column("html").to_pylist()], pa.list_(_ITEM))], names=[*carried, "items"])

    narrow = pages.select(*carried, F.coalesce("html", F.lit("")).alias("html"))
    return narrow.mapInArrow(per_slice(run, "html"), "".join(f"{c} {kinds[c]}, " for c in carried) + f"items {_ITEM_DDL}")


def read_store(store: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes: their size and hash, the decoded payload's, and its description."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            payload = png_decode(media)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[n.split()[0] for n in ddl.split(", ")])

    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = store.select("digest", "media").mapInArrow(per_slice(run, "media"), ddl)
    rest = [n.split()[0] for n in ddl.split(", ")][1:]
    return materialize(read.groupBy("digest").agg(*(F.min(n).alias(n) for n in rest)), "media-described")  # equal within a digest


def resolve(sequenced: DataFrame, described: DataFrame) -> DataFrame:
    """One row for each media reference: the page's columns, position, caption, digest and the store's columns (null if not there)."""
    of_page = [c for c in sequenced.columns if c != "items"]
    refs = sequenced.select(*of_page, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return refs.select(*of_page, "item.position", "item.caption", "item.digest").join(described, "digest", "left")


def interleaved(pages: DataFrame, described: DataFrame, key: str = "page_id") -> DataFrame:
    """The pages' key and items in order, each media item with its resolved description.

    ``key`` names a page; of pages with equal keys the items are equal as far as positions are.
    """
    named = pages.withColumn("_row", F.monotonically_increasing_id())
    sequenced = materialize(sequences(named, key, "_row"), "media-sequences")
    found = resolve(sequenced, described).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("media_sha256", "media_bytes", "feature")))).alias("media"))
    items = F.transform("items", lambda x: x.withField("media", F.try_element_at("media", x["position"])))
    return sequenced.join(found, "_row", "left").select(key, items.alias("items"))


def store_texts(docs: DataFrame) -> DataFrame:
    """Each document as a page that tells its size and shows its text as one image, written with the image: doc_id,
    n_bytes, html, digest, media. Equal texts have equal pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for few in slices(batch):
                rows = []
                for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True):
                    media, n_bytes = png_encode(payload_of(text)), len(text.encode("utf-8", "surrogatepass"))
                    digest = hashlib.sha256(media).hexdigest()
                    html = f'<p>A text of {n_bytes} bytes:</p><figure><img src="sha256:{digest}"><figcaption>Its bytes, {ROW_BYTES} to a row</figcaption></figure>'
                    rows.append((doc_id, n_bytes, html, digest, media))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "html", "digest", "media"])

    return materialize(texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary"), "media-store")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """doc_id and what its image's reference resolves to: sizes, hashes, feature, and the place and caption in the page."""
    stored = store_texts(docs)
    found = resolve(sequences(stored, "doc_id", "n_bytes"), read_store(stored))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def pages_with_images(pages: DataFrame) -> DataFrame:
    """page_id and the items of each page, to which an image of its address is added behind its text, in order and resolved."""
    stored = store_texts(pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))
    image = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>Its address</figcaption></figure>'))
    images = stored.select(F.col("doc_id").alias("page_id"), image.alias("image")).distinct()
    shown = pages.select("page_id", "html").join(images, "page_id", "left")
    return interleaved(shown.select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce("image", F.lit(""))).alias("html")), read_store(stored))
