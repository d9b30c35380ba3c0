"""HTML as rows of parser events, or as boxes of raw text, in Arrow batches; operators.markup makes texts and tables of them.

The parser is the standard library's, so recovery from broken markup is its own: end tags without a start are reported
and ignored, and paragraphs, list items, links and table parts close where HTML implies it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# The tag classes of the record format.
BLOCKS = {
    "p", "div", "section", "article", "header", "footer", "center", "blockquote", "pre", "dl", "dt", "dd", "ul", "ol",
    "h1", "h2", "h3", "h4", "h5", "h6", "address", "figure", "figcaption",
}
MEDIA = {"img", "iframe", "embed", "object", "video", "audio", "source"}
DROPPED = {"script", "style", "head"}
KNOWN = BLOCKS | MEDIA | DROPPED | {
    "a", "br", "hr", "li", "sub", "sup", "table", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "colgroup", "col",
    "span", "b", "i", "u", "em", "strong", "small", "font", "q", "s", "strike", "del", "ins", "code", "tt", "nobr", "abbr",
    "cite", "label", "wbr", "html", "body", "noscript",
}
_VOID = {"br", "hr", "img", "embed", "source", "wbr", "col", "input", "meta", "link", "area", "base", "param", "track"}
#: An opening tag closes these, up to the scope that holds them.
_IMPLIED = {"a": ({"a"}, {"table", "td", "th", "caption"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
_P_SCOPE = {"table", "li", "td", "th", "caption", "div"}
_ATTRIBUTES = {"href", "src", "data", "alt", "title", "rowspan", "colspan", "start", "value"}
#: Code points that are no characters mark where a list item begins and ends, and stand around a table's place.
ITEM_BEGINS, ITEM_ENDS, TABLE_BEGINS, TABLE_ENDS = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_RESERVED = {ord(c): "\ufffd" for c in (ITEM_BEGINS, ITEM_ENDS, TABLE_BEGINS, TABLE_ENDS)}
_CELLS, _PARTS = {"td", "th"}, {"td", "th", "caption"}
BAD_NUMBER = "invalid_ordered_list_number"
_WHOLE = re.compile(r"[ \t\n\v\f\r]*([+-]?[0-9]{1,9})[ \t\n\v\f\r]*")
#: White space as Java's patterns know it.
_BLANKS, _EDGES = re.compile(r"[^\S\x1c-\x1f]+"), re.compile(r"\A[^\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")


def resolve(reference: object, base: str) -> str | None:
    """The web address that a reference means on a page at ``base``; null for other schemes, none, or a malformed one."""
    relative = reference.strip() if isinstance(reference, str) else ""
    with suppress(ValueError):
        address = urljoin(base, relative) if relative else ""
        if urlsplit(address).scheme in ("http", "https"):  # urlsplit lowers the scheme
            return address
    return None


_TOKENS = re.compile(r"<[^<>]*>|[^<]+")
_ATTRIBUTE = r"""[ \t\n\r\f]+([A-Za-z][A-Za-z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w.:#%+-]+)(?=[ \t\n\r\f>])))?"""
_PLAIN_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)((?:{re.sub(r'\((?!\?)', '(?:', _ATTRIBUTE)})*)[ \t\n\r\f]*(/?)>", re.ASCII)
_EACH_ATTRIBUTE = re.compile(_ATTRIBUTE, re.ASCII)
#: Elements whose content, or whose start, the standard library reads in ways of its own.
_OWN_WAYS = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
_OTHER = ("", "", [])


@lru_cache(4096)
def _plain_tag(token: str) -> tuple[str, str, list]:
    """What a tag does (start, end or both), its name and attributes; _OTHER if that is not plain to see."""
    found = _PLAIN_TAG.fullmatch(token) if len(token) < 1000 else None
    if not found or found[2].lower() in _OWN_WAYS or (found[1] and (found[3] or found[4])):
        return _OTHER
    if found[1]:
        return "end", found[2].lower(), []
    attrs = []
    for name, double, single, bare in _EACH_ATTRIBUTE.findall(found[3] + ">"):
        value = double or single or bare
        attrs.append((name.lower(), unescape(value) if value else value))
    return "both" if found[4] else "start", found[2].lower(), attrs


class _Events(HTMLParser):
    """Tags and text of one page in order; end tags that HTML implies are there, end tags without a start are problems."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.named: Counter[str] = Counter()  # how many of each tag are open
        self.dropping = 0
        self.rows: list[tuple] = []
        self.n = 0  # events so far
        self.page, self.place, self.line = None, 0, (1, 0, 0)  # of a page that is read tag by tag: how far; a line, where it begins, and how far that is known

    def _add(self, kind: str, tag: str | None, start: int | None = None, attrs: list | None = None, text: str | None = None, line: int | None = None, column: int | None = None) -> None:
        parent = self.open[-1][1] if self.open else -1
        self.rows.append((self.n, kind, tag, start, parent, len(self.open), attrs, text, line, column))
        self.n += 1

    def _close(self) -> None:
        tag, seq = self.open.pop()
        self.named[tag] -= 1
        if tag in DROPPED:
            self.dropping -= 1
        elif not self.dropping:
            self._add("close", tag, seq)

    def _close_within(self, tags: set[str], scope: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in scope:
                return
            if self.open[at][0] in tags:
                while len(self.open) > at:
                    self._close()

    def handle_starttag(self, tag, attrs):
        if self.dropping:
            return
        if tag in BLOCKS and self.named["p"]:
            self._close_within({"p"}, _P_SCOPE)
        if tag in _IMPLIED:
            self._close_within(*_IMPLIED[tag])
        if tag not in DROPPED:
            self._add("open", tag, self.n, [(k, v or "") for k, v in dict(attrs[::-1]).items() if k in _ATTRIBUTES] if attrs else [])
        self.dropping += tag in DROPPED
        self.named[tag] += 1
        self.open.append((tag, self.n - 1))
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and len(self.open) > depth:
            self._close()

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if not self.named[tag]:
            if not self.dropping:
                line, column = self.getpos()
                self._add("problem", tag, text=f"end tag without a start: {tag}", line=line, column=column)
            return
        while self.open[-1][0] != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        if not self.dropping:
            self._add("text", None, text=data if data.isascii() else data.translate(_RESERVED))

    def read(self, html: str) -> None:
        """As ``feed`` and ``close``: pages of plain tags and texts tag by tag, all others by the standard library."""
        found = _TOKENS.findall(html)
        tokens = [None if t[0] != "<" else _plain_tag(t) for t in found]
        if sum(map(len, found)) != len(html) or _OTHER in tokens:
            self.feed(html)
            self.close()
            return
        self.page, self.place = html, 0
        start, end, data = self.handle_starttag, self.handle_endtag, self.handle_data
        for token, text in zip(tokens, found, strict=True):
            if token is None:
                data(unescape(text) if "&" in text else text)
            elif token[0] == "start":
                start(token[1], token[2])
            elif token[0] == "end":
                end(token[1])
            else:
                self.handle_startendtag(token[1], token[2])
            self.place += len(text)

    def getpos(self):
        if self.page is None:
            return super().getpos()
        line, begin, at = self.line
        if lines := self.page.count("\n", at, self.place):
            line, begin = line + lines, self.page.rfind("\n", at, self.place) + 1
        self.line = line, begin, self.place
        return line, self.place - begin

    def finish(self) -> list[tuple]:
        while self.open:
            self._close()
        return [(-1, "page", None, None, -1, 0, None, None, None, None), *self.rows]


def _page_events(html: str) -> list[tuple]:
    parser = _Events()
    try:
        parser.read(html)
        return parser.finish()
    except (AssertionError, ValueError, RecursionError) as error:
        return [(-1, "failed", None, None, -1, 0, [("html", html)], str(error) or type(error).__name__, None, None)]


EVENTS = "seq int, kind string, tag string, start int, parent int, depth int, attrs map<string,string>, text string, line int, column int"


def page_events(pages: DataFrame) -> DataFrame:
    """key and EVENTS of pages (key string, html string): a row for the page (or its failure), and one for each start tag, end
    tag, stretch of text and problem."""
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32()]
    names = ["key", *(c.split()[0] for c in EVENTS.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list[str], rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        for batch in batches:
            keys, rows = [], []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _page_events(html)
                keys += [key] * len(found)
                rows += found
                if len(rows) > 20_000:
                    yield made(keys, rows)
                    keys, rows = [], []
            yield made(keys, rows)

    return pages.select("key", "html").mapInArrow(run, f"key string, {EVENTS}")


class _Box:
    """What gathers text while it is open: the page, a cell or caption of a table, or a table for its parts."""

    __slots__ = ("attrs", "captions", "elements", "link", "links", "outside", "parts", "row", "rows", "seq", "tag", "tr", "trs")

    def __init__(self, tag: str, seq: int, row: int | None = None, attrs: dict | None = None):
        self.tag, self.seq, self.row, self.attrs = tag, seq, row, attrs or {}
        self.parts: list[str] = []
        self.links, self.link = 0, None  # how many are open, and the last one opened
        self.trs, self.tr, self.elements = 0, None, False  # of a table: rows open, the last one opened, any element yet
        self.rows: dict[int, list[tuple]] = {}
        self.captions: list[str] = []
        self.outside: list[str] = []


class _Boxes(_Events):
    """The texts of one page's boxes, raw, with marks where tables stand; its tables, links, media and problems.

    A start tag knows the box it lies in, the tables around it, and the list it counts in; all else is left to Spark.
    """

    def __init__(self, base: str):
        super().__init__()
        self.base = base
        self.boxes = [_Box("", -1)]
        self.around = self.lost = self.numbered = 0  # tables around; those among them between the cells of another one; kept so far
        self.lists: dict[int, list] = {}
        self.begun: dict[int, dict] = {}
        self.raw, self.said = "", 0
        self.tables, self.links, self.media, self.problems = [], [], [], []
        self.at_level: list[int] = []
        self.unknown: set[str] = set()

    def _add(self, kind, tag, start=None, attrs=None, text=None, line=None, column=None):
        seq = self.n
        self.n += 1
        if kind == "text":
            self._text(text)
        elif kind == "open":
            self._opened(tag, seq, dict(attrs) if attrs else {})
        elif kind == "close":
            self._closed(tag, start)
        else:
            self.problems.append({"level": "WARNING", "line": line, "column": column, "message": text})

    def _put(self, piece: str) -> None:
        box = self.boxes[-1]
        box.parts.append(piece)
        if box.links:
            box.link["parts"].append(piece)

    def _shown(self) -> bool:
        return not self.lost and self.boxes[-1].tag != "table"

    def _text(self, text: str) -> None:
        if self.said < 40:  # enough to tell whether all texts together say nothing
            some = _BLANKS.sub(" ", text)[:40]
            self.raw += some
            self.said += len(some.replace(" ", ""))
        box = self.boxes[-1]
        if box.tag != "table":
            if not self.lost:
                self._put(text)
        elif self.around == 1 or not box.elements:
            box.outside.append(text)

    def _item(self, attrs: dict) -> str:
        """The mark of a list item. A start or value that is no number spoils this and all later items of its list."""
        if (of := self.lists.get(self.open[-1][1] if self.open else -1)) is None:
            return "-"
        own, value = attrs.get("value"), of["next"]
        if own is not None:
            found = _WHOLE.fullmatch(own)
            of["bad"] |= not found
            value = int(found[1]) if found else value
        of["next"] = value + 1
        if not of["bad"]:
            return f"{value}."
        if self._shown():
            self.unknown.add(BAD_NUMBER)
        return "-"

    def _medium(self, tag: str, attrs: dict) -> None:
        reference, alt = attrs.get("src") or attrs.get("data") or "", attrs.get("alt")
        spoken = _EDGES.sub("", (alt or "").translate(_RESERVED))
        self.media.append({"number": len(self.media) + 1, "tag": tag, "reference": reference, "resolved_url": resolve(reference, self.base), "alt": alt, "title": attrs.get("title"), "status": "not_downloaded"})
        self._put(f"[{'Image' if tag == 'img' else 'Media'} {len(self.media)}{'; source alt: ' + spoken if spoken else ''}; content not loaded]")

    def _opened(self, tag: str, seq: int, attrs: dict) -> None:
        if tag not in KNOWN:
            self.unknown.add(tag)
        box, shown = self.boxes[-1], self._shown()
        box.elements = True
        if tag == "ol":
            first = attrs.get("start")
            found = _WHOLE.fullmatch(first or "")
            self.lists[seq] = {"next": int(found[1]) if found else 1, "bad": first is not None and not found}
        mark = self._item(attrs) if tag == "li" else ""
        if tag == "table":
            self._table(box, seq, shown)
        elif tag in _PARTS and self.around:
            self.boxes.append(_Box(tag, seq, box.tr if box.trs else None, attrs))
        elif tag == "tr":
            box.trs, box.tr = box.trs + 1, seq
        elif not shown:
            pass
        elif tag == "a":
            link = {"level": self.around, "parts": [], "reference": attrs.get("href")}
            self.begun[seq] = box.link = link
            box.links += 1
        elif tag in MEDIA:
            self._medium(tag, attrs)
        elif tag in ("br", "hr") or tag in BLOCKS:
            self._put("\n")
        elif tag in ("sup", "sub"):
            self._put("^(" if tag == "sup" else "_(")
        elif tag == "li":
            self._put(f"\n{mark} {ITEM_BEGINS}")

    def _table(self, box: _Box, seq: int, shown: bool) -> None:
        own = _Box("table", seq)
        if shown:
            self.numbered += 1
            self.at_level += [0] * (self.around + 1 - len(self.at_level))
            self._put(f"{TABLE_BEGINS}{self.at_level[self.around]}{TABLE_ENDS}")
            self.at_level[self.around] += 1
            self.tables.append((self.numbered, self.around, own))
        self.lost += box.tag == "table"
        self.around += 1
        self.boxes.append(own)

    def _closed(self, tag: str, start: int) -> None:
        if self.boxes[-1].seq == start:
            box, outer = self.boxes.pop(), self.boxes[-1]
            if tag == "table":
                self.around -= 1
                self.lost -= outer.tag == "table"
            elif tag == "caption":
                outer.captions.append("".join(box.parts))
            else:
                cell = {"text": "".join(box.parts), "is_header": tag == "th", "rowspan": box.attrs.get("rowspan", "1"), "colspan": box.attrs.get("colspan", "1")}
                outer.rows.setdefault(1 << 31 if box.row is None else box.row, []).append(cell)  # cells without a row are the last row
            return
        box = self.boxes[-1]
        if tag == "tr":
            box.trs -= 1
        elif self.lost or box.tag == "table":
            pass
        elif tag == "a":
            box.links -= 1
            link = self.begun[start]
            if link["reference"] is not None:
                self.links.append(link)
        elif tag in ("sup", "sub"):
            self._put(")")
        elif tag == "li":
            self._put(f"{ITEM_ENDS}\n")
        elif tag in BLOCKS:
            self._put("\n")

    def done(self) -> dict:
        while self.open:
            self._close()
        tables = [
            {"number": n, "level": level, "captions": t.captions or None, "rows": [cells for _, cells in sorted(t.rows.items())], "outside": t.outside or None}
            for n, level, t in self.tables
        ]
        links = [{"level": x["level"], "body": "".join(x["parts"]), "reference": x["reference"], "resolved_url": resolve(x["reference"], self.base)} for x in self.links]
        return {
            "failed": None, "body": "".join(self.boxes[0].parts), "raw": self.raw, "levels": list(range(len(self.at_level) - 1, -1, -1)), "tables": tables, "links": links, "media": self.media,
            "problems": self.problems, "unknown": sorted(self.unknown),
        }


def _boxes_of(html: str, base: str) -> dict:
    parser = _Boxes(base)
    try:
        parser.read(html)
        return parser.done()
    except (AssertionError, ValueError, RecursionError) as error:
        return {"failed": str(error) or type(error).__name__, "body": html, "raw": "", "levels": [], "tables": [], "links": [], "media": [], "problems": [], "unknown": []}


_RAW_CELL = [("text", pa.string()), ("is_header", pa.bool_()), ("rowspan", pa.string()), ("colspan", pa.string())]
_RAW_TABLE = [("number", pa.int32()), ("level", pa.int32()), ("captions", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.struct(_RAW_CELL)))), ("outside", pa.list_(pa.string()))]
_RAW_LINK = [("level", pa.int32()), ("body", pa.string()), ("reference", pa.string()), ("resolved_url", pa.string())]
_MEDIUM = [("number", pa.int32()), *((n, pa.string()) for n in ("tag", "reference", "resolved_url", "alt", "title", "status"))]
_PROBLEM = [("level", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())]
_BOXES = pa.struct([
    ("failed", pa.string()), ("body", pa.string()), ("raw", pa.string()), ("levels", pa.list_(pa.int32())), ("tables", pa.list_(pa.struct(_RAW_TABLE))), ("links", pa.list_(pa.struct(_RAW_LINK))),
    ("media", pa.list_(pa.struct(_MEDIUM))), ("problems", pa.list_(pa.struct(_PROBLEM))), ("unknown", pa.list_(pa.string())),
])


def page_boxes(html: Column, base: str) -> Column:
    """The raw texts of a page's boxes, and its tables, links, media and problems; null for null."""

    @F.arrow_udf(from_arrow_type(_BOXES))
    def run(pages: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(pages), 256):  # few are Python objects at a time
            parts.append(pa.array([None if p is None else _boxes_of(p, base) for p in pages.slice(at, 256).to_pylist()], _BOXES))
        return pa.concat_arrays(parts) if parts else pa.array([], _BOXES)

    return run(html)


def resolved_url(reference: Column, base: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([resolve(v, base) for v in values], dtype=object)

    return run(reference)


def canonical_json(value: Column) -> Column:
    """JSON text with sorted keys and no blanks, for hashing."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values], dtype=object)

    return run(value)
