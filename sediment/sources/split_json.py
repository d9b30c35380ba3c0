"""One JSON value with a large array in it, read by as many tasks as its bytes ask for.

Spark reads the file as text that ends at each ``{``, so byte ranges become fragments and every object of the array begins
with one. Whether a fragment lies in a string, and at what depth, depends on all text before it: each range is first
summed up for both cases (inside a string or not) as the brackets that it closes and leaves open, these sums are put
together in order, one row a range, and then every range knows where it begins. A compressed file is one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize

_TOKEN = re.compile(r'\\.|["{}\[\],:]', re.DOTALL)
_CLOSES = {"}": "{", "]": "["}
_SEPARATORS = ", \t\r\n"


class _State:
    """Where a scan is: in a string or not, the open brackets with the keys they stand under, and the key at hand."""

    def __init__(self, in_string: bool = False, opened: list | None = None, key: str | None = None, known: bool = True):
        self.in_string, self.opened, self.key, self.known = in_string, list(opened or []), key, known
        self.closed = 0  # brackets opened before, of a scan that did not see them
        self.text: str | None = None

    def fits(self, path: list[tuple[str, str | None]]) -> bool:
        return [*map(tuple, self.opened)] == path

    def scan(self, fragment: str) -> Iterator[tuple[str, int]]:
        """Move over a fragment; gives each bracket outside strings with the place behind it, after it took effect."""
        begun = 0
        for m in _TOKEN.finditer(fragment):
            token = m[0]
            if self.in_string:
                if token == '"':
                    self.in_string, self.text = False, fragment[begun : m.start()]
            elif token == '"':
                self.in_string, begun = True, m.end()
            elif token == ":":
                self.key = self.text
            elif token == ",":
                self.key = None
            elif token in "{[":
                self.opened.append((token, self.key))
                self.key = self.text = None
                yield token, m.end()
            elif token in _CLOSES:
                if self.opened:
                    if self.opened.pop()[0] != _CLOSES[token]:
                        raise ValueError("brackets of the JSON value do not match")
                elif self.known:
                    raise ValueError("the JSON value closes more than it opens")
                else:
                    self.closed += 1
                self.key = None
                yield token, m.end()


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """block (where its byte range begins) and fragment, in reading order inside a block."""
    return spark.read.option("lineSep", "{").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    """block, number in the block, and the fragment with the brace that it begins with."""
    at, n = None, 0
    for batch in batches:
        for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = (at, n + 1) if block == at else (block, 0)
            yield block, n, value if block == 0 and n == 0 else "{" + value


_SUM = "block long, in_string boolean, ends_in_string boolean, closed int, opened array<struct<bracket:string,key:string>>, key string, text string"


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's effect, begun outside a string and inside one."""
    schema = pa.schema([("block", pa.int64()), ("in_string", pa.bool_()), ("ends_in_string", pa.bool_()), ("closed", pa.int32()), ("opened", pa.list_(pa.struct([("bracket", pa.string()), ("key", pa.string())]))), ("key", pa.string()), ("text", pa.string())])

    def rows(block: int, states: list[_State | None]) -> pa.RecordBatch:
        out = [{"block": block, "in_string": bool(i), "ends_in_string": s.in_string, "closed": s.closed, "opened": [{"bracket": b, "key": k} for b, k in s.opened], "key": s.key, "text": s.text} for i, s in enumerate(states) if s]
        return pa.RecordBatch.from_pylist(out, schema=schema)

    at, states = None, []
    for block, n, fragment in _by_block(batches):
        if n == 0:
            if at is not None:
                yield rows(at, states)
            at, states = block, [_State(False, known=False), _State(True, known=False)]
        for i, state in enumerate(states):
            try:
                for _ in state.scan(fragment) if state else ():
                    pass
            except ValueError:  # it can't begin so
                states[i] = None
    if at is not None:
        yield rows(at, states)


def _starts(sums: list) -> dict[int, tuple[bool, list, str | None]]:
    """The state at the beginning of each block: a prefix scan over a row or two for each."""
    by_block: dict[int, dict[bool, object]] = {}
    for row in sums:
        by_block.setdefault(row["block"], {})[row["in_string"]] = row
    in_string, opened, key, starts = False, [], None, {}
    for block in sorted(by_block):
        starts[block] = (in_string, opened, key)
        row = by_block[block].get(in_string)
        if row is None or row["closed"] > len(opened):
            raise ValueError("brackets of the JSON value do not match")
        opened = [*opened[: len(opened) - row["closed"]], *((o["bracket"], o["key"]) for o in row["opened"])]
        in_string, key = row["ends_in_string"], row["key"]
    if in_string or opened:
        raise ValueError("the JSON value ends too early")
    return starts


def read_array(spark: SparkSession, path: str, keys: tuple[str, ...] = ("hits", "hits")) -> tuple[str, DataFrame]:
    """The JSON value with the array under ``keys`` emptied, and the array's objects: idx and json (text), by many tasks.

    Anything in the array that is no object stays in the returned value, for its reader to refuse. An array of arrays is
    not looked into. Objects are as long as a row may be; the rest of the value should fit the driver.
    """
    fragments = _fragments(spark, path)
    starts = _starts(fragments.mapInArrow(_summed, _SUM).collect())  # two rows a byte range
    if not starts:
        raise ValueError("no JSON value")
    known = spark.sparkContext.broadcast(starts)
    around = [("{", None), *(("{", k) for k in keys[:-1]), ("[", keys[-1])]
    inside = [*around, ("{", None)]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("nth", pa.int64()), ("piece", pa.string())])
        state, nth, out, size = _State(), -1, [], 0
        for block, n, fragment in _by_block(batches):
            if n == 0:
                state, nth = _State(*known.value[block]), -1
            here = len(state.opened) > len(around) and state.opened[: len(inside)] == inside
            end = 0  # of an object's part
            for token, behind in state.scan(fragment):
                if token == "{" and state.opened == inside:
                    nth, here = nth + 1, True
                elif here and token == "}" and state.opened == around:
                    out.append((block, 2 * n, nth, fragment[end:behind]))
                    end, here = behind, False
            rest = fragment[end:]
            if here:
                out.append((block, 2 * n, nth, rest))
            elif state.opened != around or rest.strip(_SEPARATORS):
                out.append((block, 2 * n + 1, None, rest.lstrip(_SEPARATORS) if end else rest))
            size += len(fragment)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    pieces = materialize(fragments.mapInArrow(cut, "block long, n long, nth long, piece string"), "json-pieces")
    before, offsets = 0, []
    for row in pieces.groupBy("block").agg(F.max("nth").alias("last")).orderBy("block").collect():  # a row a byte range
        offsets.append((row["block"], before))
        before += (-1 if row["last"] is None else row["last"]) + 1
    of_block = F.broadcast(spark.createDataFrame(offsets, "block long, before long"))
    whole = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "piece"))), lambda x: x["piece"]), "")
    rest = pieces.where("nth is null").agg(whole()).first()[0]
    objects = pieces.where("nth is not null").join(of_block, "block").groupBy((F.col("before") + F.col("nth")).alias("idx")).agg(whole().alias("json"))
    return rest, objects
