"""HTML to structured text: what the parser says of each page's boxes, as arrays, becomes texts, tables, links and media.

A box is what gathers text: the page, a cell or caption of a table, and the table itself for text outside its cells. The
parser (``functions.html.page_boxes``) deals the pieces of a page out to its boxes, with a mark where a table stands. Tables are
put into words from the innermost outwards, a level of nesting at a time: a table's text takes its mark's place in the box
around it. All of that is one row's columns, so no page meets another one, and nothing is shuffled.

Text outside cells: of a table that lies in no other table's cell, every stretch of text is kept; of one that does, only
the text before its first element. Links, media and tables in such places are not listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import CELL, RENDERED
from ..functions import text as T
from ..functions.html import ITEM_BEGINS, ITEM_ENDS, TABLE_BEGINS, TABLE_ENDS, page_boxes
from ..scratch import materialize

_TABLE = f"struct<number:int,caption:string,rows:array<array<{CELL}>>,text_outside_cells:array<string>>"


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _only(value: Column, holds: Callable[[Column], Column]) -> Column:
    """The value, or null unless ``holds`` is true of it."""
    return F.get(F.filter(F.array(value), holds), F.lit(0))


def _together(pieces: Column, tables: Column) -> Column:
    """Pieces as one tidy text; tables at their marks, list items without blanks at their ends."""
    def at_mark(part: Column, i: Column) -> Column:
        both = F.split(part, TABLE_ENDS)
        return F.when(i == 0, part).otherwise(F.concat(F.get(tables, F.get(both, F.lit(0)).try_cast("int")), F.get(both, F.lit(1))))

    whole = F.when(pieces.contains(TABLE_BEGINS), F.array_join(F.transform(F.split(pieces, TABLE_BEGINS), at_mark), "")).otherwise(pieces)
    items = F.regexp_replace(F.regexp_replace(whole, f"(?U){ITEM_BEGINS}\\s*", ""), f"(?U)(?:\\s*{ITEM_ENDS})+", "")
    return F.when(pieces.rlike(f"(?U)[\\s{ITEM_BEGINS}-{TABLE_ENDS}]"), T.tidy(items)).otherwise(pieces)


def _tables(given: Column, inner: Column) -> Column:
    """Tables of one level of nesting, as _TABLE; ``inner`` has the texts of those one level below."""
    def cell(c: Column) -> Column:
        return F.struct(_together(c["text"], inner).alias("text"), c["is_header"], c["rowspan"], c["colspan"])

    def table(t: Column) -> Column:
        caption = T.tidy(F.array_join(F.transform(t["captions"], lambda c: _together(c, inner)), "\n"))
        outside = _only(F.filter(F.transform(t["outside"], T.tidy), T.meaningful), lambda o: F.size(o) > 0)
        return F.struct(t["number"], caption.alias("caption"), F.transform(t["rows"], lambda r: F.transform(r, cell)).alias("rows"), outside.alias("text_outside_cells")).cast(_TABLE)

    return F.transform(given, table)


def _in_words(t: Column) -> Column:
    spans = lambda c: F.when((c["rowspan"] == "1") & (c["colspan"] == "1"), "").otherwise(F.concat(F.lit(" [rowspan="), c["rowspan"], F.lit("; colspan="), c["colspan"], F.lit("]")))
    shown = F.transform(t["rows"], lambda r: F.array_join(F.transform(r, lambda c: F.concat(c["text"], spans(c))), " | "))
    number = t["number"].cast("string")
    lines = F.concat(
        F.array(F.concat(F.lit("[Table "), number, F.lit("]"))), F.filter(F.array(t["caption"]), lambda c: c != ""), shown,
        F.filter(F.array(F.concat(F.lit("[Text outside table cells] "), F.array_join(t["text_outside_cells"], " "))), lambda c: c.isNotNull()),
    )
    return F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n[End table "), number, F.lit("]\n"))


def _resolved(boxes: Column) -> Column:
    """texts of the tables at each level, from 0, in their order there, and all tables."""
    def level(done: Column, at: Column) -> Column:
        def with_texts(made: Column) -> Column:
            texts = F.concat(F.array(F.transform(made, _in_words)), done["texts"])
            return F.struct(texts.alias("texts"), F.concat(made, done["tables"]).alias("tables"))

        inner = F.coalesce(F.get(done["texts"], F.lit(0)), F.array().cast("array<string>"))
        return _with(_tables(F.filter(boxes["tables"], lambda t: t["level"] == at), inner), with_texts)

    none = F.struct(F.array().cast("array<array<string>>").alias("texts"), F.array().cast(f"array<{_TABLE}>").alias("tables"))
    return F.aggregate(boxes["levels"], none, level)


def rendering(boxes: Column) -> Column:
    """RENDERED of what the parser says of a page."""
    def page(done: Column) -> Column:
        at_level = lambda n: F.get(done["texts"], n)
        links = F.transform(boxes["links"], lambda x: F.struct(_together(x["body"], at_level(x["level"])).alias("text"), x["reference"], x["resolved_url"], F.lit("not_downloaded").alias("status")))
        media = F.transform(boxes["media"], lambda m: m.withField("alt", _only(T.tidy(m["alt"]), lambda a: a != "")))
        text = F.when(boxes["failed"].isNotNull(), boxes["body"]).otherwise(_only(_together(boxes["body"], at_level(F.lit(0))), T.meaningful))
        tables = F.array_sort(done["tables"], lambda a, b: a["number"] - b["number"])
        return F.struct(text.alias("text"), T.meaningful(boxes["raw"]).alias("source_text_present"), tables.alias("tables"), links.alias("links"), media.alias("media"), boxes["problems"].alias("parser_diagnostics"), boxes["unknown"].alias("unrecognized_tags"), boxes["failed"].alias("parse_failed")).cast(RENDERED)

    return _with(_resolved(boxes), page)


def rendered_texts(rows: DataFrame, text: str, base: str, name: str = "r") -> DataFrame:
    """``rows`` with ``name``: the rendering of their HTML, where they lie; null and blank texts are empty ones.

    Written, so that it is done once and what goes to the parser at once has a bound in bytes.
    """
    boxes = rows.withColumn(name, page_boxes(F.col(text), base))
    return materialize(boxes.withColumn(name, F.when(F.col(name).isNotNull(), rendering(F.col(name))).otherwise(empty_rendering())), "rendered-pages")


def empty_rendering() -> Column:
    return F.from_json(F.lit('{"source_text_present":false,"tables":[],"links":[],"media":[],"parser_diagnostics":[],"unrecognized_tags":[]}'), RENDERED)


def text_key(text: Column) -> Column:
    """132 bits of the text's SHA-256 in 22 characters; null for null and blank texts."""
    return F.when(T.strip(text) != "", F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, 22))


def rendered_by_key(texts: DataFrame, text: str, base: str) -> DataFrame:
    """key and r of the different texts that are not blank."""
    pages = texts.select(text_key(F.col(text)).alias("key"), F.col(text).alias("html")).where("key is not null")
    return rendered_texts(pages.groupBy("key").agg(F.first("html").alias("html")), "html", base).select("key", "r")


def table_cells(rendered: DataFrame, key: str, r: str = "r") -> DataFrame:
    """key, number, caption, row, cell (from 1), text, is_header, rowspan and colspan: one row a cell."""
    rows = rendered.select(key, F.explode(f"{r}.tables").alias("t")).select(key, "t.number", "t.caption", F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select(key, "number", "caption", (F.col("row") + 1).alias("row"), F.posexplode("cells").alias("cell", "c"))
    return cells.select(key, "number", "caption", "row", (F.col("cell") + 1).alias("cell"), "c.*")
