"""HTML as relations: texts, tables in tables, list numbers, links, media, broken markup, equal and hard texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sediment.functions.html import page_events
from sediment.operators import markup, normalize

BASE = "https://example.org/"
TEXTS = [
    ("un<b>brok</b>en &lt;a&gt; &amp;lt; <script>no</script>tail", "unbroken <a> &lt; tail"),
    ("10<sup>3</sup> H<sub>2</sub>O", "10^(3) H_(2)O"),
    ("<ol start=3><li>a<li value=8>b</li><li>c</ol>", "3. a\n\n8. b\n\n9. c"),
    ("<ul><li>x</ul>", "- x"),
    ("<p> N/A&nbsp;</p>", None),
    ("<div></div>", None),
    ("null", None),
    ("None of them", "None of them"),
    ("a<!-- gone -->b<br>c", "ab\nc"),
    ("<ul><li> <p> one </p> <ul><li>two</li></ul> </li><li></li></ul>z", "- one\n\n- two\n\n-\n\nz"),
    ("<ol><li>a<ol start=' 7 '><li>b<li>c</ol><li value='+4'>d<li>e</ol>", "1. a\n\n7. b\n\n8. c\n\n4. d\n\n5. e"),
    ("<ol><li>a<li value=x>b<li value=3>c</ol>", "1. a\n\n- b\n\n- c"),
    ("<p>one<p>two<pre>  a   b\n c</pre>", "one\n\ntwo\n\na b\nc"),
    ("\ufdd0 x \ufdd1", "\ufffd x \ufffd"),
    ("<td>no table</td> <caption>none</caption>", "no table none"),
    ("<style>a</style><title>t</title>x</p></b>", "tx"),
    ("", None),
    (None, None),
    ("\x00<table>", "\x00\n[Table 1]\n[End table 1]"),
]


def _one(spark, html):
    return markup.rendered_texts(spark.createDataFrame([(html,)], "html string"), "html", BASE).first()["r"]


def test_texts(spark):
    """Repeated and null texts keep their rows; clashing names of other columns survive."""
    rows = [(i, html, "x") for i, (html, _) in enumerate(TEXTS * 3)]
    done = markup.rendered_texts(spark.createDataFrame(rows, "key int, html string, seq string").repartition(3), "html", BASE)
    assert set(done.columns) == {"key", "html", "seq", "r"}
    assert {r["key"]: r["r"]["text"] for r in done.collect()} == {i: text for i, (_, text) in enumerate(TEXTS * 3)}


def test_tables_links_media(spark):
    r = _one(spark, '<table><caption>Cap</caption>stray<tr><th rowspan=2>H<th colspan="2">K</tr><tr><td>1<td>20</tr></table><a href="/p">go</a><a href="mailto:x@y">m</a><img src="i.png" alt="pic"><foo>z</foo>')
    table = r["tables"][0]
    assert (table["caption"], [[c["text"] for c in row] for row in table["rows"]], table["text_outside_cells"]) == ("Cap", [["H", "K"], ["1", "20"]], ["stray"])
    assert table["rows"][0][0]["is_header"] and table["rows"][0][0]["rowspan"] == "2" and "1 | 20" in r["text"] and "H [rowspan=2; colspan=1]" in r["text"]
    assert [x["resolved_url"] for x in r["links"]] == [BASE + "p", None] and r["media"][0]["resolved_url"] == BASE + "i.png"
    assert "[Image 1; source alt: pic; content not loaded]" in r["text"] and r["unrecognized_tags"] == ["foo"]
    assert _one(spark, "<ol start=q><li>a</ol>")["unrecognized_tags"] == ["invalid_ordered_list_number"]
    assert not _one(spark, "<img src='x'>")["source_text_present"]


def test_tables_in_tables(spark):
    """Numbers by start tags; a row belongs to the nearest table; text outside cells is kept but for a nested table's tail."""
    inner = '<table>in<tr><td>x<li>q</li><a href="/i">l<b>k</b></a><table><tr><td>deep</table></td></tr>tail</table>'
    r = _one(spark, f'<table>lead<tr><td>a {inner} z</td><td></td></tr>more<td>loose</table>after<a href="#e"><table><tr><td>in a link</table></a>')
    assert [(t["number"], [[c["text"] for c in row] for row in t["rows"]], t["text_outside_cells"]) for t in r["tables"]] == [
        (1, [["a\n[Table 2]\nx\n- q\nlk\n[Table 3]\ndeep\n[End table 3]\n\n[Text outside table cells] in\n[End table 2]\nz".replace("\n\n[Text", "\n[Text"), ""], ["loose"]], ["lead", "more"]),
        (2, [["x\n- q\nlk\n[Table 3]\ndeep\n[End table 3]"]], ["in"]),
        (3, [["deep"]], None),
        (4, [["in a link"]], None),
    ]
    assert [(link["text"], link["reference"]) for link in r["links"]] == [("lk", "/i"), ("[Table 4]\nin a link\n[End table 4]", "#e")]
    assert "tail" not in r["text"] and r["text"].startswith("[Table 1]\na\n[Table 2]\nx")


def test_a_table_between_cells_is_not_listed(spark):
    r = _one(spark, '<table><tr><td>a</td></tr><table><tr><td>lost <a href="/x">y</a><img src="z"></td></tr></table>kept</table>')
    assert len(r["tables"]) == 1 and r["links"] == [] and r["media"] == [] and r["tables"][0]["text_outside_cells"] == ["kept"]


def test_links_follow_their_end(spark):
    r = _one(spark, '<a href="/1">one <img src="m"> two</a><a>no address</a><a href="/2">a<a href="/3">b</a> <a href="http://[bad">c</a>')
    assert [(x["text"], x["resolved_url"]) for x in r["links"]] == [("one [Image 1; content not loaded] two", BASE + "1"), ("a", BASE + "2"), ("b", BASE + "3"), ("c", None)]


def test_problems_and_long_pages(spark):
    r = _one(spark, "a</i>\n</b>b" + "<p>word <b>bold</b></p>" * 20_000)
    assert [(p["message"], p["line"], p["column"]) for p in r["parser_diagnostics"]] == [("end tag without a start: i", 1, 1), ("end tag without a start: b", 2, 0)]
    assert r["text"].count("word bold") == 20_000


def test_events_nest(spark):
    """Start and end tags pair up, and every event lies inside its parent."""
    events = page_events(spark.createDataFrame([("k", "<div><ul><li>a<li>b<p>c<p>d</ul></div><br>x")], "key string, html string"))
    pairs = {r["start"]: r["seq"] for r in events.where("kind = 'close'").collect()}
    opens = {r["seq"]: r for r in events.where("kind = 'open'").collect()}
    assert set(pairs) == set(opens)
    for r in events.collect():
        if r["parent"] >= 0 and r["kind"] != "close":
            assert r["parent"] < r["seq"] < pairs[r["parent"]] and r["depth"] == opens[r["parent"]]["depth"] + 1


def test_fields_that_are_no_text(spark):
    source = F.parse_json(F.lit('{"lesson_number": 5, "title": 7, "lesson": null, "lesson_learned": "<b>x</b>", "recommendation": ""}'))
    hits = spark.range(1).select(F.col("id").alias("idx"), source.alias("raw_hit"), F.lit("5").alias("doc_id"), source.alias("source"))
    lesson = normalize.normalize(hits, BASE).lessons.first()
    assert lesson["title"]["parser_diagnostics"][0]["level"] == "ERROR" and lesson["sections"]["lesson"]["text"] == "x"
    assert lesson["sections"]["lesson"]["source"]["field"] == "lesson_learned" and lesson["sections"]["recommendation"]["text"] is None


def test_empty_table(spark):
    assert markup.rendered_texts(spark.createDataFrame([], "html string"), "html", BASE).collect() == []
