"""Rendering lies in place at every depth of tables, and the quick way for plain markup reads it as the standard library does."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import html
from sediment.operators import markup

TAGS = "table tr td th caption tbody a p li ol ul div b sup br img object h1 foo script head title".split()
TEXTS = ["x", " y ", "\n", "\r\n a\t b", "&amp;", "&lt", "&am", "&", "1 < 2", ">", " ", "none", "<!-- c -->", "<b", "<br/>", "<img src=x/>", "</b x>", "<a title='x>y'>"]
ATTRIBUTES = [' href="/a"', " alt='p&amp;q'", " start=5", " value", ' title = "z"', " HREF=b", ' alt=""', " src=7 src=8"]


@pytest.mark.parametrize(("depth", "tables"), [(1, 1), (3, 4)])
def test_rendering_shuffles_nothing(spark, monkeypatch, depth, tables):
    """A table alone, and tables in tables: one write, no exchange."""
    plans = []

    def written(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(markup, "materialize", written)
    inner = "<table><tr><td>cell</td></tr></table>"
    for _ in range(depth - 1):
        inner = f"<table><tr><td>around {inner}</td></tr></table>"
    df = spark.range(20).select("id", F.concat(F.lit(inner if depth == 1 else inner + "<table></table>"), F.col("id").cast("string")).alias("html"))
    assert {r["n"] for r in markup.rendered_texts(df, "html", "https://example.org/").select(F.size("r.tables").alias("n")).collect()} == {tables}
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_plain_markup(spark):
    rng = random.Random(1)
    plain = 0
    for _ in range(4000):
        page = "".join(rng.choice([f"<{rng.choice(TAGS)}{''.join(rng.sample(ATTRIBUTES, rng.choice([0, 0, 1, 2])))}>", f"</{rng.choice(TAGS)}>", rng.choice(TEXTS[:-7]), rng.choice(TEXTS) if rng.random() < 0.2 else ""]) for _ in range(rng.randint(0, 12)))
        parser = html._Events()
        parser.feed(page)
        parser.close()
        assert html._page_events(page) == parser.finish(), page
        plain += html._OTHER not in [html._plain_tag(t) for t in html._TOKENS.findall(page) if t[0] == "<"]
    assert plain > 500
