"""ISO dates in all their spellings, against the standard library."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from sediment.functions import text as T


def _parsed(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def test_iso_dates_equal_the_standard_library(spark):
    rng, texts = random.Random(3), []
    for _ in range(1500):
        day = date(1, 1, 1) + timedelta(days=rng.randrange(3_652_059))
        year, week, weekday = day.isocalendar()
        texts += [day.isoformat(), day.strftime("%Y%m%d").zfill(8), f"{year:04d}-W{week:02d}-{weekday}", f"{year:04d}W{week:02d}{weekday}", f"{year:04d}-W{week:02d}", f"{year:04d}W{week:02d}"]
        texts += [f"{year:04d}-W53-{weekday}", f"{rng.randrange(10000):04d}-{rng.randrange(15):02d}-{rng.randrange(34):02d}"]
    for text in rng.sample(texts, 1500):  # one character added, lost or changed
        at, other = rng.randrange(len(text)), rng.choice("0123456789-W wT\n")
        texts += [text[:at] + other + text[at:], text[:at] + text[at + 1 :], text[:at] + other + text[at + 1 :]]
    texts += ["", " ", "0000-01-01", "0000-W01-1", "0001-W01-1", "9999-W52-5", "9999-W52-6", "9999-W52-7", "9999-12-31", "2001-W00-1", "2001-W01-0", "2001-W01-8", "2001-W01-", "2001-W1-1", "2004-02-29", "2003-02-29", "2001-001", "2001-0102", "200101-02", "2001-W011", "2001W01-1", "٢٠٠١-01-02", "2001-01-02\n"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").withColumn("d", T.iso_date(F.col("t"))).collect()
    wrong = [(r["t"], r["d"]) for r in rows if r["d"] != (_parsed(r["t"]) if r["t"] is not None else None)]
    assert len(rows) > 15_000 and wrong == []
