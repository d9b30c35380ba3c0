"""A search service as a Spark source: its pages are partitions, its client is given.

The client is a ``Transport``; it sends one request and knows nothing of Spark. Pages are read by tasks, at one pace for
all of them; what they give is written before it is looked at, so nothing is fetched twice, and it is accepted
only if the service counts the same before, in every page, and afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import materialize, release
from .pacing import Lane, Pace, Refused

_SCHEMA = "page int, position int, total long, hit string, headers map<string,string>"
# The response headers that are kept.
HEADERS = ("date", "last-modified", "etag", "content-type")


class Transport(Protocol):
    """Sends a request to the service; runs in tasks, so it must pickle. Lost connections are ConnectionError or TimeoutError."""

    def post(self, payload: dict, timeout: float) -> tuple[int, dict[str, str], bytes]:
        """Status, headers and body."""
        ...


def asked(transport: Transport, lane: Lane, payload: dict, timeout: float = 45.0) -> tuple[dict, dict[str, str]]:
    """The parsed response and those of its headers that are kept; an incomplete or inexact one is an error."""

    def send() -> tuple[dict[str, str], bytes]:
        status, headers, body = transport.post(payload, timeout)
        headers = {k.lower(): v for k, v in headers.items()}
        if status != 200:
            after = headers.get("retry-after", "")
            raise Refused(status, float(after) if after.replace(".", "", 1).isdigit() else None)
        return headers, body

    headers, body = lane.request(send)
    response = json.loads(body)
    total = response.get("hits", {}).get("total")
    exact = total if isinstance(total, int) else total.get("value") if isinstance(total, dict) and total.get("relation") == "eq" else None
    if response.get("error") or response.get("timed_out") or response.get("_shards", {}).get("failed") or not isinstance(exact, int) or isinstance(exact, bool) or exact < 0:
        raise ValueError("the search response is not complete and exact")
    response["hits"]["total"] = exact
    return response, {k: headers[k] for k in HEADERS if k in headers}


class _Pages(InputPartition):
    def __init__(self, lane: int, pages: list[int]):
        super().__init__(lane)
        self.lane, self.pages = lane, pages


def _source(transport: Transport, pace: Pace, query: dict, page_size: int, total: int) -> type[DataSource]:
    """A source class of its own for one read, which carries its client."""

    class Reader(DataSourceReader):
        def partitions(self):
            pages = range(-(-total // page_size))
            return [_Pages(i, [*pages[i :: pace.lanes]]) for i in range(min(pace.lanes, len(pages)))] or [_Pages(0, [])]

        def read(self, partition) -> Iterator[tuple]:
            lane = Lane(pace, partition.lane)
            for page in partition.pages:
                response, headers = asked(transport, lane, query | {"from": page * page_size, "size": page_size})
                for i, hit in enumerate(response["hits"].get("hits", [])):
                    yield page, page * page_size + i, response["hits"]["total"], json.dumps(hit, ensure_ascii=False), headers

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "sediment-pages"

        def schema(self):
            return _SCHEMA

        def reader(self, schema):
            return Reader()

    return Pages


def read_pages(spark: SparkSession, transport: Transport, query: dict, page_size: int = 500, pace: Pace = Pace(0.0), most: int = 1_000_000_000) -> DataFrame:
    """idx, raw_hit, doc_id and source of all records that ``query`` finds, as ``readers.read_hits`` gives them.

    A service whose count changes while it is read, or whose pages repeat or lack records, is refused. A lost task reads its
    pages again. ``query`` should name an order, as pages follow it.
    """
    lane = Lane(pace, 0)
    before = asked(transport, lane, query | {"size": 0})[0]["hits"]["total"]
    if not 0 < before <= most:
        raise ValueError(f"{before} records can't be read")
    spark.dataSource.register(_source(transport, pace, query, page_size, before))
    pages = materialize(spark.read.format("sediment-pages").load(), "pages")
    after = asked(transport, lane, query | {"size": 0})[0]["hits"]["total"]
    hits = pages.select(F.col("position").cast("long").alias("idx"), F.parse_json("hit").alias("raw_hit"))
    hits = hits.select("idx", "raw_hit", F.try_variant_get("raw_hit", "$._id", "string").alias("doc_id"), F.try_variant_get("raw_hit", "$._source", "variant").alias("source"))
    rows, other = pages.agg(F.count("*"), F.count_if(F.col("total") != before)).first()
    ids = hits.agg(F.count_distinct("doc_id")).first()[0]
    if after != before or rows != before or other or ids != before:
        release(pages)
        raise ValueError("the source changed while it was read, or repeats or lacks records")
    return hits
