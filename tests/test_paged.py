"""Paged reading and pacing with stubs that fail, shift, stall and count."""

from __future__ import annotations

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from sediment.contracts import HashedWordEmbedder
from sediment.operators import vectors
from sediment.sources import paged
from sediment.sources.pacing import Lane, Pace, Refused

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Service:
    """Records 0 .. n - 1; notes each request in a folder. Some requests fail at first."""

    def __init__(self, folder, n, fails=0, status=503, grows_at=None, repeats=False, partial=False):
        self.folder, self.n, self.fails, self.status, self.grows_at, self.repeats, self.partial = str(folder), n, fails, status, grows_at, repeats, partial

    def post(self, payload, timeout):
        name = f"{payload.get('from', 'count')}-{time.time_ns()}-{os.getpid()}"
        earlier = [x for x in os.listdir(self.folder) if x.startswith(f"{payload.get('from', 'count')}-")]
        open(f"{self.folder}/{name}", "w").close()
        if payload["size"] and len(earlier) < self.fails:
            if self.status == 0:
                raise ConnectionError("lost")
            return self.status, {"Retry-After": "0"}, b"busy"
        n = self.n + (self.grows_at is not None and len(os.listdir(self.folder)) > self.grows_at)
        ids = range(payload.get("from", 0), min(n, payload.get("from", 0) + payload["size"]))
        hits = [{"_id": str(0 if self.repeats and i == n - 1 else i), "_source": {"n": i, "text": "a{é"}} for i in ids]
        body = {"timed_out": self.partial, "_shards": {"failed": 0}, "hits": {"total": {"value": n, "relation": "eq"}, "hits": hits}}
        return 200, {"ETag": "x", "Server": "s"}, json.dumps(body).encode()


QUICK = Pace(0.0, lanes=3, first_wait=0.01)


@pytest.mark.parametrize("fails, status", [(0, 503), (2, 429), (2, 0)])
def test_pages_are_read_by_lanes_and_retried(spark, tmp_path, fails, status):
    service = Service(tmp_path, 23, fails, status)
    hits = paged.read_pages(spark, service, {"sort": ["n"]}, page_size=5, pace=QUICK)
    assert {(r["idx"], r["doc_id"]) for r in hits.select("idx", "doc_id").collect()} == {(i, str(i)) for i in range(23)}
    requests = len(os.listdir(tmp_path))
    assert hits.count() == 23 and len(os.listdir(tmp_path)) == requests == 2 + 5 * (1 + fails)  # nothing is fetched twice


def test_what_is_refused(spark, tmp_path):
    for i, (service, error) in enumerate([
        (dict(n=9, fails=9), "503"), (dict(n=9, fails=1, status=404), "404"), (dict(n=9, grows_at=3), "changed"), (dict(n=9, repeats=True), "repeats"), (dict(n=9, partial=True), "not complete"), (dict(n=0), "0 records"),
    ]):
        (tmp_path / str(i)).mkdir()
        with pytest.raises(Exception, match=error):
            paged.read_pages(spark, Service(tmp_path / str(i), **service), {}, page_size=4, pace=QUICK)
    assert len(os.listdir(tmp_path / "1")) <= 1 + 3 + 2  # a refusal that can't pass is not sent again


def test_a_lane_waits_as_it_is_told():
    now, slept, left = [0.0], [], [Refused(429, 7.5), Refused(500), ConnectionError(), Refused(429, 900.0)]

    def sleep(seconds):
        slept.append(round(seconds, 3))
        now[0] += seconds

    def send():
        if left:
            raise left.pop(0)
        return "done"

    lane = Lane(Pace(interval=1.0, lanes=2, attempts=5), 1, lambda: now[0], sleep)
    assert lane.request(send) == "done"
    assert slept == [1.0, 7.5, 4.0, 8.0, 60.0]  # its turn, the server's wait, two of our own, the longest
    assert lane.request(send) == "done" and slept[-1] == 2.0
    with pytest.raises(Refused):
        left.append(Refused(400))
        lane.request(send)
    with pytest.raises(ValueError):
        Pace(lanes=0)


class _Timed(HashedWordEmbedder):
    def __init__(self, folder):
        super().__init__()
        object.__setattr__(self, "folder", str(folder))

    def embed(self, texts):
        first = not os.listdir(self.folder)
        open(f"{self.folder}/{time.time_ns()}-{os.getpid()}", "w").close()
        if first:
            raise Refused(429, 0.1)
        return super().embed(texts)


def test_four_tasks_keep_one_rate(spark, tmp_path):
    rows = [(f"k{i}", f"s{i}", f"text {i}") for i in range(48)]
    chunks = spark.createDataFrame(rows, "cache_key string, input_sha256 string, embedding_input string").repartition(7)
    vectors.embed(chunks, HashedWordEmbedder(), 2).collect()  # workers are up
    found = vectors.embed(chunks, _Timed(tmp_path), 2, Pace(interval=0.1, lanes=4)).collect()
    assert len(found) == 48
    times = sorted(int(x.split("-")[0]) / 1e9 for x in os.listdir(tmp_path))
    assert len(times) >= 25 and len({x.split("-")[1] for x in os.listdir(tmp_path)}) > 1
    for i, t in enumerate(times):  # ten a second, and one more for each lane whose turn falls in
        assert sum(t <= u < t + 1.0 for u in times[i:]) <= 10 + 4
