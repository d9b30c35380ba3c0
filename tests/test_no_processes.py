"""Intermediate tables have no checksum files, and so start no processes for them (Hadoop runs chmod for each file)."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

_RUN = """
import random, sys
from pathlib import Path
from pyspark.sql import SparkSession

log, out, shared = map(Path, sys.argv[1:])
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", str(shared)).getOrCreate()
random.seed(3)
parts = [" ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(70)) for _ in range(12)]
docs = spark.createDataFrame([(i, f"{parts[i % 12]} {parts[(i + 1) % 12]}") for i in range(24)], "doc_id long, text string").repartition(3)
docs.count()
log.write_text("")
STEP
out.write_text(log.read_text())
"""
_STEPS = {
    "line_dedup": "import corpus_pipeline; assert corpus_pipeline.dedup_lines(spark, docs, '').count() < 24",
    "repeated_substrings": "from sediment.llm import substrings; assert substrings.remove_repeats(docs, keep=False).where('n_removed > 0').count() > 0",
}


@pytest.mark.parametrize("step", _STEPS)
def test_processes_of_a_step(step, tmp_path):
    log, out, shared, chmod = tmp_path / "log", tmp_path / "out", tmp_path / "shared", tmp_path / "bin" / "chmod"
    chmod.parent.mkdir()
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{chmod.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", _RUN.replace("STEP", _STEPS[step]), str(log), str(out), str(shared)], check=True, cwd=tmp_path, env=env, timeout=300)
    started = [line for line in out.read_text().splitlines() if str(shared) in line]
    assert any(line.endswith(".parquet") for line in started)
    assert not [line for line in started if line.endswith(".crc")]
    assert not list(shared.rglob("*.crc"))
