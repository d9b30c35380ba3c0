"""Written tables leave no shuffle files behind, and settings as they were."""

from pathlib import Path

from sediment.scratch import _WHILE_WRITING, materialize


def test_shuffles_go_with_the_write(spark):
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    kept = lambda: {p for p in local.rglob("shuffle_*") if p.is_file()}
    before, settings = kept(), {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    ids = spark.range(20_000)
    out = materialize(ids.selectExpr("id % 7000 k").groupBy("k").count().repartition(3, "k"), "test-scratch")
    left = kept() - before
    assert out.count() == 7000 and not left
    assert {k: spark.conf.get(k, None) for k in _WHILE_WRITING} == settings
