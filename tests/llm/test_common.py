"""Shared helpers: what a written table leaves on disk."""

from pyspark.sql import functions as F

from isochron.llm.common import stored


def test_a_written_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    kept = lambda: sum(b.isShuffle() for b in list_of(manager.diskBlockManager().getAllBlocks()))
    list_of = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before, setting = kept(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    table = stored(spark.range(50_000).groupBy((F.col("id") % 20_000).alias("g")).count(), "told")
    assert table.count() == 20_000
    after = kept()
    # The count's own shuffle may stay; the table's four map outputs, data and index, do not.
    assert after - before <= 2, (before, after)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
