"""The stream forms: priors in event order with expiring state, and a log that repeated batches don't double."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from isochron.operators import events
from isochron.plans import records
from isochron.streaming import ingest, priors


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(priors.STATE_STORE[0])
    spark.conf.set(*priors.STATE_STORE)
    yield spark
    spark.conf.set(priors.STATE_STORE[0], before)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_priors_equal_the_batch_form_in_event_order(rocks, tmp_path):
    spark = rocks
    log = spark.range(300).select(F.col("id").alias("event_id"), F.concat(F.lit("u"), (F.hash("id") % 5).cast("string")).alias("user"), F.timestamp_micros(1_700_000_000_000_000 + F.pmod(F.hash("id", F.lit(1)), F.lit(7200)).cast("bigint") * 1_000_000 + F.col("id") % 3).alias("ts"), F.when(F.hash("id", F.lit(2)) % 4 == 0, F.col("id") * 10).alias("lookup"))
    # Rows arrive out of order, within the two hours that the watermark waits; the last file only moves it on.
    for i in range(3):
        log.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    spark.createDataFrame([(10**6, "end", "2024-06-01 00:00:00", None)], "event_id bigint, user string, ts string, lookup bigint").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = priors.streaming_priors(stream, "user", "ts", "event_id", "lookup", "3 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.last_lookup(log, "user", "ts", "event_id", F.col("lookup")).select("user", "event_id", "prior")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("user", "event_id", "prior")) == rows_of(want)
    assert want.where("prior is null").count() > 5 and want.where("prior is not null").count() > 50
    # Nothing waits or is remembered but of the last row, which lies behind the watermark.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


@pytest.mark.parametrize("slices", [1, 7])
def test_priors_of_words_at_edges_are_one_aggregation(rocks, tmp_path, slices):
    # Lookups are words; rows lie at one moment, exactly as far as a lookup lasts, and a microsecond more.
    spark, at = rocks, [0, 0, 1, 599_999_999, 600_000_000, 600_000_001, 600_000_001, 1_200_000_002, 1_500_000_000, -1, -600_000_001, 9_000_000_000]
    log = spark.createDataFrame([(i, u, t, f"w{i}" if (i + u) % 3 == 0 else None) for u in range(6) for i, t in enumerate(at)], "key bigint, id bigint, rows bigint, stretch string").withColumn("rows", F.timestamp_micros(F.col("rows") + 1_700_000_400_000_000))
    for i in range(2):
        log.where(F.col("key") % 2 == i).write.parquet(str(tmp_path / "in" / str(i)))
    spark.createDataFrame([(-1, -1, None)], "key bigint, id bigint, stretch string").select("key", "id", F.timestamp_micros(F.lit(1_800_000_000_000_000)).alias("rows"), "stretch").write.parquet(str(tmp_path / "in" / "end"))
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = priors.streaming_priors(stream, "id", "rows", "key", "stretch", "1 day", 600, slices=slices).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.last_lookup(log, "id", "rows", "key", F.col("stretch"), 600).select("id", "key", "rows", "prior")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("id", "key", "rows", "prior")) == rows_of(want) and want.where("prior is not null").count() > 10
    # A call of a Python processor for each key and batch took most of the time.
    assert query.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"


def test_stretches_of_a_stream_are_written_by_all_tasks(spark, tmp_path):
    df = spark.range(900, numPartitions=3).select((F.col("id") % 300).alias("id"))
    for i, stream in enumerate(records._arriving(df, str(tmp_path / "in"), "id", spark.createDataFrame([(999,)], "id bigint"))):
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        assert len(list((tmp_path / "in" / str(i)).glob("*.parquet"))) >= 3
        got = rows_of(spark.read.parquet(str(tmp_path / "out")))
        assert len(got) == [300, 600, 901][i] and ((999,) in got) == (i == 2)


def messages(spark, rows):
    return spark.createDataFrame(rows, "message_id bigint, at string, sender string, thread string, is_group boolean, message string, mentions array<struct<uid: string, pos: int, len: int>>, has_image boolean, day string, prior_code string, prior_day string").withColumn("at", F.col("at").cast("timestamp"))


SAID = [
    (1, "2024-01-01 10:00:00", "An", "t", False, "đúng rồi", None, False, "2024-01-01", "01012100", None), (2, "2024-01-01 10:01:00", "bot", "t", False, "sai", None, False, "2024-01-01", "01012100", None),
    (3, "2024-01-01 10:02:00", "An", "x", False, "sai", None, False, "2024-01-01", "01012100", None), (4, "2024-01-01 10:03:00", "Bo", "t", True, "@bot sai, phải là 0202.30.00", [("bot", 0, 4)], False, "2024-01-01", "01012100", "2023-12-31"),
    (5, "2024-01-01 10:04:00", "Bo", "t", False, "cảm ơn", None, False, "2024-01-01", "01012100", None), (6, "2024-01-01 10:05:00", "Cu", "t", False, "sai rồi", None, False, "2024-01-01", None, None),
]


def test_messages_of_a_log_are_judged_without_a_python_call_for_each(spark):
    # Verdicts, ends to be cut off, letters and marks apart, codes in each writing, codes that confirm, and what is no verdict.
    said = [
        ("Đúng rồi!", "correct", None), (" ok…\t.\r\n", "correct", None), ("SAI BÉT?!", "wrong", None), ("không chắc", "unsure", None), ("nhầm", "wrong", None), ("phải là 8481 80.99, không phải 0202.30.00", "wrong", "84818099"),
        ("mã đúng: 01012100", "correct", None), ("đúng là 0101\n21.00 nhé", "correct", None), ("sai, 0101.2", "wrong", None), ("saigon 84818099", None, None), ("ok, 8481.80.99", None, None), ("…", None, None), ("sai rồi\u2028", "wrong", None), ("ok\u2028", None, None), (None, None, None),
    ]
    both = said + [(unicodedata.normalize("NFD", m), v, c) for m, v, c in said if m]
    df = messages(spark, [(i, "2024-01-01 10:00:00", "An", "t", False, m, None, False, "2024-01-01", "01012100", None) for i, (m, _, _) in enumerate(both)])
    log = ingest.chat_log(df, "bot")
    assert rows_of(log.select("message_id", "verdict", "next_code")) == sorted(((i, v, c) for i, (_, v, c) in enumerate(both) if v), key=str)
    unanswered = ingest.chat_log(df.withColumn("prior_code", F.lit(None).cast("string")), "bot").where(F.col("message_id").isin(5, 6, 8))
    assert rows_of(unanswered.select("message_id", "verdict", "next_code", "problem")) == [(5, "wrong", "84818099", "hs"), (6, "wrong", "01012100", "hs"), (8, "wrong", None, "hs")]
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" in plan


def test_state_on_disk_is_not_counted_and_settings_come_back(spark):
    names = [name for name, _ in (priors.STATE_STORE, priors.UNCOUNTED)]
    before = [spark.conf.get(name, None) for name in names]
    with pytest.raises(RuntimeError, match="lost"), records._state_on_disk(spark):
        assert [spark.conf.get(name) for name in names] == [priors.STATE_STORE[1], "false"]
        raise RuntimeError("lost")
    assert [spark.conf.get(name, None) for name in names] == before


def test_a_log_of_chat(spark, tmp_path):
    for i, some in enumerate((SAID[:3], SAID[1:5], SAID[4:])):
        messages(spark, some).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = lambda: spark.readStream.schema(messages(spark, SAID).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    tries = []

    def make(batch):
        found = ingest.chat_log(batch, "bot", ["t"])
        if len(tries) == 1:
            # The second batch is written once and fails before it counts as done.
            tries.append("failed")
            found.withColumn("outcome", F.lit("accepted")).write.mode("overwrite").partitionBy("outcome").parquet(str(tmp_path / "out" / "batch=1"))
            raise RuntimeError("lost")
        tries.append("done")
        return found

    run = lambda: ingest.ingest(source(), str(tmp_path / "out"), str(tmp_path / "ck"), "message_id", "at", make)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()
    run().awaitTermination()
    got = ingest.read_log(spark, str(tmp_path / "out")).select("message_id", "hs_code", F.col("as_of_date").cast("string"), "verdict", "staff_name", "next_code")
    assert rows_of(got) == [(1, "01012100", "2024-01-01", "correct", "An", None), (4, "01012100", "2023-12-31", "wrong", "Bo", "02023000")]
    rejected = ingest.read_log(spark, str(tmp_path / "out"), "rejected")
    assert [(r["message_id"], r["problem"]) for r in rejected.collect()] == [(6, "hs")]
    assert tries.count("failed") == 1
