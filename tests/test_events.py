"""The verdict log, chat extraction, retrieval gates and the streaming forms."""

import pandas as pd
from pyspark.sql import functions as F

from isochron.operators import events, retrieval
from isochron.streaming import lookups


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "m string").select(column(F.col("m")).alias("x")).collect()[0].x


def test_messages(spark):
    for said, want in (("Đúng rồi!", "correct"), ("sai bét...", "wrong"), ("không chắc", "unsure"), ("đúng là vậy", None), (None, None)):
        assert one(spark, events.verdict_of, said) == want
    for said, want in (("Hàng mới từ máy hàn", None), ("8481.80.99 TQ", "CN"), ("van nhật bản", "JP"), ("UK", "GB"), ("xCNx", None)):
        assert one(spark, events.origin_in, said) == want
    assert one(spark, events.code_in, "mã 8481 80.99 nhé") == "84818099" and one(spark, events.code_in, "mã 84") is None
    assert one(spark, events.is_correction, "Sai, phải là 8481.80.11") and not one(spark, events.is_correction, "saigon")
    assert one(spark, events.keyword_in, "Thuế nhập khẩu van 2024-01-01 bao nhiêu?") == "van"


def test_events_and_corrections(spark):
    raw = spark.createDataFrame([("8481.80.99", " cn", "2026-01-05", " ", "correct", " An ", "x" * 1100, None), ("1", None, "2026-01-05", None, "correct", "An", None, None), ("84818099", None, "2026-02-30", None, "wrong", "An", None, None), ("84818099", None, "2026-02-20", None, "maybe", "An", None, None), ("84818099", None, "2026-02-20", None, "wrong", " ", None, None)], "hs string, origin string, day string, schedule string, verdict string, staff string, note string, snapshot string")
    got = events.normalised_events(raw).collect()
    assert [r.problem for r in got] == [None, "hs", "date", "verdict", "staff"]
    assert (got[0].hs_code, got[0].origin, got[0].schedule, got[0].staff_name, len(got[0].note)) == ("84818099", "CN", None, "An", 1000)
    said = spark.createDataFrame([("84818099", None, "sai, phải là 8481.80.11", "B"), ("84818099", None, "đúng là 8481.80.99", "B"), ("84818099", None, "cảm ơn", "B"), (None, None, "sai rồi nhé", "B")], "code string, day string, m string, who string")
    fixed = [tuple(r)[:4] + (r.next_code,) for r in events.corrections(said, "code", "day", "m", "who", "2026-01-01").collect()]
    assert fixed == [("84818099", "2026-01-01", "wrong", "B", "84818011"), ("84818099", "2026-01-01", "correct", "B", None), (None, "2026-01-01", None, "B", None)]


def test_mentions(spark):
    df = spark.createDataFrame([("@Bot thuế @An van", [(11 - 1, 3), (0, 4), (90, 5)])], "m string, s array<struct<pos: int, len: int>>")
    assert df.select(events.without_mentions(F.col("m"), F.col("s")).alias("x")).collect()[0].x == "thuế van"


def test_merged_candidates(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("a", 0, 5), ("c", 1, 1)], "hs string, source int, place int")
    assert [r.hs for r in events.merged_candidates(df, "hs", "source", "place").collect()] == ["b", "a", "c"]


LOG = [(1, "u", "2024-01-01 00:00:00", 10), (2, "u", "2024-01-01 00:20:00", None), (3, "u", "2024-01-01 00:31:00", None), (4, "v", "2024-01-01 00:05:00", None), (5, "u", "2024-01-01 00:40:00", 20), (6, "u", "2024-01-01 00:41:00", None), (7, "u", "2024-01-01 01:10:00", None)]
KIND = "event_id bigint, user string, ts string, lookup bigint"


def batch(spark):
    log = spark.createDataFrame(LOG, KIND).withColumn("ts", F.col("ts").cast("timestamp"))
    return {r.event_id: r.prior for r in events.last_lookup(log, "user", "ts", "event_id", F.col("lookup")).collect()}


def test_expiring_state(spark):
    assert batch(spark) == {1: None, 2: 10, 3: None, 4: None, 5: None, 6: 20, 7: 20}


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame(LOG, KIND).withColumn("ts", F.col("ts").cast("timestamp"))
    for i, ids in enumerate(((1, 2, 4), (3, 5), (6, 7))):
        log.where(F.col("event_id").isin(*ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = lookups.streaming_last_lookup(stream, "user", "ts", "event_id", "lookup").writeStream.format("memory").queryName("priors").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.event_id: (None if r.prior is None or pd.isna(r.prior) else r.prior) for r in spark.table("priors").collect()}
    assert got == batch(spark)
    counts = lookups.streaming_summary(stream.withColumn("verdict", F.lit("wrong")), ["user"]).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "ck2")).start()
    counts.processAllAvailable()
    counts.stop()
    assert {r.user: r.wrong for r in spark.table("sums").collect()} == {"u": 6, "v": 1}


def test_retrieval_gates(spark):
    rows = [([1, 2], "text", False, [2, 2, 9]), ([], None, False, []), ([1], None, False, []), ([1], "t", False, [7]), ([1], "t", True, [1])]
    df = spark.createDataFrame(rows, "kept array<bigint>, answer string, abstain boolean, cited array<bigint>")
    assert [(r.outcome, r.citations) for r in retrieval.outcome(df).collect()] == [("grounded", [2]), ("abstained", []), ("provisions", [1]), ("ungrounded", [1]), ("provisions", [1])]
    fused = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.8, None), (3, 0.7, 0.6)], "aid int, score double, best_dist double")
    assert [r.aid for r in retrieval.relevant(fused).collect()] == [1]


def test_hydrate(spark):
    fused = spark.createDataFrame([(1, 2, 0.5)], "aid bigint, best_pid bigint, score double")
    nodes = spark.createDataFrame([(1, 7, "Điều 1", "p", "b1", None, None, None), (2, 7, "Khoản 1", "p", "b2", None, None, None)], "id bigint, document_id int, citation_label string, path string, body string, effectiveness string, effective_from date, effective_to date")
    docs = spark.createDataFrame([(7, "1/2024", "t", "u", "con_hieu_luc", None, None)], "id int, number string, title string, source_url string, effectiveness string, effective_from date, effective_to date")
    got = retrieval.hydrate(fused, nodes, docs).collect()[0]
    assert (got.article_citation, got.clause_body, got.effectiveness, got.document_number) == ("Điều 1", "b2", "con_hieu_luc", "1/2024")
