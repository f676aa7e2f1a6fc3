"""The verdict log written by a stream: each message counts once, also when a batch is repeated after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isochron.operators import events


def chat_log(messages: DataFrame, me: str, allowed: list[str] | None = None, today: str | None = None) -> DataFrame:
    """Verdict events of chat messages: those to be answered, whose whole text is a verdict or that correct the last answer.

    ``messages`` is as ``events.answerable`` takes it, with ``day`` of the message, and ``prior_code`` and ``prior_day``
    of the sender's last lookup. The rows are ``events.normalised_events``' with ``next_code``, which is to be looked up next.
    """
    told = events.answerable(messages, me, allowed)
    verdict, fix = events.verdict_of(F.col("message")), events.code_in(F.col("message"))
    # Of the rows that stay, those without a verdict of their own correct the last answer.
    correcting = verdict.isNull()
    said = F.coalesce(verdict, F.when(fix == F.col("prior_code"), "correct").otherwise("wrong"))
    day = F.coalesce("prior_day", F.lit(today) if today else F.col("day").cast("string"))
    own = tuple(c for c in ("message_id", "at") if c in messages.columns)
    raw = told.where(verdict.isNotNull() | events.is_correction(F.col("message"))).select(
        *own, F.when(correcting & fix.isNotNull() & ~fix.eqNullSafe(F.col("prior_code")), fix).alias("next_code"), F.col("prior_code").alias("hs"), F.lit(None).cast("string").alias("origin"), day.alias("day"),
        F.lit(None).cast("string").alias("schedule"), said.alias("verdict"), F.col("sender").alias("staff"), F.substring("message", 1, 1000).alias("note"), F.lit(None).cast("string").alias("snapshot"),
    )
    return events.normalised_events(raw, (*own, "next_code"))


def ingest(messages: DataFrame, path: str, checkpoint: str, message_id: str, time: str, make: Callable[[DataFrame], DataFrame], late: str = "10 minutes") -> StreamingQuery:
    """Start writing the rows that ``make`` gives for a stream of messages to ``path``, until all that is there is read.

    A message id counts once within ``late``. A batch is a folder of its own number and replaces what an earlier try
    left there, so a batch that failed after its write, or whose checkpoint was lost behind it, doubles nothing.
    Rows with a ``problem`` go to ``rejected`` beside ``accepted``.
    """
    once = messages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([message_id])

    def write(batch: DataFrame, number: int) -> None:
        rows = make(batch)
        marked = rows.withColumn("outcome", F.when(F.col("problem").isNull(), "accepted").otherwise("rejected"))
        marked.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, outcome: str = "accepted") -> DataFrame:
    """The rows written so far, of one outcome."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("outcome") == outcome).drop("batch", "outcome")
