"""The last lookup of each person in event order: rows wait in stretches of time until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.operators.events import EXPIRY_SECONDS

#: The state store that these operators are meant for; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Counting its rows takes one more read for each that is put or removed; without, progress tells no ``numRowsTotal``.
UNCOUNTED = ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def _carried(span: int):
    """Rows (key, since, list of (at, id, lookup) in order) to one row for each entry not before ``since``, with the last
    lookup before it in its list; none of more than ``span`` microseconds ago."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, group = b["rows"].flatten(), pc.list_parent_indices(b["rows"]).to_numpy()
            at, lookup = rows.field("at").to_numpy(), rows.field("lookup")
            places = np.arange(len(group))
            last = np.maximum.accumulate(np.where(lookup.is_valid().to_numpy(zero_copy_only=False), places, -1))
            before = np.concatenate(([-1], last[:-1]))[: len(group)]
            known = before >= np.searchsorted(group, group)  # not of the list before
            known &= at - at[before] <= span
            prior = lookup.take(pa.array(np.where(known, before, 0), mask=~known))
            own = pa.array(at >= b["since"].to_numpy()[group])
            made = pa.RecordBatch.from_arrays([b["key"].take(pa.array(group)), rows.field("id"), rows.field("at"), prior], names=["key", "id", "at", "prior"])
            yield made.filter(own)

    return told


def streaming_priors(log: DataFrame, key: str, time: str, event_id: str, lookup: str, late: str = "10 minutes", seconds: int = EXPIRY_SECONDS, slices: int = 4) -> DataFrame:
    """(key, event_id, time, prior): as the batch form ``events.last_lookup``, in event order, however rows arrive within ``late``.

    Time is cut into stretches of ``seconds / slices``. A key's rows of a stretch are told once the watermark has passed
    its end, so that no earlier one can come any more; rows of stretches told before are dropped. Lookups also go to the
    stretches within ``seconds`` after their own, where the last of them is kept: so no stretch needs another one, and all
    is one aggregation by key and sliding window. State is the rows of stretches that wait and one value for each stretch
    that a lookup reaches (``STATE_STORE`` keeps it in RocksDB); it doesn't grow with the log. What one call holds are a
    key's rows of a stretch. Rows with a null key or time are left out.
    """
    kinds = {c: log.schema[c].dataType.simpleString() for c in (key, event_id, lookup)}
    step = -(-seconds * 1_000_000 // slices)
    timed = log.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(event_id).alias("id"), F.col(lookup).alias("lookup")).withWatermark("time", late)
    at, since = F.unix_micros("time"), F.unix_micros("stretch.end") - step
    entry = F.struct(at.alias("at"), "id", "lookup")
    # The last part of each window is its stretch; what lies before it counts for lookups only.
    dealt = timed.withColumn("stretch", F.window("time", f"{step * (slices + 1)} microseconds", f"{step} microseconds")).where((at >= since) | F.col("lookup").isNotNull())
    held = dealt.groupBy("key", "stretch").agg(F.collect_list(F.when(at >= since, entry)).alias("own"), F.max(F.when(at < since, entry)).alias("carried")).where(F.size("own") > 0)
    lists = held.select("key", since.alias("since"), F.concat(F.filter(F.array("carried"), lambda r: r.isNotNull()), F.array_sort("own")).alias("rows"))
    told = lists.mapInArrow(_carried(seconds * 1_000_000), f"key {kinds[key]}, id {kinds[event_id]}, at bigint, prior {kinds[lookup]}")
    return told.select(F.col("key").alias(key), F.col("id").alias(event_id), F.timestamp_micros("at").alias(time), "prior")
