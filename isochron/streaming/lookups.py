"""The verdict log as a stream: running summaries, and the last lookup of each person kept with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isochron.operators.events import EXPIRY_SECONDS, verdict_summary


def streaming_summary(log: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """``verdict_summary`` kept up to date; write it in the complete or update mode."""
    return verdict_summary(log, keys, verdict)


def streaming_last_lookup(log: DataFrame, key: str, time: str, event_id: str, lookup: str, late: str = "10 minutes", seconds: int = EXPIRY_SECONDS) -> DataFrame:
    """(key, event_id, time, prior): as the batch form ``last_lookup``, in the order of arrival by micro-batch.

    State is one value for each key, dropped when the watermark passes its expiry, so it doesn't grow with the log. A key's
    rows of one micro-batch are sorted in one task: bound batches at the source. Rows without a time have no prior.
    """
    schema = log.schema
    kinds = {c: schema[c].dataType.simpleString() for c in (key, event_id, time, lookup)}
    span = pd.Timedelta(seconds=seconds)
    # A batch with nulls brings whole numbers as floats; state of a whole-number kind would take those as null.
    plain = int if kinds[lookup] in ("tinyint", "smallint", "int", "bigint") else lambda x: x

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = (state.get[0], pd.Timestamp(state.get[1], unit="us")) if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values([time, event_id], ignore_index=True)
        now = rows[time].astype("datetime64[us]")
        # Each row sees the last lookup before it: of this batch, or of the state where the batch has none yet.
        known = rows.index.to_series().where(rows[lookup].notna()).ffill().shift().to_numpy()
        told = ~pd.isna(known)
        values = [plain(x) if pd.notna(x) else None for x in rows[lookup]]
        since = pd.Series(pd.Timestamp(at) if at is not None else pd.NaT, index=rows.index, dtype="datetime64[us]")
        since[told] = now.to_numpy()[known[told].astype(int)]
        fresh = (now - since <= span).to_numpy()
        prior = [None if not f else values[int(k)] if t else value for f, t, k in zip(fresh, told, known, strict=True)]
        out = pd.DataFrame({key: keys[0], event_id: rows[event_id], time: now, "prior": pd.Series(prior, dtype=object)})
        found = rows[lookup].last_valid_index()
        if found is not None:
            value, at = values[found], pd.Timestamp(now[found])
        if at is not None:
            state.update((value, int(at.value // 1000)))
            expires = int((at + span).value // 1_000_000)
            if expires > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expires)
            else:
                state.remove()
        yield out

    timed = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    output = f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, {time} timestamp, prior {kinds[lookup]}"
    return timed.select(key, event_id, time, lookup).groupBy(key).applyInPandasWithState(step, output, f"value {kinds[lookup]}, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
