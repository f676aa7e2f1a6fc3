"""Bitemporal operators: closed valid-time intervals whose null end is open, and append-only transaction time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.operators import scan

FAR = "9999-12-31"


def _day(day: Column | str | date) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def valid_at(day: Column | str | date | None, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Whether ``day`` lies in [start, end]; both ends count, a null end never ends. A null start is not valid.

    Without a day it is today, by the session's time zone.
    """
    d = F.current_date() if day is None else _day(day)
    return (F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) >= d))


def live(column: str = "superseded_at") -> Column:
    """Rows that no later row has replaced."""
    return F.col(column).isNull()


def asof_join(events: DataFrame, rates: DataFrame, keys: list[str], day: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Join each event with the rates in force on its day.

    The keys are equal in both tables, so the interval is the residual of a hash or merge join, never of a nested loop.
    """
    condition = None
    for k in keys:
        part = events[k] == rates[k]
        condition = part if condition is None else condition & part
    inside = (rates[start] <= events[day]) & (rates[end].isNull() | (rates[end] >= events[day]))
    return events.join(rates, condition & inside, how).drop(*[rates[k] for k in keys])


def asof_disjoint(events: DataFrame, rates: DataFrame, keys: list[str], day: str, start: str, end: str, size: int = 4096) -> DataFrame:
    """``asof_join`` for rates that don't overlap within a key, in linear work however many rows share a key.

    Rates and events of a key are one sequence by day, a rate before the events of its first day; each event takes the
    last rate begun, if that has not ended by then. The sequence runs from segment to segment of ``size`` days
    (``scan.carried``), so a hot key is spread over tasks and never makes events times rates. Rates that overlap break
    the rule that one is in force at a time (``overlap_flags`` finds them); then only the one begun last is told, and of
    several begun on a day the one that orders last. Events without a rate, a day or a key are left out.
    """
    values = [c for c in rates.columns if c not in keys]
    days = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    rate = rates.where(F.col(start).isNotNull()).select(*keys, days(start).cast("bigint").alias("__day"), F.struct(*[F.col(c) for c in values]).alias("__rate"), F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("__event"))
    event = events.where(F.col(day).isNotNull()).select(*keys, days(day).cast("bigint").alias("__day"), F.lit(None).cast(rate.schema["__rate"].dataType).alias("__rate"), F.struct("*").alias("__event"))
    told = scan.carried(rate.unionByName(event), keys, "__day", [F.col("__event").isNotNull(), F.col("__rate")], F.col("__rate"), "__last", size)
    inside = F.col(f"__last.{end}").isNull() | (F.col(f"__last.{end}") >= F.col(f"__event.{day}"))
    found = told.where(F.col("__event").isNotNull() & F.col("__last").isNotNull() & inside)
    return found.select(*[F.col(f"__event.{c}").alias(c) for c in events.columns], *[F.col(f"__last.{c}").alias(c) for c in values])


def asof_spread(events: DataFrame, rates: DataFrame, keys: list[str], day: str, start: str, end: str, span: int = 64) -> DataFrame:
    """``asof_join`` for rates that may overlap: both sides are dealt by key and stretch of ``span`` days.

    An event lies in one stretch. A rate goes to each that it touches within its key's events, so an open end doesn't
    reach beyond them. A hot key so becomes many keys, each with the rates in force around its days alone.
    """
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / F.lit(span)).cast("int")
    placed = events.withColumn("__stretch", stretch(F.col(day)))
    reach = placed.groupBy(*keys).agg(F.min("__stretch").alias("__lo"), F.max("__stretch").alias("__hi"))
    first, last = F.greatest(stretch(F.col(start)), "__lo"), F.least(F.coalesce(stretch(F.col(end)), F.col("__hi")), F.col("__hi"))
    dealt = rates.join(reach, keys).where(first <= last).withColumn("__stretch", F.explode(F.sequence(first, last))).drop("__lo", "__hi")
    return asof_join(placed, dealt, [*keys, "__stretch"], day, start, end).drop("__stretch")


def split_around(base: DataFrame, cuts: DataFrame, keys: list[str], start: str, end: str, value: str, cut_start: str, cut_end: str, cut_value: str) -> DataFrame:
    """Replace each interval that a cut falls into by its pieces before, during and after the cut.

    ``cuts`` has at most one row for each key. A piece without a day is left out; intervals that the cut misses, or
    without a cut, come back whole. ``piece`` tells them apart: before, during, after or whole.
    """
    named = cuts.select(*keys, F.col(cut_start).alias("__from"), F.col(cut_end).alias("__to"), F.col(cut_value).alias("__value"))
    joined = base.join(named, keys, "left")
    open_end = F.coalesce(F.col(end), F.lit(FAR).cast("date"))
    cut_open = F.coalesce(F.col("__to"), F.lit(FAR).cast("date"))
    hit = F.col("__from").isNotNull() & (F.col("__from") <= open_end) & (cut_open >= F.col(start))

    def piece(name: str, a: Column, b: Column, v: Column) -> Column:
        return F.struct(F.lit(name).alias("piece"), a.alias("a"), b.alias("b"), v.alias("v"))

    last = F.when(open_end < cut_open, F.col(end)).otherwise(F.col("__to"))
    pieces = F.when(hit, F.array(
        piece("before", F.col(start), F.date_sub("__from", 1), F.col(value)),
        piece("during", F.greatest(start, "__from"), last, F.col("__value")),
        piece("after", F.date_add("__to", 1), F.col(end), F.col(value)),
    )).otherwise(F.array(piece("whole", F.col(start), F.col(end), F.col(value))))
    exploded = joined.withColumn("__p", F.explode(pieces)).where(F.col("__p.a").isNotNull() & (F.col("__p.b").isNull() | (F.col("__p.a") <= F.col("__p.b"))))
    exploded = exploded.where((F.col("__p.piece") != "after") | (F.col("__p.a") <= open_end))
    others = [c for c in base.columns if c not in (start, end, value)]
    return exploded.select(*others, F.col("__p.a").alias(start), F.col("__p.b").alias(end), F.col("__p.v").alias(value), F.col("__p.piece").alias("piece"))


def overlap_flags(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Rows whose interval meets an earlier one of its key: the running maximum of ends reaches their start.

    One sort by key, however many intervals a key has; it flags rows, where a self join would list pairs.
    """
    before = Window.partitionBy(*keys).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__reach", F.max(F.coalesce(F.col(end), F.lit(FAR).cast("date"))).over(before)).where(F.col("__reach") >= F.col(start)).drop("__reach")


def overlap_pairs(df: DataFrame, keys: list[str], start: str, end: str, row_id: str) -> DataFrame:
    """(keys, first, second): every two rows of a key whose closed intervals meet, the lesser ``row_id`` first."""
    a, b = df.alias("a"), df.alias("b")
    same = F.col(f"a.{row_id}") < F.col(f"b.{row_id}")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    far = F.lit(FAR).cast("date")
    meet = (F.col(f"a.{start}") <= F.coalesce(F.col(f"b.{end}"), far)) & (F.col(f"b.{start}") <= F.coalesce(F.col(f"a.{end}"), far))
    return a.join(b, same & meet).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{row_id}").alias("first"), F.col(f"b.{row_id}").alias("second"))


def staleness(facts: DataFrame, day: str, recorded: str = "recorded_at", lag_days: int = 48, snapshot: str | None = None) -> DataFrame:
    """One row: the snapshot date (the newest record, or the day itself without any), how far it is to be trusted, and
    whether ``day`` lies beyond that."""
    latest = facts.agg(F.max(recorded).cast("date").alias("__d"))
    known = F.coalesce(F.lit(snapshot).cast("date"), F.col("__d"), F.lit(day).cast("date"))
    through = F.date_sub(known, lag_days)
    warning = F.concat(F.lit(f"{day} lies within the gazette's lag of the data: snapshot "), known.cast("string"), F.lit(", reliable through "), through.cast("string"))
    stale = F.lit(day).cast("date") > through
    return latest.select(F.lit(day).alias("day"), known.cast("string").alias("snapshot_date"), through.cast("string").alias("reliable_through"), stale.alias("stale"), F.when(stale, warning).alias("warning"))


def supersede(facts: DataFrame, gone: DataFrame, row_id: str, when: Column, column: str = "superseded_at") -> DataFrame:
    """The next snapshot of an append-only table: live rows named in ``gone`` get their one stamp, all else stays."""
    marked = gone.select(F.col(row_id).alias("__gone")).distinct()
    joined = facts.join(marked, F.col(row_id) == F.col("__gone"), "left")
    return joined.withColumn(column, F.when(F.col("__gone").isNotNull() & F.col(column).isNull(), when).otherwise(F.col(column))).drop("__gone")


def annual_intervals(df: DataFrame, rates: str, years: list[int], single: tuple[str, str]) -> DataFrame:
    """A row for each rate cell: calendar years where there is a cell for each, else one interval with the first cell.

    ``irregular`` marks rows whose number of cells fits neither form. Rows without cells are left out.
    """
    fits = F.size(rates) == len(years)
    yearly = F.transform(F.col(rates), lambda r, i: F.struct(r.alias("rate"), F.make_date(F.lit(years[0]) + i, F.lit(1), F.lit(1)).alias("effective_from"), F.make_date(F.lit(years[0]) + i, F.lit(12), F.lit(31)).alias("effective_to")))
    one = F.array(F.struct(F.element_at(rates, 1).alias("rate"), F.lit(single[0]).cast("date").alias("effective_from"), F.lit(single[1]).cast("date").alias("effective_to")))
    rows = df.where(F.size(rates) > 0).withColumn("__i", F.explode(F.when(fits, yearly).otherwise(one)))
    return rows.select(*[c for c in df.columns if c != rates], F.col("__i.rate").alias("rate"), F.col("__i.effective_from").alias("effective_from"), F.col("__i.effective_to").alias("effective_to"), (~fits & (F.size(rates) > 1)).alias("irregular"))
