"""Running state over ordered rows of any length: a prefix scan by segments.

A window over a whole document puts it into one task. Here a document is cut into segments of its order, each of which
gives a summary of what it does to the state; the summaries of a document, one row a segment, are run through in order,
and every segment resumes from what came before it. Rows are sorted within their segment only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of an order that make one segment.
SEGMENT = 1 << 15


@dataclass
class State:
    """One running value: its name, how it runs, and the column that it runs over."""

    name: str
    kind: str
    value: Column


def count(name: str, test: Column) -> State:
    """How many rows so far pass ``test``, this one included."""
    return State(name, "count", test)


def last(name: str, value: Column) -> State:
    """The last ``value`` so far that isn't null, this row's included."""
    return State(name, "last", value)


def greatest(name: str, value: Column) -> State:
    """The greatest ``value`` so far, this row's included."""
    return State(name, "greatest", value)


def before(name: str, value: Column) -> State:
    """The ``value`` of the row before, whatever it is."""
    return State(name, "before", value)


def after(name: str, value: Column) -> State:
    """The ``value`` of the next row, whatever it is."""
    return State(name, "after", value)


def running(rows: DataFrame, keys: list[str], states: list[State], order: str = "ord", size: int = SEGMENT) -> DataFrame:
    """``rows`` with a column for each state, in the order of ``order``, a whole number that rows of a key don't share.

    ``rows`` is read twice, for the summaries and for the result, so what is dear to make should be written first.
    Rows with a null key or order are left out. States don't see each other; a value that restarts at a mark can be told by the
    place of the last mark, as in ``last("mark", F.when(test, F.col(order)))``.
    """
    seg = F.call_function("div", F.col(order).cast("bigint"), F.lit(size).cast("bigint"))
    cut = rows.withColumn("__seg", seg)
    place = F.col(order)

    summaries = []
    for i, s in enumerate(states):
        held = {
            "count": F.count_if(s.value), "greatest": F.max(s.value), "last": F.max_by(F.struct(s.value.alias("v")), F.when(s.value.isNotNull(), place)),
            "before": F.max_by(F.struct(s.value.alias("v")), place), "after": F.min_by(F.struct(s.value.alias("v")), place),
        }[s.kind]
        summaries.append(held.alias(f"__s{i}"))
    told = cut.groupBy(*keys, "__seg").agg(*summaries)
    by_seg = Window.partitionBy(*keys).orderBy("__seg")
    so_far = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for i, s in enumerate(states):
        c = F.col(f"__s{i}")
        carried.append({"count": lambda c=c: F.coalesce(F.sum(c).over(so_far), F.lit(0)), "greatest": lambda c=c: F.max(c).over(so_far), "last": lambda c=c: F.last(c, ignorenulls=True).over(so_far), "before": lambda c=c: F.lag(c).over(by_seg), "after": lambda c=c: F.lead(c).over(by_seg)}[s.kind]().alias(f"__c{i}"))
    resumed = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__seg").alias("__of"), *carried)

    inner = Window.partitionBy(*keys, "__seg").orderBy(order)
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = {"count": F.count_if, "greatest": F.max, "last": lambda v: F.last(v, ignorenulls=True), "before": lambda v: F.lag(F.struct(v.alias("v"))), "after": lambda v: F.lead(F.struct(v.alias("v")))}
    here = cut.select("*", *[local[s.kind](s.value).over(inner if s.kind in ("before", "after") else run).alias(f"__l{i}") for i, s in enumerate(states)])
    same = F.col("__seg") == F.col("__of")
    for i, k in enumerate(keys):
        same = (F.col(k) == F.col(f"__k{i}")) & same
    joined = here.join(resumed, same)
    out = []
    for i, s in enumerate(states):
        mine, theirs = F.col(f"__l{i}"), F.col(f"__c{i}")
        out.append({"count": lambda m=mine, t=theirs: m + t, "greatest": lambda m=mine, t=theirs: F.greatest(m, t), "last": lambda m=mine, t=theirs: F.coalesce(m, t["v"]), "before": lambda m=mine, t=theirs: F.coalesce(m, t)["v"], "after": lambda m=mine, t=theirs: F.coalesce(m, t)["v"]}[s.kind]().alias(s.name))
    return joined.select(*[F.col(c) for c in rows.columns], *out)


def carried(rows: DataFrame, keys: list[str], place: str, ties: list[Column], value: Column, name: str, size: int = SEGMENT) -> DataFrame:
    """``rows`` with the last ``value`` so far that isn't null, in the order of a whole number ``place`` that rows may share.

    Rows of one place lie in one segment and go in the order of ``ties``. Segments are ``size`` places long, so what a
    task sorts is a key's rows of as many places.
    """
    cut = rows.withColumns({"__seg": F.floor(F.col(place) / F.lit(size)).cast("bigint"), "__value": value})
    held = F.col("__value").isNotNull()
    told = cut.where(held).groupBy(*keys, "__seg").agg(F.max_by("__value", F.struct(place, *[t.alias(f"t{i}") for i, t in enumerate(ties)])).alias("__of"))
    # Each segment's last value counts from the next segment that has rows on.
    every = cut.select(*keys, "__seg").distinct().join(told, [*keys, "__seg"], "left")
    resumed = every.select(*keys, "__seg", F.last("__of", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    run = Window.partitionBy(*keys, "__seg").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumn("__here", F.last("__value", ignorenulls=True).over(run)).join(resumed, [*keys, "__seg"])
    return here.select(*[F.col(c) for c in rows.columns], F.coalesce("__here", "__before").alias(name))
