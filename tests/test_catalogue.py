"""Every query of the catalogue against its SQL."""

import pytest

import __spark_entry__ as entry
from isochron.plans import catalogue
from tests.oracle import check

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, catalogue.queries()[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_asof_filters_reach_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from isochron.operators.temporal import valid_at

    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("d", F.col("o_orderdate")).where(F.col("o_custkey") == 5)
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan
    batch = catalogue.asof_join(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in batch and "Cartesian" not in batch
    assert valid_at("2020-01-01") is not None


def _recall(items, docs, k=5):
    import re

    words = lambda t: [w for w in re.sub(r"[^\w\s]|_", " ", (t or "").lower()).split()]
    held = {d: set(words(t)) for d, t in docs}
    cases = hits = 0
    for _, t in items:
        terms = {w for w in words(t) if len(w) >= 2}
        found = sorted((-n, d) for d, have in held.items() if (n := len(terms & have)))
        if found:
            cases += 1
            hits += max((-n, d) for n, d in found)[1] in [d for _, d in found[:k]]
    return cases, hits


def test_recall_reads_every_term(spark, sf):
    items = [(1, "one two three four five six"), (2, "nowhere neither never seven eight"), (3, None), (4, "four")]
    docs = [(d, "one two three") for d in range(10)] + [(20, "four five six seven eight one"), (21, "eight"), (22, None), (23, "four")]
    got = catalogue.recall_of(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert [(r["cases"], r["hits"]) for r in got] == [_recall(items, docs)] == [(3, 3)]
    pairs = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    whole = catalogue.queries()["recall_at_k_all_terms"](spark, sf).collect()[0]
    assert (whole["cases"], whole["hits"]) == _recall(pairs("benchmark", "item_id", "text"), pairs("documents", "doc_id", "text"))


def test_recall_counts_a_bounded_number_of_pairs_in_a_task(spark, monkeypatch):
    import random
    from collections import Counter

    pick, words = random.Random(3), [f"w{i}" for i in range(12)]
    said = lambda n: " ".join(pick.choices(words, k=n)) if n else None
    items, docs = [(pick.randrange(9), said(pick.randrange(6))) for _ in range(15)], [(pick.choice([*range(60), None]), said(pick.randrange(9))) for _ in range(90)]
    counts = Counter((i, d) for i, t in items for d, u in docs for _ in set((t or "").split()) & set((u or "").split()))
    frames = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(catalogue, "_PAIRS", 100, raising=False)
    shared = catalogue._common_words(*frames)
    assert {(r["item_id"], r["doc_id"]): r["n"] for r in shared.collect()} == counts
    # 90 documents by the items' ids, 100 pairs a task, and the counts stay where they are made.
    assert shared.rdd.getNumPartitions() == -(-90 * len({i for i, _ in items}) // 100)
    place = lambda d: -1 if d is None else d
    for k in (1, 2, 5, 40):
        hits, asked = 0, {i for i, _ in counts}
        for i in asked:
            found = sorted((-n, place(d)) for (j, d), n in counts.items() if j == i)
            last = max((-n, d) for n, d in found)[1]
            hits += last >= 0 and last in [d for _, d in found[:k]]
        got = catalogue.recall_of(*frames, k).first()
        assert (got["cases"], got["hits"]) == (len(asked), hits)


def test_planted_recall_expects_whole_quotations(spark):
    items = [(1, "one two three"), (2, "four five"), (3, None), (4, "...")]
    docs = [(d, "three two one") for d in range(5)] + [(9, "so: one two three, he said"), (10, None), (11, "four five"), (11, "four five"), (12, "five four ...")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    got = lambda k: tuple(catalogue.planted_recall(frame(items, "item_id"), frame(docs, "doc_id"), k).collect()[0])
    assert got(5) == (2, 1, 0.5) and got(6) == (2, 2, 1.0)
    empty = catalogue.planted_recall(frame(items, "item_id"), frame([], "doc_id")).collect()[0]
    assert (empty["cases"], empty["hits"]) == (0, 0)
