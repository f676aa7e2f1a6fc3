"""Benchmark decontamination on small cases."""

import random

from isochron.llm import decontaminate
from tests.llm import brute


def run(spark, docs, items):
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id bigint, text string, word string, pos int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, item string")
    got = decontaminate.decontamination(frame, bench).collect()
    return sorted(((r["doc"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=str)


def test_equals_looking_everywhere(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(30)]
    docs = []
    for i in range(80):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            parts += rng.choice(items)[1].upper().split()[: rng.randint(1, 30)]
        docs.append((i, rng.choice([" ", "\n", "--"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "\0 ..."), (102, "other text of the same id"), (None, items[-1][1]), (103, "İ é ß"), (104, docs[0][1]), (104, docs[0][1])]
    items += [(50, None), (51, "!!"), (52, "é ß"), (None, "v1")]
    known = [x for x in items if x[0] is not None]
    assert run(spark, docs, items) == sorted(brute.decontamination(docs, known), key=str)


def test_repeats_of_a_word_and_a_long_text(spark):
    items = [(1, "la " * 10), (2, "la la end")]
    text = "la " * 30_000 + "end"
    assert run(spark, [(1, text), (2, "la " * 9)], items) == [(1, 30_001, 30_001, ["1", "2"]), (2, 9, 0, [])]


def test_empty_tables(spark):
    assert run(spark, [(1, "some words")], []) == [(1, 2, 0, [])]
    assert run(spark, [], [(1, "some words")]) == []


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x y z", "a"), (2, "clean words", "b"), (None, None, "c")], "doc_id bigint, text string, item string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "Y Z")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(r["item"] for r in kept.collect()) == ["b", "c"]


def test_no_python_in_the_plan(spark, sf):
    report = decontaminate.decontamination_report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
