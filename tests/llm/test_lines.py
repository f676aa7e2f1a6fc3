"""Line dedup on small cases."""

import random

import pytest

from isochron.llm import lines
from tests.llm import brute

LINE = "a line of more than twenty characters"


@pytest.mark.parametrize("n_slots", [8, 1 << 14])
def test_equals_counting(spark, n_slots):
    """A filter far too small only lets more lines through to the exact count."""
    rng = random.Random(n_slots)
    pool = [f"line number {k:03d} of the pool" for k in range(40)] + ["short", "", "  Line Number 001 of the POOL\t", "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "k", "z") for i, t in rows], "doc_id bigint, text string, key string, id string")
    done = lines.dedup_lines(docs, n_slots=n_slots)
    assert done.columns == ["doc_id", "text", "key", "id", "__n_lines", "__n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in done.collect()) == brute.dedup_lines(rows)


def test_nulls_repeated_rows_and_the_owner(spark):
    rows = [(1, LINE + "\nown words"), (2, f"{LINE}\n  {LINE.upper()} "), (3, LINE + "\n" + LINE), (3, LINE), (None, LINE), (4, None), (5, "")]
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in done.collect()), key=str)
    assert got == sorted([(1, "own words", 2, 1), (2, "", 2, 2), (3, LINE + "\n" + LINE, 2, 0), (3, LINE, 1, 0), (None, LINE, 1, 0), (4, None, 1, 0), (5, "", 1, 0)], key=str)


def test_two_documents_are_too_few(spark):
    docs = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE)], "doc_id bigint, text string")
    assert {r["__n_dropped"] for r in lines.dedup_lines(docs).collect()} == {0}


def test_long_text_and_empty_table(spark):
    text = "\n".join(f"numbered line {i:08d} of a long text" for i in range(60_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["__n_dropped"] for r in lines.dedup_lines(docs).collect()} == {0: 60_000, 1: 60_000, 2: 0}
    assert lines.dedup_lines(docs.limit(0)).count() == 0
