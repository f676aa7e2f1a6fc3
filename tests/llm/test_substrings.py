"""Suffix dedup against a table of all windows."""

import random

import pytest

from isochron.llm import queries, substrings
from tests.llm import brute


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, doc string, tag int")
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in substrings.dedup_substrings(docs, **options).collect()), key=str)


def wanted(rows, length):
    told = brute.repeated_bytes([t for _, t in rows], length)
    return sorted(((i, len((t or "").encode()), *x) for (i, t), x in zip(rows, told, strict=True)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 70), (103, "xy" * 40), (104, "短い" * 15), (104, "long enough to be of use here, twice"), (None, "long enough to be of use here, twice"), (105, rows[3][1]), (105, rows[3][1])]
    assert run(spark, rows, length=20, gram=12) == wanted(rows, 20)


def test_whole_table_with_production_parameters(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.queries()["op4_suffix_array_dedup"](spark, sf).collect()}
    for (i, t), (left, n, runs) in zip(docs, brute.repeated_bytes([t for _, t in docs], 200), strict=True):
        assert got[i] == (len((t or "").encode()), n, runs, brute.sha(left))
    assert sum(x[1] for x in got.values()) > 0


def test_passages_across_the_edges_of_blocks(spark):
    rng = random.Random(5)
    filler = "".join(f"{rng.getrandbits(64):016x}" for _ in range(140_000))
    passage = "<" + "".join(rng.choice("ghijklmnop") for _ in range(498)) + ">"
    edge = (1 << 20) - 250
    text = filler[:edge] + passage + filler[edge:]
    got = run(spark, [(1, text), (2, "[" + passage + "]")])
    assert got == [(1, len(text), filler.encode(), 500, 1), (2, 502, b"[]", 500, 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_strings_of_equal_rolling_hash_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(flip, "".join("ab"[b ^ flip] for b in bits)) for flip in (0, 1)]
    assert run(spark, rows, length=1024, gram=1024) == wanted(rows, 1024)
    assert wanted(rows, 1024)[0][3] == 0


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", 1)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh") for _ in range(25))
    rows = [(i, "".join(rng.choice("ijkl") for _ in range(rng.randint(0, 9))) + passage + "".join(rng.choice("ijkl") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    assert run(spark, rows, length=20, gram=12) == wanted(rows, 20)


@pytest.mark.parametrize("seed", range(60))
def test_suffixes_in_buckets(seed):
    rng = random.Random(seed)
    length = rng.choice([3, 8, 9, 13, 20, 24])
    bodies = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(length, length + 15))) for _ in range(rng.randint(1, 9))})
    buckets = [rng.randint(0, 2) for _ in bodies]
    seen = {}
    for x, k in zip(bodies, buckets, strict=True):
        for i in range(len(x) - length + 1):
            seen[k, x[i : i + length]] = seen.get((k, x[i : i + length]), 0) + 1
    told = [[i for i in range(len(x) - length + 1) if seen[k, x[i : i + length]] > 1] for x, k in zip(bodies, buckets, strict=True)]
    assert [x.tolist() for x in substrings.repeated_suffixes(bodies, buckets, length)] == told
