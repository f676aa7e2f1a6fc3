"""Near copies of vectors against all pairs."""

import math

import numpy as np
import pytest

from isochron.llm import vector_dedup


def brute(rows, least=0.98):
    """Rows of the report from (id, label, vector), every two compared."""
    ok = [i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, label, v in rows]
    n, links = len(rows), [set() for _ in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if k else None for k, (_, _, v) in zip(ok, rows, strict=True)]
    groups = {}
    for i in range(n):
        if ok[i]:
            groups.setdefault((rows[i][1], len(rows[i][2])), []).append(i)
    for at in groups.values():
        x = np.stack([unit[i] for i in at])
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[at[a]].add(at[b])
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        reach = None if key is None else min(rows[k][0] for k in seen)
        out.append((key, len(links[i]), reach, key is not None and reach == key))
    return sorted(out, key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], 5, "z") for i, label, v in rows], f"vec_id bigint, label int, embedding array<{kind}>, n int, root string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clusters(seed, centres, spread, sizes, d=32):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        out += [c + rng.standard_normal(d) * spread / math.sqrt(d) for _ in range(size)]
    out += list(rng.standard_normal((centres, d)))
    order = rng.permutation(len(out))
    return [(int(100 + k), int(rng.integers(0, 2)), np.float32(out[o]).tolist()) for k, o in enumerate(order)]


@pytest.mark.parametrize(("window", "block"), [(512, 1024), (16, 7)])
def test_equals_all_pairs(spark, window, block):
    """Groups larger than a window and than a block, and pairs on both sides of the threshold."""
    rows = clusters(window, 150, 0.12, [90, 40, 3, 2, 2, 2, 2, 1])
    got = vector_dedup.near_vectors(frame(spark, rows), window=window, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows_of(got) == brute([(i, label, np.float32(v).tolist()) for i, label, v in rows])


def test_chains_reach_the_least_id(spark):
    turn = math.acos(0.98) * 0.9
    rows = [(50 - k, 1, [math.cos(k * turn), math.sin(k * turn), 0.0]) for k in range(20)]
    got = rows_of(vector_dedup.near_vectors(frame(spark, rows, "double")))
    assert got == brute(rows)
    assert {r[2] for r in got} == {31}


def test_nulls_copies_repeated_ids_and_odd_vectors(spark):
    v, w, nan = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5], float("nan")
    rows = [(1, 1, v), (2, 1, v), (3, 1, [2.0, 4.0, 6.0]), (4, 2, v), (5, None, v), (None, 1, v), (6, 1, None), (7, 1, []), (8, 1, [0.0, -0.0, 0.0]), (9, 1, [1.0, None, 2.0]), (10, 1, [nan, 1.0, 2.0]), (11, 1, [float("inf"), 1.0, 2.0]),
            (12, 1, [1.0, 2.0]), (13, 1, w), (13, 1, w), (13, 1, v), (14, 1, [-1.0, -2.0, -3.0]), (15, 1, [1e-30, 2e-30, 3e-30]), (16, 1, [0.0, 1.0, 0.0]), (17, 1, [-0.0, 1.0, 0.0])]
    got = rows_of(vector_dedup.near_vectors(frame(spark, rows, "double")))
    # A repeated id is one node where it joins two groups, as ids are all that a row is known by.
    want = brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r for r in got if r[0] != 13] == [r for r in want if r[0] != 13]


def test_huge_group_of_copies_and_empty_table(spark):
    rows = [(i, 0, [1.0, 0.5]) for i in range(3000)] + [(3000, 0, [1.0, 0.51])]
    got = rows_of(vector_dedup.near_vectors(frame(spark, rows)))
    assert {r[1] for r in got} == {3000} and {r[2] for r in got} == {0}
    assert vector_dedup.near_vectors(frame(spark, [])).count() == 0


def test_passes_follow_the_number_of_vectors():
    assert vector_dedup.passes_needed(0) == vector_dedup.passes_needed(512) == 1
    assert 1 < vector_dedup.passes_needed(5_000) < vector_dedup.passes_needed(10**9) < 100
