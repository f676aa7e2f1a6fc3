"""Importance resampling against plain Python, and the composed CRCs against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from isochron.llm import queries, resample

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text, longest=3):
    w = WORD.findall((text or "").encode().lower())
    return [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, targets, least=20, percent=5, buckets=10_000):
    """{(id, text): (n_features, weight, score, rank)} by strings and zlib."""
    cut = [(i, t, *features(t)) for i, t in docs]
    place = lambda f: zlib.crc32(f) % buckets
    s = Counter(place(f) for _, _, fs, _ in cut for f in fs)
    t = Counter(place(f) for x in targets for f in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text, fs, n in cut:
        weight = sum(gain(place(f)) for f in fs)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_composed_crcs_equal_zlib():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(np.frombuffer("ab9 é-Z\x00".encode(), np.uint8), rng.integers(0, 400)).tobytes()) for _ in range(60)]
    texts += [b"x" * 5000 + b" " + b"y" * 70_000 + b" z", b"a" * 48 + b" " + b"b" * 49, b"", b"--", b"one"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [Counter() for _ in texts]
    for found, rows in resample.feature_buckets(np.frombuffer(b"".join(texts), np.uint8), offsets, 1 << 31, 3):
        for b, r in zip(found.tolist(), rows.tolist(), strict=True):
            got[r][b] += 1
    for text, have in zip(texts, got, strict=True):
        w = WORD.findall(text.lower())
        assert have == Counter(zlib.crc32(b" ".join(w[i : i + n])) % (1 << 31) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_push_is_combination():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 4095, 4096, 300_000):
        a, b = rng.bytes(37), bytes(n)
        pushed = resample.push(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
        assert int(pushed) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_whole_table_equals_strings(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.queries()["op13_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, targets)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_nulls_ties_repeats_and_clashing_names(spark, percent):
    text = "one two three " * 8
    docs = [(i, text) for i in range(6)] + [(3, text), (3, "other " * 30), (None, text), (8, None), (9, ""), (10, "--- !!!"), (11, "short text"), (12, "Wörter äöü 中文 " * 3000)]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id bigint, text string, weight int, place int, id int")
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    got = resample.resample(frame, target, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, ["one two", None], percent=percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "word " * 25)], "doc_id bigint, text string")
    assert resample.resample(none, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, none, percent=100).collect()] == brute([(1, "word " * 25)], [], percent=100)


def test_texts_like_the_target_are_drawn(spark):
    docs = [(i, ("apple pear plum " if i % 10 == 0 else "steel iron zinc ") * 10) for i in range(400)]
    target = spark.createDataFrame([("apple pear plum " * 20,)], "text string")
    drawn = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), target, percent=10).where("rank is not null")
    assert {r["doc_id"] % 10 for r in drawn.collect()} == {0}
