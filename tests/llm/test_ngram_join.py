"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.llm import ngram_join, textkernel
from tests.llm import brute


def corpus(seed, n):
    """Texts of a few families of near copies, with exact copies, short, empty and null ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three"), (n + 6, "ß É"), (n + 7, "ß é")]


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, hub string, n int, token int")
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()]


def wanted(rows):
    told = brute.jaccard_components(rows)
    return sorted(((i, *told[i, t]) for i, t in rows), key=str)


def test_equals_all_pairs(spark):
    rows = corpus(1, 150)
    assert sorted(result(spark, rows), key=str) == wanted(rows)


def test_blocks_of_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF_DOCS", 4)
    rows = corpus(2, 120)
    assert sorted(result(spark, rows), key=str) == wanted(rows)


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, other), (9, other), (3, text + " tail"), (None, text), (None, None)]
    assert sorted(result(spark, rows), key=str) == wanted(rows)


def test_the_limit_is_exact(spark):
    # 7 shingles of which 6 are shared by sets of 7: 6 / 8 = 0.75 links; of sets of 6 and 5 shared: 5 / 7 does not.
    links = [(1, "a b c d e f g h i j k"), (2, "b c d e f g h i j k l")]
    apart = [(3, "m n o p q r s t u v"), (4, "n o p q r s t u v w")]
    assert sorted(result(spark, links + apart)) == [(1, 7, 1), (2, 7, 1), (3, 6, 3), (4, 6, 4)]


def test_a_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(250_000))
    rows = [(1, text), (2, text + " more words at the very end of it"), (3, "short one")]
    assert sorted(result(spark, rows)) == [(1, 249_996, 1), (2, 250_004, 1), (3, 1, 3)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_keep_one_keeps_columns(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text, "x"), (4, text, "y"), (1, None, "z"), (None, text, "n")], "doc_id bigint, text string, component_id string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in kept.collect()) == [(0, "n"), (1, "z"), (4, "y")]


@pytest.mark.parametrize("seed", range(4))
def test_tree_bounds_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, int(rng.integers(5, 150)))) for _ in range(120)]
    sets += [np.unique(np.append(s, rng.choice(pool, 3))) for s in sets[:40]]
    tree = ngram_join.CountTree(np.stack([ngram_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets]))
    for s in sets:
        found = set(tree.search(ngram_join.counts_of(s), len(s)).tolist())
        assert {i for i, x in enumerate(sets) if ngram_join.linked((s, s), (x, x))} <= found


def test_words_that_collide_under_any_polynomial_modulo_a_power_of_two(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert sorted(result(spark, [(1, one), (2, two)])) == [(1, 1, 1), (2, 1, 2)]


@pytest.mark.parametrize("length", [1, 7, 8, 9, 15, 16, 17, 40])
def test_names_of_words_are_distinct_and_depend_on_their_bytes_alone(length):
    rng = random.Random(length)
    words = sorted({bytes(rng.choice(b"\0ab\xff") for _ in range(n)) for n in range(1, length + 1) for _ in range(300)})
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    named = textkernel.WordNames(b"s" * 64)
    a, b = named.words(data, ends - [len(w) for w in words], ends)
    assert len({*zip(a.tolist(), b.tolist(), strict=True)}) == len(words)
    for i in (0, len(words) // 2, len(words) - 1):
        alone = named.words(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))
        assert (alone[0][0], alone[1][0]) == (a[i], b[i])


def test_most_repeated_tokens_are_bounded(spark):
    counts = spark.range(20_000).select(F.col("id").alias("token"), F.when(F.col("id") < 50, F.col("id") + 1000).when(F.col("id") < 9000, F.lit(40)).otherwise(F.lit(2)).cast("bigint").alias("times"))
    every = {r["token"]: r["times"] for r in counts.collect()}
    for limit in (10, 60, 5000, 9000, 50_000):
        got = dict(ngram_join.most_repeated(counts, limit))
        assert len(got) <= 1.3 * limit and all(every[t] == n for t, n in got.items())
        assert limit < 60 or set(range(50)) <= set(got)
        assert len(got) >= 0.5 * min(limit, len(every))
    assert ngram_join.most_repeated(counts.limit(0), 10) == []


def written_rows(monkeypatch):
    """Rows of each table that the join writes, by its columns, in the order written."""
    found, keep = [], ngram_join.stored

    def told(df, label):
        out = keep(df, label)
        found.append((label, out.columns, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stored", told)
    monkeypatch.setattr(ngram_join, "cut", lambda df: told(df, "cut"))
    return found


def test_one_or_two_shingles_shared_by_chance_make_no_block(spark, monkeypatch):
    words = lambda i: [f"d{i}x{k}" for k in range(20)]
    # Each document has a run of six words, two shingles, of the one before it, and linked copies lie among them.
    rows = [(i, " ".join(words(i)[:14] + words(i - 1)[14:20])) for i in range(60)] + [(60, " ".join([*words(7)[:14], *words(6)[14:20], "tail"]))]
    found = written_rows(monkeypatch)
    assert sorted(result(spark, rows), key=str) == wanted(rows)
    assert max(n for _, columns, n in found if columns == ["hub", "doc"]) == 2


def test_copies_send_no_tokens(spark, monkeypatch):
    texts = [" ".join(f"c{i}x{k}" for k in range(40)) for i in range(20)]
    found = written_rows(monkeypatch)
    n = []
    for copies in (1, 6):
        rows = [(20 * c + i, t) for c in range(copies) for i, t in enumerate(texts)]
        assert sorted(result(spark, rows), key=str) == wanted(rows)
        n.append(next(k for label, _, k in reversed(found) if label == "tokens"))
    assert n[0] == n[1]


@pytest.mark.parametrize("seed", range(2))
def test_slices_copies_and_repeated_ids(spark, monkeypatch, seed):
    for name, n in (("SLICE", 200), ("LEAST_SLICE", 60), ("POINT_ROWS", 20)):
        monkeypatch.setattr(ngram_join, name, n)
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefgh") for _ in range(rng.randint(6, 14))] for _ in range(6)]
    rows = []
    for i in range(70):
        base = list(rng.choice(bases))
        if rng.random() < 0.6:
            base.insert(rng.randrange(len(base)), rng.choice("abcdefgh"))
        rows.append((rng.randrange(60), " ".join(base)))
    assert sorted(result(spark, rows), key=str) == wanted(rows)
