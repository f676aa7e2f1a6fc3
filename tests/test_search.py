"""Posting blocks and the vector index against full scans, and words written with their marks apart."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.operators import events, postings, retrieval, vector_index



def keep():
    return F.col("effectiveness") != retrieval.REPEALED


def every_row():
    return F.lit(True)


def made_chunks(spark, n, seed=1):
    """Chunks of words of uneven frequency; few of them are short and full of a rare one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for pid in range(n):
        tokens = rng.choices(words, [1 / (i + 1) for i in range(50)], k=rng.randint(1, 60))
        if pid % 97 == 0:
            tokens = ["w40"] * rng.randint(5, 9)
        rows.append((pid, pid // 4, tokens, None, None, rng.choice(["con_hieu_luc", retrieval.REPEALED])))
    return spark.createDataFrame(rows, "pid bigint, aid bigint, tokens array<string>, effective_from date, effective_to date, effectiveness string")


def hits(df):
    return [tuple(r) for r in df.select("aid", "pid", "rk").orderBy("rk").collect()]


@pytest.mark.parametrize("terms", [["w40"], ["w0", "w45"], ["w40", "w1", "nowhere"], ["nowhere"], []])
def test_blocks_give_the_scan_s_rows(spark, tmp_path, terms):
    chunks = made_chunks(spark, 1500)
    postings.create(chunks, str(tmp_path / "words"), 32)
    for limit in (1, 10):
        assert hits(postings.keyword_branch(spark, str(tmp_path / "words"), terms, keep(), limit)) == hits(retrieval.keyword_branch(chunks.where(keep()), terms, limit))


def test_ranges_out_of_reach_are_not_read(spark, tmp_path):
    path = str(tmp_path / "words")
    postings.create(made_chunks(spark, 6000), path, 32)
    every = postings.bounds(spark, path, ["w40", "w1"])
    wanted = postings.reachable(spark, path, ["w40", "w1"], every_row(), 10)
    blocks = lambda df: df.agg(F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("postings")).first()
    assert blocks(wanted)["ranges"] < 0.5 * blocks(every)["ranges"] and blocks(wanted)["postings"] < 0.5 * blocks(every)["postings"]
    plan = postings._of_terms(spark, path, "postings", ["w40"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_appends_tombstones_and_replacements(spark, tmp_path):
    path, chunks = str(tmp_path / "words"), made_chunks(spark, 400)
    pid = F.col("pid")
    postings.create(chunks.where(pid < 200), path, 32)
    postings.add(chunks.where(pid >= 200), path)
    postings.remove(chunks.where(pid % 4 == 0), path)
    changed = chunks.where(pid % 8 == 1).withColumn("tokens", F.array(F.lit("w40"), F.lit("w3")))
    postings.replace(changed, path)
    postings.remove(chunks.where(pid == 9), path)
    postings.add(chunks.where(pid == 0), path)
    left = chunks.where(((pid % 4 != 0) & (pid % 8 != 1)) | (pid == 0)).unionByName(changed.where(pid != 9))
    for terms in (["w40"], ["w3", "w0"]):
        assert hits(postings.keyword_branch(spark, path, terms, every_row(), 30)) == hits(retrieval.keyword_branch(left, terms, 30))


def made_vectors(spark, n=3000, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, d))
    x = centres[rng.integers(0, 40, n)] + 0.35 * rng.standard_normal((n, d))
    rows = [(i, i // 4, v) for i, v in enumerate(np.float32(x).tolist())] + [(n, 0, None), (n + 1, 0, [0.0] * d)]
    return spark.createDataFrame(rows, "pid bigint, aid bigint, embedding array<float>"), np.float32(x).astype(np.float64)


def test_index_search(spark, tmp_path):
    vectors, x = made_vectors(spark)
    index = vector_index.write_index(vectors, str(tmp_path / "v"))
    again = vector_index.read_index(spark, str(tmp_path / "v"))
    assert again.probes == index.probes and np.allclose(again.centroids, index.centroids)
    assert 1 < index.probes < len(index.centroids) // 2
    query = x[7].tolist()
    full = retrieval.vector_branch_of(index, spark, query, every_row(), 50, len(index.centroids))
    scan = retrieval.vector_branch(vectors, query)
    assert [tuple(r) for r in full.orderBy("rk").collect()] == [tuple(r) for r in scan.orderBy("rk").collect()]
    # Rows without a direction come last in both; few enough rows show them.
    assert retrieval.vector_branch_of(index, spark, query, F.col("pid") >= 2990, 50, len(index.centroids)).where("dist is null").count() == 1
    some = retrieval.vector_branch_of(index, spark, query, every_row())
    assert len({r["pid"] for r in some.collect()} & {r["pid"] for r in scan.collect()}) >= 30
    cells = index.nearest_cells(query)
    read = {f.split("cell=")[1].split("/")[0] for f in index.rows(spark, cells).inputFiles()}
    assert len(cells) == index.probes
    assert "PartitionFilters: [cell" in (plan := index.rows(spark, cells)._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [isnotnull(cell" in plan
    assert read


def test_search_for_many_and_recall(spark, tmp_path):
    vectors, x = made_vectors(spark)
    index = vector_index.write_index(vectors, str(tmp_path / "v"))
    asked = vectors.where((F.col("pid") % 20 == 0) | F.col("embedding").isNull() | (F.col("pid") == 3001)).select(F.col("pid").alias("question"), F.col("embedding").alias("asked"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in vector_index.search_many(index, asked, "question", "asked", probes=len(index.centroids), limit=10).collect():
        got.setdefault(r["question"], []).append((r["rk"], r["pid"]))
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        dist = np.round(1 - unit @ unit[q], 9)
        assert [p for _, p in sorted(found)] == np.lexsort((np.arange(3000), dist))[:10].tolist()
    told = vector_index.recall(index, asked, "question", "asked").first()
    assert (told["questions"], told["wanted"]) == (150, 7500) and told["recall"] >= 0.9


def test_recall_on_the_driver_s_vectors(spark, sf):
    from isochron.plans import catalogue

    assert catalogue.vector_recall(spark, sf).first()["recall"] >= 0.9


def apart(s):
    return unicodedata.normalize("NFD", s)


def test_words_with_marks_apart(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "x string").select(f(F.col("x"))).first()[0]
    for s in ("Thuế suất của hàng hoá nhập khẩu", "đúng là Ấn Độ", "x̌ q̃ a1"):
        assert one(text.word_list, apart(s)) == one(text.word_list, s) == unicodedata.normalize("NFC", s.lower()).split()
        assert one(text.search_terms, apart(s)) == text.query_terms(s) == text.query_terms(apart(s))
    assert one(text.search_terms, apart("thuế suất của hàng")) == ["thuế", "suất", "hàng"]
    for said, verdict in (("Đúng rồi!", "correct"), ("sai rồi", "wrong"), ("không chắc", "unsure"), ("có lẽ", None)):
        assert one(events.verdict_of, apart(said)) == one(events.verdict_of, said) == verdict
    assert one(events.is_correction, apart("mã đúng là 01012100")) is True
    assert one(events.origin_in, apart("van nhật bản")) == "JP"
    for said, code, left in (("van từ tàu", "CN", "van"), ("giấy úc", "AU", "giấy"), ("thép hàn", "KR", "thép"), ("hàng đức", "DE", "hàng"), ("phúc lợi úc", "AU", "phúc lợi"), ("máy anh", "GB", "máy"), ("dây nhật", "JP", "dây"), ("van nhật bản", "JP", "van bản")):
        assert one(lambda m, code=code: events.keyword_in(m, F.lit(code)), said) == left


def plain_density(tokens, groups, weight=0.1):
    """By the definition: all stretches that hold every group and within which none does."""
    import math

    holds = lambda a, b: all(any(t in g for t in tokens[a : b + 1]) for g in groups)
    covers = [(a, b) for a in range(len(tokens)) for b in range(a, len(tokens)) if holds(a, b) and not (b > a and (holds(a + 1, b) or holds(a, b - 1)))]
    known = lambda a, b: sum(any(t in g for g in groups) for t in tokens[a : b + 1])
    return sum(weight / (1 + (b - a + 1 - known(a, b))) for a, b in covers) / (1 + math.log(len(tokens))) if tokens and covers else 0.0


def test_cover_density(spark):
    rng = random.Random(4)
    texts = [rng.choices("abcdefg", k=rng.randint(1, 25)) for _ in range(60)] + [[]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tokens array<string>")
    queries = ([["a"]], [["a", "b"]], [["a"], ["b"]], [["a"], ["b", "c"], ["d"]], [["a"], ["a", "b"]], [["zz"]], [["a"], ["zz"]], [])
    got = df.select("i", *[retrieval.cover_density(F.col("tokens"), q).alias(f"q{k}") for k, q in enumerate(queries)]).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        for k, q in enumerate(queries):
            assert r[f"q{k}"] == pytest.approx(plain_density(t, q) if q else 0.0), (t, q)
    # Worked by hand: words 2 and 5 of ten, two others between them; then the pair side by side.
    ten = spark.createDataFrame([(["x", "tax", "x", "x", "rate", *"xxxxx"],), (["tax", "rate", *"xxxxxxxx"],)], "tokens array<string>")
    values = [r[0] for r in ten.select(retrieval.cover_density(F.col("tokens"), [["tax"], ["rate"]])).collect()]
    assert values == [pytest.approx(0.1 / 3 / 3.302585), pytest.approx(0.1 / 3.302585)]
    both = df.where(F.size("tokens") > 0).select(retrieval.cover_density(F.col("tokens"), [["a", "b"]]).alias("c"), (retrieval.keyword_score(F.col("tokens"), ["a", "b"]) * 0.1).alias("k"))
    assert all(r["c"] == pytest.approx(r["k"]) for r in both.collect())


def test_search_for_many_in_small_bins(spark, tmp_path, monkeypatch):
    """Bins of a few cells, or of a cell's parts: a question sees the rows of the cells it reads and no others."""
    for name, n in (("_ROWS", 200), ("_QUESTIONS", 40), ("_ROWS_AT_ONCE", 64), ("_QUESTIONS_AT_ONCE", 7)):
        monkeypatch.setattr(vector_index, name, n)
    vectors, x = made_vectors(spark, 1200)
    index = vector_index.write_index(vectors, str(tmp_path / "v"), cells=9)
    asked = vectors.where(F.col("pid") % 20 == 0).select(F.col("pid").alias("question"), F.col("embedding").alias("asked"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cell = (x @ index.centroids.T).argmax(axis=1)
    for probes in (2, len(index.centroids)):
        got = {}
        for r in vector_index.search_many(index, asked, "question", "asked", probes=probes, limit=10).collect():
            got.setdefault(r["question"], []).append((r["rk"], r["pid"]))
        for q in range(0, 1200, 20):
            dist = np.where(np.isin(cell, index.nearest_cells(x[q].tolist(), probes)), np.round(1 - unit @ unit[q], 9), np.inf)
            assert [p for _, p in sorted(got[q])] == np.lexsort((np.arange(1200), dist))[:10].tolist()


def test_making_postings_shuffles_no_words(spark, tmp_path):
    """Words are counted where they are read, so what is shuffled doesn't grow with them."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getPath(): f.length() for f in (s.apply(i) for s in [disk.getAllFiles()] for i in range(s.size())) if f.getName().startswith("shuffle")}
    sizes = []
    for repeat in (1, 20):
        chunks = made_chunks(spark, 600).withColumn("tokens", F.flatten(F.array_repeat(F.transform("tokens", lambda t: F.concat(t, F.col("pid").cast("string"))), repeat)))
        before = set(files())
        postings.create(chunks, str(tmp_path / f"words{repeat}"), 32)
        sizes.append(sum(n for k, n in files().items() if k not in before))
    assert sizes[0] < 600 * 40 and sizes[1] < 600 * 40, sizes


def test_postings_of_repeated_ids_and_of_no_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "_TOKENS", 100)
    chunks = made_chunks(spark, 200)
    twice = chunks.unionByName(chunks.where(F.col("pid") < 50)).unionByName(chunks.where(F.col("pid") < 20).withColumn("tokens", F.array(F.lit("w40"), F.lit("w1"))))
    path = str(tmp_path / "words")
    postings.create(twice, path, 32)
    # Equal rows of one id count together: twice the occurrences over the length of one.
    own = twice.where(keep()).groupBy("aid", "pid", F.size("tokens").alias("length")).agg(F.flatten(F.collect_list("tokens")).alias("all"))
    n = F.size(F.filter("all", lambda t: t.isin("w40", "w3")))
    want = own.where(n > 0).select("aid", "pid", F.round(n / (1 + F.log(F.col("length").cast("double"))), 9).alias("s")).orderBy(F.desc("s"), "pid").limit(40).collect()
    got = hits(postings.keyword_branch(spark, path, ["w40", "w3"], keep(), 40))
    assert sorted(r[:2] for r in got) == sorted((r["aid"], r["pid"]) for r in want)
    postings.create(chunks.limit(0), str(tmp_path / "none"), 32)
    assert hits(postings.keyword_branch(spark, str(tmp_path / "none"), ["w40"], keep(), 5)) == []
