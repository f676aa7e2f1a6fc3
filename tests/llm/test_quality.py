"""The compression classifier: held-out accuracy, and what it does with odd input."""

import zlib

from isochron.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Labels are learned from three folds; the fourth, never read in fitting, is told well."""
    got = queries.queries()["op6_quality_classifier"](spark, FOLDER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = sorted((r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels)
    good = [k for k, (_, q) in enumerate(held) if q == 1]
    n = len(held) - len(good)
    area = (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * n)
    right = sum((s >= 0.7) == (q == 1) for s, q in held) / len(held)
    assert area > 0.97 and right > 0.95, (area, right)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    told = [{r["doc_id"]: r["score"] for r in quality.quality_report(docs, x).collect()} for x in (labels, turned)]
    assert told[0] == told[1]


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word " * 100_000, 0.5), (3, "word", 0.5), (None, "word", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.quality_report(docs, known).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert quality.keep_good(docs, known, threshold=0.0).columns == docs.columns
        scored = quality.score(docs, quality.fit(docs, known)).collect()
        by_text = {}
        for r in scored:
            assert by_text.setdefault(r["text"] or "", r["__score"]) == r["__score"]
    assert quality.quality_report(docs.limit(0), labels).count() == 0


def test_the_score_is_a_rising_function_of_the_difference(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    told = [(r["text"] or "", r["__score"]) for r in quality.score(docs, model).collect()]
    plain = sorted((plain_difference(model, t.encode()), s) for t, s in told)
    assert all(a[1] <= b[1] for a, b in zip(plain, plain[1:])) and plain[0][1] < 0.5 < plain[-1][1]


def plain_difference(model, text):
    """The normalised difference by compressors that are made anew for every part."""
    import zstandard

    sizes = []
    for d in (model.bad, model.good):
        pack = lambda part, d=d: zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part)
        sizes.append(sum(len(pack(text[i : i + quality.PART])) for i in range(0, max(1, len(text)), quality.PART)))
    return (sizes[0] - sizes[1]) / sum(sizes)
