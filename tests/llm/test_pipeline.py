"""The corpus pipeline against the same stages in plain Python."""

import sentencepiece

import corpus_pipeline
from isochron.llm import pieces, quality
from tests.llm import brute


def test_run_equals_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.scores(quality.np.array([model.difference((t or "").encode())]))[0] >= quality.THRESHOLD]
    rows = [(i, t) for i, t, _, _ in brute.dedup_lines(rows)]
    rows = [(i, t) for i, t in rows if brute.jaccard_components(rows)[i, t][1] == i] if len(rows) < 50 else one_each(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute.decontamination(rows, items) if not hit}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    want = {}
    for i, t in rows:
        if i in clean:
            ids = [*library.encode(t), library.eos_id()]
            want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50


def one_each(rows):
    told = brute.jaccard_components(rows)
    return [(i, t) for i, t in rows if told[i, t][1] == i]


def test_stages_take_odd_documents(spark, sf):
    """Nulls, an empty table, repeated rows and more columns pass through every stage with the columns of documents."""
    line = "one line that is longer than twenty characters"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, line, None, "s", 5, 1), (3, line, "en", "s", 9, 1), (3, line, "en", "s", 9, 1), (4, line, "en", "s", 9, 1), (5, line, "en", "s", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, hub int")
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, frame, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or done.columns == docs.columns
            assert done.count() <= frame.count()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]


def test_columns_named_like_helpers(spark, sf):
    """A stage keeps the columns of its documents also where they are named like what it works with."""
    from isochron.llm import decontaminate, ngram_join, quality

    words = " ".join(f"w{i}" for i in range(30))
    names = ["__score", "__id", "__doc", "__digest", "n", "c0"]
    docs = spark.createDataFrame([(1, words, *names), (2, words, *names), (3, "other " * 9, *names), (None, None, *names)], "doc_id bigint, text string, __score string, __id string, __doc string, __digest string, n string, c0 string")
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    for done, want in ((ngram_join.keep_one(docs), {1, 3, None}), (decontaminate.drop_contaminated(docs, items), {3, None}), (quality.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet"), 0.0), {1, 2, 3, None})):
        assert done.columns == docs.columns
        assert {r["doc_id"] for r in done.collect()} == want and {r["__id"] for r in done.collect()} == {"__id"}


def test_a_stage_s_copy_goes_once_the_next_is_written(spark, sf):
    from pathlib import Path

    from isochron.llm.common import shared_folder

    names = {n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    copies = lambda: {p.name for p in folder.iterdir() if p.name.rpartition("-")[0] in names}
    folder.mkdir(parents=True, exist_ok=True)
    before = copies()
    corpus_pipeline.run(spark, sf)
    assert [n.rpartition("-")[0] for n in copies() - before] == ["benchmark-decontamination"]
