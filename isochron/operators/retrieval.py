"""Hybrid retrieval: keyword and vector branches under hard filters, fused by reciprocal ranks at article level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isochron.operators.temporal import valid_at
from isochron.operators.vector_index import Index

#: The fusion constant, rows of a branch, rows of the result, citations, greatest relevant distance.
FUSION, BRANCH_ROWS, TOP, CITATIONS, GREATEST_DISTANCE = 12, 50, 6, 5, 0.58
REPEALED = "het_hieu_luc"


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 minus the cosine, in doubles; null for a null or zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    product = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - product / F.nullif(norm * F.lit(length), F.lit(0.0))


def keyword_score(tokens: Column, terms: list[str]) -> Column:
    """Occurrences of any term over 1 + ln(length): in a query of alternatives each occurrence is a cover of its own."""
    hits = F.size(F.filter(tokens, lambda t: t.isin(*terms)))
    return hits / (1 + F.log(F.size(tokens).cast("double")))


def cover_density(tokens: Column, groups: list[list[str]], weight: float = 0.1) -> Column:
    """Cover density of a query in a text, over 1 + ln(length): ``groups`` all have to occur, each by any of its words.

    A cover is a shortest stretch of the text with a word of every group: none within it is one. Each counts ``weight``
    over 1 + the words in it that are none of the query's. With one group, a query of alternatives, each occurrence is a
    cover of its own, and the value is ``keyword_score`` times the weight. No cover, or no groups, gives 0.

    The words of the query are gone through once, with the last place of each group: a place that moves the earliest of
    these on ends a cover that begins there.
    """
    n = len(groups)
    size = 1 + F.log(F.size(tokens).cast("double"))
    if not n or not all(groups):
        return F.lit(0.0)
    which = lambda t: F.filter(F.array(*[F.when(t.isin(*g), F.lit(i)) for i, g in enumerate(groups)]), lambda x: x.isNotNull())
    marked = F.filter(F.transform(tokens, lambda t, i: F.struct(i.cast("int").alias("at"), which(t).alias("of"))), lambda x: F.size(x["of"]) > 0)
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("begun"), F.array().cast("array<struct<a: int, b: int>>").alias("covers"))

    def step(s, x):
        last = F.transform(s["last"], lambda old, i: F.when(F.array_contains(x["of"], i.cast("int")), x["at"]).otherwise(old))
        first = F.array_min(last)
        ends = (first >= 0) & (first > s["begun"])
        return F.struct(last.alias("last"), F.when(ends, first).otherwise(s["begun"]).alias("begun"), F.when(ends, F.concat(s["covers"], F.array(F.struct(first.alias("a"), x["at"].alias("b"))))).otherwise(s["covers"]).alias("covers"))

    covers = F.aggregate(marked, start, step)["covers"]
    held = lambda c: F.size(F.filter(marked, lambda x: (x["at"] >= c["a"]) & (x["at"] <= c["b"])))
    value = F.aggregate(covers, F.lit(0.0), lambda s, c: s + F.lit(weight) / (1 + (c["b"] - c["a"] + 1 - held(c))))
    return F.coalesce(value / size, F.lit(0.0))


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, numbered from 1. The limit comes first, so only its rows meet in one window."""
    return df.orderBy(*order).limit(limit).withColumn("rk", F.row_number().over(Window.orderBy(*order)))


def passes(day: str) -> Column:
    """The hard filter of both branches: valid on the day and not repealed."""
    return valid_at(day) & (F.col("effectiveness") != REPEALED)


def in_force(chunks: DataFrame, day: str) -> DataFrame:
    """Chunks that pass the hard filter."""
    return chunks.where(passes(day))


def keyword_branch(chunks: DataFrame, terms: list[str], limit: int = BRANCH_ROWS) -> DataFrame:
    """(aid, pid, rk, dist null) of the best chunks with any of the terms; no terms, no rows."""
    found = chunks.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False))
    scored = found.select("aid", "pid", F.round(keyword_score(F.col("tokens"), terms or [""]), 9).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("pid")], limit).select("aid", "pid", "rk", F.lit(None).cast("double").alias("dist"))


def write_postings(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the inverted table of chunks with tokens, once at load: a row for each term of a chunk, with its count.

    Rows lie in folders by a bucket of the term, sorted by it, so a question reads the few row groups of its own terms.
    What the hard filter needs is kept with each row.
    """
    rows = chunks.select("aid", "pid", "effective_from", "effective_to", "effectiveness", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    counted = rows.groupBy("term", "aid", "pid", "effective_from", "effective_to", "effectiveness", "length").agg(F.count(F.lit(1)).alias("n"))
    bucketed = counted.withColumn("bucket", _bucket(F.col("term"), buckets))
    bucketed.repartition("bucket", F.pmod(F.xxhash64("pid"), F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def keyword_branch_of(postings: DataFrame, terms: list[str], limit: int = BRANCH_ROWS, buckets: int = 64) -> DataFrame:
    """``keyword_branch`` from the inverted table: the same rows and ranks, without a look at any chunk."""
    if not terms:
        return ranked(postings.where(F.lit(False)).select("aid", "pid", F.lit(0.0).alias("score")), [F.desc("score"), F.asc("pid")], limit).select("aid", "pid", "rk", F.lit(None).cast("double").alias("dist"))
    wanted = postings.where(F.col("bucket").isin(*{r[0] for r in _buckets_of(postings, terms, buckets)}) & F.col("term").isin(*terms))
    scored = wanted.groupBy("aid", "pid", "length").agg(F.sum("n").alias("__n")).select("aid", "pid", F.round(F.col("__n") / (1 + F.log(F.col("length").cast("double"))), 9).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("pid")], limit).select("aid", "pid", "rk", F.lit(None).cast("double").alias("dist"))


def _buckets_of(postings: DataFrame, terms: list[str], buckets: int) -> list:
    """Buckets of a question's terms as plain numbers, so that folders can be pruned when the query is planned."""
    return postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets)).collect()


def vector_branch(chunks: DataFrame, query: list[float], limit: int = BRANCH_ROWS) -> DataFrame:
    """(aid, pid, rk, dist) of the nearest chunks, by exact distances."""
    scored = chunks.where(F.col("embedding").isNotNull()).select("aid", "pid", F.round(cosine_distance(F.col("embedding"), query), 9).alias("dist"))
    return ranked(scored, [F.asc_nulls_last("dist"), F.asc("pid")], limit).select("aid", "pid", "rk", "dist")


def vector_branch_of(index: Index, spark: SparkSession, query: list[float], keep: Column, limit: int = BRANCH_ROWS, probes: int | None = None) -> DataFrame:
    """``vector_branch`` from an inverted-file index: the nearest of the rows that pass ``keep`` in the cells that lie nearest
    to the question, by exact distances. With as many probes as there are cells the rows and ranks are those of a full scan."""
    return vector_branch(index.rows(spark, index.nearest_cells(query, probes)).where(keep), query, limit)


def fuse(keyword: DataFrame, vector: DataFrame, top: int = TOP) -> DataFrame:
    """One row for each article: each branch counts once, by its best chunk, as 1 / (12 + rank)."""
    both = keyword.unionByName(vector)
    grouped = both.groupBy("aid").agg(
        F.min(F.when(F.col("dist").isNull(), F.col("rk"))).alias("kw_rk"),
        F.min(F.when(F.col("dist").isNotNull(), F.col("rk"))).alias("vec_rk"),
        F.min("dist").alias("best_dist"),
        F.bool_or(F.col("dist").isNull()).alias("kw_hit"),
        F.min(F.struct("rk", "pid"))["pid"].alias("best_pid"),
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (FUSION + F.col(c)), F.lit(0.0))
    return grouped.withColumn("score", F.round(part("kw_rk") + part("vec_rk"), 9)).orderBy(F.desc("score"), "aid").limit(top)


def hydrate(fused: DataFrame, provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts and validity of the few fused articles; the article's own validity goes before its document's."""
    art = provisions.select(F.col("id").alias("aid"), F.col("document_id").alias("__doc"), F.col("citation_label").alias("article_citation"), F.col("path"), F.col("body").alias("article_body"), F.col("effectiveness").alias("__e"), F.col("effective_from").alias("__f"), F.col("effective_to").alias("__t"))
    clause = provisions.select(F.col("id").alias("best_pid"), F.col("citation_label").alias("clause_citation"), F.col("body").alias("clause_body"))
    doc = documents.select(F.col("id").alias("__doc"), F.col("number").alias("document_number"), F.col("title").alias("document_title"), F.col("source_url").alias("gazette_url"), F.col("effectiveness").alias("__de"), F.col("effective_from").alias("__df"), F.col("effective_to").alias("__dt"))
    joined = fused.join(art, "aid").join(clause, "best_pid").join(doc, "__doc")
    chosen = {"effectiveness": F.coalesce("__e", "__de"), "effective_from": F.coalesce("__f", "__df").cast("string"), "effective_to": F.coalesce("__t", "__dt").cast("string")}
    return joined.withColumns(chosen).drop("__e", "__f", "__t", "__de", "__df", "__dt", "__doc").orderBy(F.desc("score"), "aid")


def relevant(fused: DataFrame, greatest: float = GREATEST_DISTANCE, limit: int = CITATIONS) -> DataFrame:
    """The gate: only articles near enough in meaning; a keyword hit alone is no reason. Nothing left means abstaining."""
    return fused.where(F.col("best_dist") <= greatest).orderBy(F.desc("score"), "aid").limit(limit)


def valid_citations(cited: Column, known: Column) -> Column:
    """Distinct cited ids that were retrieved, in the order cited."""
    return F.array_distinct(F.filter(cited, lambda x: F.array_contains(known, x)))


def outcome(answers: DataFrame) -> DataFrame:
    """The four outcomes of rows (kept array, answer, abstain, cited array): ``outcome`` and ``citations``.

    abstained: nothing relevant; provisions: no answer was made; ungrounded: it cites nothing retrieved, so the prose is
    dropped; grounded: the answer with the cited articles.
    """
    good = valid_citations(F.col("cited"), F.col("kept"))
    kind = (
        F.when(F.size("kept") == 0, "abstained")
        .when(F.col("abstain") | F.col("answer").isNull() | (F.col("answer") == ""), "provisions")
        .when(F.coalesce(F.size(good), F.lit(0)) <= 0, "ungrounded")
        .otherwise("grounded")
    )
    return answers.withColumn("outcome", kind).withColumn("citations", F.when(F.col("outcome") == "grounded", F.filter("kept", lambda x: F.array_contains(good, x))).otherwise(F.col("kept"))).withColumn("answer", F.when(F.col("outcome") == "grounded", F.col("answer")).otherwise(F.lit("")))


def recall_at_k(ranked_hits: DataFrame, expected: DataFrame, case: str, item: str, k: int) -> DataFrame:
    """(cases, hits, recall): the share of cases of which any expected item is among the first k; null without cases."""
    hit = ranked_hits.where(F.col("rk") <= k).join(expected, [case, item], "left_semi").select(case).distinct().withColumn("__hit", F.lit(1))
    per_case = expected.select(case).distinct().join(hit, case, "left")
    return per_case.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("__hit"), F.lit(0)).cast("bigint").alias("hits")).withColumn("recall", F.round(F.try_divide("hits", "cases"), 6))
