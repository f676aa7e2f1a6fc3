"""Keyword search from posting blocks: an inverted table whose blocks tell the greatest score that they can give.

A chunk's score is the sum of its terms' impacts, occurrences over 1 + ln(length). Postings of a term lie in blocks by
ranges of chunk ids, the same for all terms: a row with the chunks' places in the range and their counts, and the
block's greatest impact, which can be read alone. The bounds of a range sum up, over a question's terms, to the most
that a chunk of it can score; ranges that cannot reach the best scores found so far are never read. A chunk's words are
counted where it is read, so making the table shuffles nothing; what else is known of it lies in a table by chunk.
Chunks are added by appending and taken out by tombstones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isochron.operators.retrieval import BRANCH_ROWS, ranked

#: Chunk ids of one block, folders of terms, and ranges that are read to learn a first threshold.
RANGE, BUCKETS, FIRST = 1024, 64, 16
_FILTERS = ("effective_from", "effective_to", "effectiveness")
#: Scores are compared when rounded to nine places, so a bound has to lie that far below to be out of reach.
_SLACK = 1e-8
#: Tokens that are counted at once in a task, and rows of a batch that it gives.
_TOKENS, _ROWS = 1 << 22, 1 << 16
_BLOCK = "term string, range bigint, slot int, most double, n bigint, at array<int>, times array<int>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _span(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/made").first()["span"]


def _version(spark: SparkSession, path: str) -> int:
    """The number of the last change: what was appended, or taken out, carries it."""
    known = [df.agg(F.max("version")).first()[0] for df in (_postings(spark, path), spark.read.parquet(f"{path}/gone"))]
    return max([0, *[v for v in known if v is not None]])


def _postings(spark: SparkSession, path: str, table: str = "postings") -> DataFrame:
    return spark.read.schema(f"{_BLOCK}, version int, bucket int").parquet(f"{path}/{table}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (range, slot, at, length, tokens), the chunks of each in the order of their places."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b["tokens"]).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _TOKENS, "right")))
            yield from _counted(b.slice(i, j - i))
            i = j


def _counted(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ranges, slots, at, length = (b[c].to_numpy(zero_copy_only=False) for c in ("range", "slot", "at", "length"))
    order = np.lexsort((at, slots, ranges))
    place = np.empty(len(b), np.int64)
    place[order] = np.arange(len(b))
    words = b["tokens"].flatten().dictionary_encode()
    owner = np.repeat(place, pc.list_value_length(b["tokens"]).to_numpy(zero_copy_only=False))
    known = words.is_valid().to_numpy(zero_copy_only=False)
    pairs, times = np.unique(words.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * len(b) + owner[known], return_counts=True)
    if not len(pairs):
        return
    word, chunk = pairs // len(b), order[pairs % len(b)]
    new = np.append(True, (word[1:] != word[:-1]) | (ranges[chunk][1:] != ranges[chunk][:-1]) | (slots[chunk][1:] != slots[chunk][:-1]))
    starts = np.flatnonzero(new)
    most = np.maximum.reduceat(times / (1 + np.log(length[chunk].astype(np.float64))), starts)
    edges = np.append(starts, len(pairs))
    for k in range(0, len(starts), _ROWS):
        own, bounds = starts[k : k + _ROWS], edges[k : k + _ROWS + 1]
        part = slice(bounds[0], bounds[-1])
        lists = [pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(x[part].astype(np.int32))) for x in (at[chunk], times)]
        columns = [words.dictionary.take(pa.array(word[own])), pa.array(ranges[chunk[own]]), pa.array(slots[chunk[own]]), pa.array(most[k : k + _ROWS]), pa.array(np.diff(bounds).astype(np.int64)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "slot", "most", "n", "at", "times"])


def _append(chunks: DataFrame, path: str, span: int, version: int, mode: str) -> None:
    of_chunk = ["aid", "pid", *_FILTERS, "length"]
    rows = chunks.select("aid", F.col("pid").cast("bigint").alias("pid"), *_FILTERS, F.size("tokens").alias("length"), "tokens").where(F.col("pid").isNotNull() & (F.size("tokens") > 0))
    # Rows that share an id and a length count together, those of other lengths are told apart by slots.
    again = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("pid")
    told = rows.withColumn("slot", F.lit(0))
    if not again.isEmpty():
        several = rows.join(again, "pid", "left_semi").groupBy(*of_chunk).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        told = told.join(again, "pid", "left_anti").unionByName(several.withColumn("slot", F.row_number().over(Window.partitionBy("pid").orderBy("length", "aid", *_FILTERS))))
    number = F.lit(version).alias("version")
    told.select(*of_chunk, "slot", number).write.mode(mode).parquet(f"{path}/chunks")
    width = F.lit(span).cast("bigint")
    placed = told.withColumn("range", F.call_function("div", F.col("pid"), width)).select("range", "slot", (F.col("pid") - F.col("range") * width).cast("int").alias("at"), "length", "tokens")
    made = placed.mapInArrow(_blocks, _BLOCK).select("*", number, _bucket(F.col("term")).alias("bucket"))
    made.sortWithinPartitions("bucket", "term", "range").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")


def create(chunks: DataFrame, path: str, span: int = RANGE) -> None:
    """Make the postings of chunks (aid, pid, tokens and what the hard filter needs) under ``path``, in place of any there.

    ``pid`` is a whole number. Chunks without tokens have no postings.
    """
    spark = chunks.sparkSession
    spark.createDataFrame([(span,)], "span int").coalesce(1).write.mode("overwrite").parquet(f"{path}/made")
    spark.createDataFrame([], "pid bigint, version int").write.mode("overwrite").parquet(f"{path}/gone")
    _append(chunks, path, span, 1, "overwrite")


def add(chunks: DataFrame, path: str) -> None:
    """Append chunks. One that is there already has to be taken out first (``replace``). One writer at a time."""
    spark = chunks.sparkSession
    _append(chunks, path, _span(spark, path), _version(spark, path) + 1, "append")


def remove(pids: DataFrame, path: str) -> None:
    """Take chunks (pid) out: a tombstone each, which covers what was added before it."""
    spark = pids.sparkSession
    pids.select(F.col("pid").cast("bigint"), F.lit(_version(spark, path) + 1).alias("version")).distinct().write.mode("append").parquet(f"{path}/gone")


def replace(chunks: DataFrame, path: str) -> None:
    """Put chunks in place of those with their ids."""
    remove(chunks.select("pid"), path)
    add(chunks, path)


def _of_terms(spark: SparkSession, path: str, table: str, terms: list[str]) -> DataFrame:
    """Rows of a question's terms; buckets are told to the planner as numbers, so that other folders aren't opened."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()
    return _postings(spark, path, table).where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms))


def bounds(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(range, bound, n): the most that a chunk of each range can score for the terms, and how many postings that takes to learn."""
    best = _of_terms(spark, path, "postings", terms).groupBy("range", "term").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    return best.groupBy("range").agg(F.sum("most").alias("bound"), F.sum("n").alias("n"))


def _scored(spark: SparkSession, path: str, blocks: DataFrame, keep: Column) -> DataFrame:
    """(aid, pid, score) of the chunks in the blocks of a question's terms that pass ``keep`` and aren't taken out."""
    gone = spark.read.parquet(f"{path}/gone").groupBy("pid").agg(F.max("version").alias("__gone")).withColumnRenamed("pid", "__pid")
    places = blocks.select("range", "slot", "version", F.explode(F.arrays_zip("at", "times")).alias("p"))
    counts = places.select((F.col("range") * F.lit(_span(spark, path)).cast("bigint") + F.col("p.at")).alias("pid"), "slot", "version", F.col("p.times").alias("n"))
    rows = counts.join(spark.read.parquet(f"{path}/chunks").where(keep), ["pid", "slot", "version"])
    rows = rows.join(gone, F.col("pid") == F.col("__pid"), "left").where(F.col("__gone").isNull() | (F.col("version") > F.col("__gone")))
    return rows.groupBy("aid", "pid", "length").agg(F.sum("n").alias("__n")).select("aid", "pid", F.round(F.col("__n") / (1 + F.log(F.col("length").cast("double"))), 9).alias("score"))


def reachable(spark: SparkSession, path: str, terms: list[str], keep: Column, limit: int, first: int = FIRST) -> DataFrame:
    """(range, bound, n) of the ranges that have to be read for the best ``limit`` chunks.

    The ``first`` ranges of greatest bound are read for a threshold, the last of the best scores there; ranges whose
    bound lies below it can't change the result. Rows that the hard filter or a tombstone takes out set no threshold.
    """
    all_ranges = bounds(spark, path, terms)
    ahead = [r["range"] for r in all_ranges.orderBy(F.desc("bound"), "range").limit(first).collect()]
    found = _scored(spark, path, _of_terms(spark, path, "postings", terms).where(F.col("range").isin(ahead)), keep).orderBy(F.desc("score"), "pid").limit(limit).collect() if ahead else []
    if len(found) < limit:
        return all_ranges
    return all_ranges.where(F.col("bound") + _SLACK >= F.lit(found[-1]["score"]))


def keyword_branch(spark: SparkSession, path: str, terms: list[str], keep: Column, limit: int = BRANCH_ROWS) -> DataFrame:
    """(aid, pid, rk, dist null): as ``retrieval.keyword_branch`` over the chunks that pass ``keep``, from posting blocks.

    ``keep`` is the hard filter, over effective_from, effective_to and effectiveness. No terms, no rows.
    """
    ranges = reachable(spark, path, terms or [""], keep, limit) if terms else bounds(spark, path, [""])
    blocks = _of_terms(spark, path, "postings", terms or [""]).join(ranges.select("range"), "range", "left_semi")
    return ranked(_scored(spark, path, blocks, keep), [F.desc("score"), F.asc("pid")], limit).select("aid", "pid", "rk", F.lit(None).cast("double").alias("dist"))
