"""Benchmark decontamination: a prefix-filtered join of item windows with document words, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut, stored, unused

WINDOW = 10
#: Buckets of the filter that documents' words meet first: at most this many small rows are broadcast, whatever the benchmark's size.
BUCKETS = 1 << 20
#: ASCII that is no digit and no letter separates words; A-Z are lower-cased.
_SEPARATORS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words of a text in order, without empty ones; null gives an empty array.

    One pass turns separators into blanks and A-Z into a-z, so that the split needs no pattern matching.
    """
    flat = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS))
    return F.array_remove(F.split(F.replace(flat, F.lit("\0"), F.lit(" ")), " "), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows of ``size`` words, a shorter item being one window; no words, no window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return w.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), size).alias("window")).distinct()


def exploded(docs: DataFrame) -> DataFrame:
    """(doc, digest, words, pos, word): a row for each word, and one with a null word after the last."""
    w = docs.select("doc", "digest", words_of(F.col("text")).alias("words"))
    return w.select("doc", "digest", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))


def in_buckets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose word falls in a bucket of ``wanted``: at most BUCKETS + 1 rows of one int, broadcast."""
    return rows.withColumn("bucket", bucket(F.col("word"))).join(F.broadcast(wanted.select(bucket(F.col("word")).alias("bucket")).distinct()), "bucket", "left_semi")


def rarities(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, n): how often each word of the windows stands in all documents; 0 if nowhere."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counted = in_buckets(exploded(docs).where(F.col("word").isNotNull()), vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, word, at): each distinct window's rarest word and its place, ties by word, then the first place.

    A window has to be contained whole, so one token is the necessary prefix in the order of rarity.
    """
    placed = windows.select("window").distinct().select("window", F.posexplode("window").alias("at", "word"))
    return placed.join(counts, "word").groupBy("window").agg(F.min(F.struct("n", "word", "at")).alias("least")).select("window", "least.word", "least.at")


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their word counts, hits): a hit is (doc, digest, start, length, window's items)."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    windows = cut(item_windows(items, item_id, item_text, size))
    chosen = cut(prefixes(windows, rarities(source, windows)))
    # The null word's row brings each document's word count through the same scan.
    wanted = chosen.select("word").distinct()
    found = exploded(source).withColumn("bucket", F.when(F.col("word").isNotNull(), bucket(F.col("word"))).otherwise(-1))
    keys = wanted.select(bucket(F.col("word")).alias("bucket")).union(docs.sparkSession.range(1).select(F.lit(-1).alias("bucket"))).distinct()
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    near = found.join(F.broadcast(keys), "bucket", "left_semi").select("doc", "digest", "word", "pos", low.alias("low"), F.when(F.col("word").isNotNull(), F.slice("words", low + 1, F.col("pos") + size - low)).alias("near"))
    near = stored(near, "decontamination")
    start = F.col("pos") - F.col("at")
    length = F.size("window")
    fits = (start >= F.col("low")) & (start - F.col("low") + length <= F.size("near"))
    # The window starts at `start`, its words lie at start - low in the neighbourhood that was cut out.
    pairs = near.where(F.col("word").isNotNull()).join(chosen, "word").where(fits)
    same = F.slice("near", start - F.col("low") + 1, length) == F.col("window")
    found = pairs.where(same).select("doc", "digest", start.alias("start"), "window").distinct()
    named = found.join(windows, "window").select("doc", "digest", "start", F.size("window").alias("length"), "item")
    return near.where(F.col("word").isNull()).select("doc", "digest", F.col("pos").alias("n_words")), named


def decontamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc, digest, n_words, n_hit, n_items, items): what of each document stands in benchmark items.

    A window is ``size`` consecutive words of an item, or all words of a shorter item; every document word inside an
    occurrence of a window is hit. Null texts have no words. A row for each row of ``docs``, also repeated ones and null
    ids: hits are kept by id and text, so rows that share an id but not a text don't mix. Items with a null id are left
    out; an empty benchmark hits nothing; no documents, no rows. Columns of other names in either table are not read.
    """
    counts, named = hits(docs, items, id_col, text_col, item_id, item_text, size)
    covered = named.select("doc", "digest", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n_hit"))
    which = named.select("doc", "digest", "item").distinct().groupBy("doc", "digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = covered.join(which, covered["doc"].eqNullSafe(which["doc"]) & covered["digest"].eqNullSafe(which["digest"])).select(covered["doc"].alias("__doc"), covered["digest"].alias("__digest"), "n_hit", "items")
    joined = counts.join(both, counts["doc"].eqNullSafe(F.col("__doc")) & counts["digest"].eqNullSafe(F.col("__digest")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc", "digest", F.col("n_words").cast("bigint"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items_found).cast("bigint").alias("n_items"), items_found.alias("items"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of op9."""
    done = decontamination(docs, items)
    return done.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any hit, with their own columns, whatever their names.

    Rows are told apart by id and text: of a repeated id only the texts with hits go, rows with a null id by their text.
    A null text has no words and stays.
    """
    doc, digest = unused(docs, "__doc"), unused(docs, "__digest")
    bad = decontamination(docs.select("doc_id", "text"), items).where(F.col("n_hit") > 0).select(F.col("doc").alias(doc), F.col("digest").alias(digest)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(digest)), "left_anti")
