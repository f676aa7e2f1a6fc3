"""Connected components of a link table, by label propagation over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) reaches; nodes without a link don't appear.

    Large-star and small-star steps in turn: each node's larger neighbours, then each node and its smaller ones, are
    re-hung on the least node around. The paths between labels shrink at every round, so few rounds suffice; each is
    written to the shared folder in place of the one before, and it ends when a round changes nothing. An empty table gives no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(F.col("u") != F.col("v")).distinct()
        after = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # Two distinct sets of equal size are the same if nothing of one is missing in the other.
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        discard(edges)
        edges = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
