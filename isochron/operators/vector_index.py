"""An inverted-file index over vectors: coarse cells fitted on a bounded sample, every vector filed in its nearest one.

A question reads the cells that lie nearest to it and measures exact distances there. How many cells that takes is
measured when the index is made, on questions from the sample; with all cells read the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of the sample at most, and cells at most, of which each then has several vectors of the sample.
SAMPLE, CELLS = 16_384, 1024
#: Share of the nearest ``NEAREST`` vectors that the cells read by default hold, as measured on the sample.
AIM, NEAREST = 0.95, 50
#: The cell of vectors without a direction; only a search of all cells reads it.
NOWHERE = -1
#: Vectors and questions that meet in one group of a search for many, and those whose distances are held at once.
_ROWS, _QUESTIONS, _ROWS_AT_ONCE, _QUESTIONS_AT_ONCE = 32_768, 2048, 4096, 256
#: Vectors of a cell that one file holds, about.
_FILE_ROWS = 65_536


@dataclass
class Index:
    """Where an index lies, its cells' centroids, and how many cells a search reads unless told otherwise."""

    path: str
    centroids: np.ndarray
    probes: int

    def nearest_cells(self, query: list[float], probes: int | None = None) -> list[int]:
        """The cells to read for a question, the nearest first; all of them, and those of no direction, if that many are asked for."""
        probes = self.probes if probes is None else probes
        if probes >= len(self.centroids):
            return [*range(len(self.centroids)), NOWHERE]
        return np.argsort(-(self.centroids @ _unit(np.array([query], np.float64))[0]), kind="stable")[:probes].tolist()

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        """Indexed rows of some cells; the folders of others are not opened."""
        return spark.read.parquet(f"{self.path}/vectors").where(F.col("cell").isin(cells))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def sampled(vectors: DataFrame, key: str, vector: str, limit: int, n: int | None = None) -> np.ndarray:
    """Unit vectors of the ``limit`` rows with the least hashes of their key: the same ones however the table is dealt.

    A hash threshold from the row count leaves about twice as many rows before they are put in order.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.xxhash64(key).alias("h"))
    n = rows.count() if n is None else n
    share = min(1.0, 2 * limit / max(n, 1))
    low = rows.where(F.col("h") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else rows
    found = low.orderBy("h").limit(limit).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, np.float64) for v in found])
    return _unit(x[np.abs(x).sum(axis=1) > 0]) if len(x) else x.reshape(0, 0)


def fit(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids by k-means on directions; a cell that empties moves to the vector that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ at.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(at)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        at = _unit(sums)
    return at


def probes_for(sample: np.ndarray, centroids: np.ndarray, aim: float = AIM, nearest: int = NEAREST, questions: int = 256) -> int:
    """Cells that a question has to read so that they hold a share ``aim`` of its nearest vectors, measured within the sample.

    The sample is thinner than the table, so its nearest vectors lie farther away and the number is on the safe side.
    """
    asked = sample[:: max(1, len(sample) // questions)][:questions]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
    cell = (sample @ centroids.T).argmax(axis=1)
    close = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :nearest]
    needed = np.sort(np.take_along_axis(place, cell[close], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1


def write_index(vectors: DataFrame, path: str, key: str = "pid", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """File every row of ``vectors`` that has a vector under ``path``, all its columns with ``cell``, and tell the index.

    ``cells`` is the square root of the number of vectors unless given, ``CELLS`` at most. Centroids are fitted on at most
    ``sample`` vectors and sent to the tasks that file the rows; they don't grow with the table. Rows of a cell that
    holds many, as the sample tells, are dealt over several files. All vectors have to be equally long.
    """
    rows = vectors.where(F.col(vector).isNotNull())
    spark = vectors.sparkSession
    n = rows.count()
    known = sampled(rows, key, vector, sample, n)
    wanted = cells or int(np.clip(np.sqrt(n), 1, CELLS))
    centroids = fit(known, wanted) if len(known) else np.zeros((1, 1))
    probes = probes_for(known, centroids) if len(known) else 1
    share = np.bincount((known @ centroids.T).argmax(axis=1), minlength=len(centroids)) / len(known) if len(known) else np.ones(1)
    files = np.append(np.ceil(share * n / _FILE_ROWS).astype(np.int64).clip(1), 8)  # the last is NOWHERE's
    shared = spark.sparkContext.broadcast(centroids)
    names = rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b[vector])
            cell = (x @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            cell = np.where(np.abs(x).sum(axis=1) > 0, cell, NOWHERE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(files[cell], pa.int64())], names=[*names, "cell", "__files"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    filed = rows.mapInArrow(assign, f"{fields}, cell int, __files bigint").repartition("cell", F.pmod(F.xxhash64(key), F.col("__files"))).drop("__files")
    filed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    meta = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(meta, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(path, centroids, probes)


def read_index(spark: SparkSession, path: str) -> Index:
    """The index under ``path``; at most ``CELLS`` centroids come to the driver."""
    meta = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Index(path, np.array([r["centroid"] for r in meta], np.float64), meta[0]["probes"])


def search_many(index: Index, questions: DataFrame, question: str, query: str, key: str = "pid", vector: str = "embedding", probes: int | None = None, limit: int = NEAREST, where: Column | None = None) -> DataFrame:
    """(question, key, dist, rk): for each row of ``questions`` the nearest indexed rows in the cells it reads.

    Questions and rows meet in bins: neighbouring cells that together hold up to ``_ROWS`` rows, or parts of a larger one.
    A question goes once to each bin of the cells it reads, with their numbers, and sees no other rows there. A bin
    passes on the ``limit`` nearest rows of a question. Ties go by key. Questions without a direction find nothing, nor do rows.
    """
    spark = questions.sparkSession
    probes = min(len(index.centroids), index.probes if probes is None else probes)
    stored = spark.read.parquet(f"{index.path}/vectors").where(F.col("cell") != NOWHERE)
    if where is not None:
        stored = stored.where(where)
    held = dict(stored.groupBy("cell").count().collect())  # as many as there are cells
    bins, parts = np.full(len(index.centroids), -1, np.int32), [0]
    room = 0
    for cell in range(len(bins)):
        n = held.get(cell, 0)
        if n:
            if n > room:
                parts.append(-(-n // _ROWS))
                room = _ROWS if n <= _ROWS else 0
            bins[cell] = len(parts) - 1
            room = max(0, room - n)
    dealt = spark.createDataFrame([(c, int(x), parts[x]) for c, x in enumerate(bins) if x > 0], "cell int, bin int, parts int")
    rows = stored.join(F.broadcast(dealt), "cell").select("bin", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), "cell", F.col(key).alias("k"), F.col(vector).alias("v"))
    shared = spark.sparkContext.broadcast((index.centroids, bins))
    slice_rows = max(1, 16_384 // len(parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, bins = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                b = whole.slice(start, slice_rows)
                x = _vectors(b["v"])
                some = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
                order = np.argsort(-(x[some] @ centroids.T), axis=1, kind="stable")[:, :probes]
                at, cell = np.repeat(some, order.shape[1]), order.ravel()
                at, cell = at[bins[cell] > 0], cell[bins[cell] > 0]
                by = np.lexsort((cell, bins[cell], at))
                at, cell, bin_ = at[by], cell[by], bins[cell[by]]
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (bin_[1:] != bin_[:-1]))) if len(at) else np.zeros(0, np.int64)
                cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([b["q"].take(pa.array(at[new])), b["v"].take(pa.array(at[new])), pa.array(bin_[new], pa.int32()), cells], names=["q", "v", "bin", "cells"])

    kinds = {"q": questions.schema[question].dataType.simpleString(), "k": stored.schema[key].dataType.simpleString()}
    asked = questions.where(F.col(query).isNotNull()).select(F.col(question).alias("q"), F.col(query).cast("array<double>").alias("v"))
    lots = F.lit(max(1, -(-asked.count() // _QUESTIONS)))
    asked = asked.mapInArrow(probe, f"q {kinds['q']}, v array<double>, bin int, cells array<int>").join(F.broadcast(dealt.select("bin", "parts").distinct()), "bin")
    asked = asked.select("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("q"), lots).cast("int").alias("lot"), "q", "v", "cells")
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), lots.cast("int") - 1)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        q, k = left["q"].combine_chunks(), right["k"].combine_chunks()
        if not len(q) or not len(k):
            return pa.table({"q": q[:0], "k": k[:0], "dist": pa.array([], pa.float64())})
        by_key = np.argsort(k.to_numpy(zero_copy_only=False), kind="stable")
        x = _unit(_vectors(right["v"].combine_chunks()))[by_key]
        cell_names, cell = np.unique(right["cell"].to_numpy()[by_key], return_inverse=True)
        asked_of, listed = _unit(_vectors(left["v"].combine_chunks())), left["cells"].combine_chunks()
        out = []
        for i in range(0, len(q), _QUESTIONS_AT_ONCE):
            own = listed.slice(i, _QUESTIONS_AT_ONCE)
            reads = np.zeros((len(own), len(cell_names)), bool)
            names, of = own.flatten().to_numpy(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(cell_names, names), len(cell_names) - 1)
            reads[of[cell_names[place] == names], place[cell_names[place] == names]] = True
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for j in range(0, len(x), _ROWS_AT_ONCE):
                dist = np.round(1 - asked_of[i : i + _QUESTIONS_AT_ONCE] @ x[j : j + _ROWS_AT_ONCE].T, 9)
                if not reads.all():
                    dist[~reads[:, cell[j : j + _ROWS_AT_ONCE]]] = np.inf
                far = np.partition(dist, limit - 1, axis=1)[:, limit - 1 : limit] if dist.shape[1] > limit else np.inf
                a, at = np.nonzero((dist <= far) & np.isfinite(dist))
                a, at, d = (np.concatenate(pair) for pair in zip(best, (a, at + j, dist[a, at]), strict=True))
                order = np.lexsort((at, d, a))
                a, at, d = a[order], at[order], d[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < limit
                best = (a[first], at[first], d[first])
            out.append((best[0] + i, by_key[best[1]], best[2]))
        a, at, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": q.take(pa.array(a)), "k": k.take(pa.array(at)), "dist": d})

    where_met = ["bin", "part", "lot"]
    met = asked.groupBy(*where_met).cogroup(rows.groupBy(*where_met)).applyInArrow(nearest, f"q {kinds['q']}, k {kinds['k']}, dist double")
    ranked = met.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("dist", "k"))).where(F.col("rk") <= limit)
    return ranked.select(F.col("q").alias(question), F.col("k").alias(key), "dist", "rk")


def recall(index: Index, questions: DataFrame, question: str, query: str, key: str = "pid", probes: int | None = None, limit: int = NEAREST) -> DataFrame:
    """(questions, wanted, found, recall) of searches at ``probes`` cells, held against searches of all cells."""
    exact = search_many(index, questions, question, query, key, probes=len(index.centroids), limit=limit)
    told = search_many(index, questions, question, query, key, probes=probes, limit=limit).select(question, key, F.lit(1).alias("__hit"))
    both = exact.select(question, key).join(told, [question, key], "left")
    return both.agg(F.count_distinct(question).alias("questions"), F.count(F.lit(1)).alias("wanted"), F.count("__hit").alias("found")).withColumn("recall", F.round(F.try_divide("found", "wanted"), 4))
