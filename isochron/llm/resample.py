"""Target-distribution importance resampling over hashed word n-grams, whose CRCs are composed from those of their words.

The CRC-32 of a text AB is that of A, pushed through as many zero bytes as B has, xor that of B. Pushing is linear over
GF(2), so it is a 32 x 32 bit matrix for each length. A word's CRC is computed once; those of its two- and three-word
runs follow by tables of these matrices, and no run is ever put together as a string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import ranked_table
from isochron.llm.textkernel import blocks, column_bytes, lower_ascii, separator_table, words

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
_BREAKS = separator_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_SPACE = zlib.crc32(b" ")
#: Bytes of a word whose CRC goes column by column; the few longer words are taken one by one.
_COLUMNS = 48


def _byte_table() -> np.ndarray:
    """What one byte does to a register: CRC-32's reflected polynomial, as zlib has it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_BYTE = _byte_table()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix a * b over GF(2); a matrix is the images of the 32 unit vectors, low bit first."""
    out = np.zeros(32, np.uint32)
    for i in range(32):
        out ^= np.where(b >> np.uint32(i) & np.uint32(1), a[i], np.uint32(0))
    return out


def _matrices(levels: int) -> list[list[np.ndarray]]:
    """[level][digit]: the push through digit * 64**level zero bytes, as four tables by the bytes of a register."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _BYTE[unit & np.uint32(255)] ^ unit >> np.uint32(8)
    found = []
    for _ in range(levels):
        power, tables = unit, []
        for _ in range(64):
            by_byte = np.zeros((4, 256), np.uint32)
            for k in range(4):
                for bit in range(8):
                    by_byte[k] ^= np.where(np.arange(256) >> bit & 1, power[8 * k + bit], np.uint32(0))
            tables.append(by_byte)
            power = _product(step, power)
        step = power
        found.append(np.stack(tables))
    return found


#: Six levels of base-64 digits: pushes through any length below 2**36.
_PUSH = _matrices(6)


def push(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as ``lengths`` says."""
    out = crcs.astype(np.uint32)
    for level, tables in enumerate(_PUSH):
        digit = lengths >> 6 * level & 63
        at = np.flatnonzero(digit)
        if level and not len(at):
            if not (lengths >> 6 * level).any():
                break
            continue
        c, d = out[at], digit[at]
        out[at] = tables[d, 0, c & 255] ^ tables[d, 1, c >> 8 & 255] ^ tables[d, 2, c >> 16 & 255] ^ tables[d, 3, c >> 24]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: one byte of all words at a time, the longest words first so that those left are a prefix."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    left = np.searchsorted(-lengths[order], -np.arange(1, _COLUMNS + 1), "right")
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    first = starts[order]
    for i in range(_COLUMNS):
        n = left[i]
        if not n:
            break
        state[:n] = _BYTE[(state[:n] ^ data[first[:n] + i]) & 255] ^ state[:n] >> np.uint32(8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    long = np.flatnonzero(lengths > _COLUMNS)
    if len(long):
        raw = memoryview(data.tobytes())
        out[long] = [zlib.crc32(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, rows) of all runs of one word, then of two, and so on up to ``longest``."""
    text = lower_ascii(data)
    starts, ends, rows = words(text, offsets, _BREAKS)
    lengths = ends - starts
    own = word_crcs(text, starts, ends)
    # A blank and the word behind it, by which a run grows.
    grown = push(np.full(len(own), _SPACE, np.uint32), lengths) ^ own
    run = own
    for size in range(1, longest + 1):
        if size > 1:
            same = rows[: len(rows) - size + 1] == rows[size - 1 :]
            run = push(run[: len(run) - 1], lengths[size - 1 :] + 1) ^ grown[size - 1 :]
            yield (run[same] % np.uint32(buckets)).astype(np.int64), rows[: len(same)][same]
        else:
            yield (run % np.uint32(buckets)).astype(np.int64), rows
        if len(rows) <= size:
            return


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket: each task sums up its own, and ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, part, at in blocks(*column_bytes(b.column(0))):
                for found, _ in feature_buckets(part, at, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(F.col(text_col)).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, both smoothed by one; p the target's share, q the source's."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """All columns of ``docs``, named c0, c1, ..., with ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains."""
    names, at_text = docs.columns, docs.columns.index(text_col)
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = table.value
        for b in batches:
            sums = np.zeros((3, b.num_rows), np.int64)
            for i, j, part, at in blocks(*column_bytes(b.column(at_text))):
                for size, (found, rows) in enumerate(feature_buckets(part, at, len(gained), longest)):
                    n = np.bincount(rows, minlength=j - i)
                    sums[0, i:j] += n * (size == 0)
                    sums[1, i:j] += n
                    # Rows come in order, so the sums of their runs are exact whole numbers.
                    cumulated = np.concatenate([[0], np.cumsum(gained[found])])
                    edges = np.concatenate([[0], np.cumsum(n)])
                    sums[2, i:j] += cumulated[edges[1:]] - cumulated[edges[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in sums]], names=[*b.schema.names, "n_words", "n_features", "weight"])

    fields = ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names)))
    return wide.mapInArrow(apply, f"{fields}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: a draw without replacement of texts like ``target``.

    Features are runs of 1 to ``longest`` words; a text's weight sums the log ratio of its features' shares among all
    target texts and among all of ``docs``. Its score adds Gumbel noise made from seed and id, so the greatest scores
    are a draw in proportion to the weights. Of the N rows with ``least_words`` words the first floor(percent N / 100)
    in the order of score (ties: lesser id) have a rank from 1; it is null for all others.

    Null and wordless texts have no features and weight 0. Rows with a null id count among ``docs`` but have neither
    score nor rank and are none of the N. Rows that share an id share their noise and are drawn one by one. Without
    target texts, or without rows, all is as the formula gives. Other columns, whatever their names, are left out.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    wanted = target.select(F.col(f"`{target_text}`").alias("text"))
    gain = gains(bucket_counts(read, "text", buckets, longest), bucket_counts(wanted, "text", buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("c0").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(read, gain, "text", longest).select(F.col("c0").alias("id"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = scored.withColumn("drawable", F.col("id").isNotNull() & (F.col("n_words") >= least_words))
    table = ranked_table(scored, [F.desc("drawable"), F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_features")], "place", "resampled")
    drawn = table.where("drawable").count() * percent // 100
    rank = F.when(F.col("drawable") & (F.col("place") <= drawn), F.col("place"))
    return table.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def resampling_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op13."""
    return resample(docs, benchmark)
