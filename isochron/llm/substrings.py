"""Suffix-array dedup: repeated byte strings of a threshold length, by a depth-limited most-significant-digit radix sort.

Suffixes are only told apart through their first ``LENGTH`` bytes, digit by digit, and a group that a digit leaves with
one member leaves the sort. So that not every suffix has to be shuffled, the first digit of a window is taken at its
anchor (the least hash of its GRAM-byte strings, the same in equal windows): neighbouring windows mostly share their
anchor and move as one row. The passes are

1. buckets by the anchor's bytes, told by a hash: one row for each anchor; most buckets hold one member and are gone;
2. the anchor's context, all bytes its windows cover, by a 128-bit digest under a key drawn anew for each run: where
   contexts are equal, all their windows are repeated, and one member stands for them from here on;
3. buckets with several contexts are sorted by content: the suffixes from each window's start are ordered by their bytes,
   a digit of DIGIT bytes at a time, and what is equal to depth ``LENGTH`` is repeated;
4. buckets too large for one sort are dealt by the keyed digest of the whole window instead, counted in parts.

Hashes of pass 1 only deal suffixes to buckets and filters; strings are equal by their bytes (3) or keyed digest (2, 4).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm import bloom, textkernel
from isochron.llm.common import cut, stored

LENGTH, GRAM = 200, 120
#: Bytes that one pass over a bucket's suffixes orders by, and contexts that a bucket sorted in one task may have.
DIGIT, BUCKET = 8, 1024
#: Bytes of contexts that are sorted together, a last bucket aside.
_SORTED = 1 << 20
#: Anchors that a task counts together before it sends them on.
_FLUSH = 1 << 21


def _anchors(b: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[textkernel.Anchors, np.ndarray, np.ndarray]]:
    """(anchors, their row numbers in the batch, what to add to positions) of each block of a batch."""
    data, offsets = textkernel.column_bytes(b["text"])
    for part, at, rows, shift in textkernel.window_blocks(data, offsets, length):
        found = textkernel.Anchors(part, at, length, gram)
        if len(found.lo):
            yield found, rows[found.rows], shift[found.rows] - at[found.rows]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def identity(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64 bits for an anchor: its document and the start of its first window."""
    seed = textkernel.mix(doc.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + tag.view(np.uint64)
    return textkernel.mix(seed * np.uint64(0xD6E8FEB86659FD93) + lo.astype(np.uint64))


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b["doc"].to_numpy(zero_copy_only=False), b["tag"].to_numpy(zero_copy_only=False)


def _digests(bodies: list[bytes], key: bytes) -> pa.Array:
    return pa.array([hashlib.blake2b(x, digest_size=16, key=key).digest() for x in bodies], pa.binary())


def repeated_suffixes(bodies: list[bytes], buckets: list[int], length: int) -> list[np.ndarray]:
    """For each body the starts of its windows whose bytes another window of its bucket has: a radix sort by content.

    The suffixes of a bucket that have at least ``length`` bytes begin in one group. Each pass orders the groups'
    suffixes by their next DIGIT bytes; suffixes alone in their group drop out, and the passes end at depth ``length``.
    """
    data = np.frombuffer(b"".join(bodies) + bytes(DIGIT), np.uint8)
    digits = np.ndarray((len(data) - DIGIT + 1,), ">u8", data, strides=(1,))
    sizes = np.array([len(x) for x in bodies])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    group = np.array(buckets)[owner]
    for depth in range(0, length, DIGIT):
        step = min(depth, length - DIGIT) if length >= DIGIT else 0
        digit = digits[at + step].astype(np.uint64)
        if length < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - length))
        order = np.lexsort((digit, group))
        at, owner, group, digit = at[order], owner[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])) if len(at) else np.zeros(0, bool)
        group = np.cumsum(new)
        some = np.bincount(group)[group] > 1
        at, owner, group = at[some], owner[some], group[some]
        if not len(at):
            break
    order = np.lexsort((at, owner))
    at, owner = at[order] - begins[owner[order]], owner[order]
    return np.split(at, np.searchsorted(owner, np.arange(1, len(bodies))))


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from rows (gram, doc, tag, lo, body) sorted by gram; buckets are sorted many at a time."""
    bodies: list[bytes] = []
    buckets: list[int] = []
    places: list[tuple] = []

    def spans() -> pa.RecordBatch:
        out: list[tuple] = []
        for starts, (doc, tag, lo) in zip(repeated_suffixes(bodies, buckets, length), places, strict=True):
            if len(starts):
                edges = np.flatnonzero(np.diff(starts) > 1)
                firsts, lasts = starts[np.append(0, edges + 1)].tolist(), starts[np.append(edges, len(starts) - 1)].tolist()
                out += [(doc, tag, lo + i, lo + j + length) for i, j in zip(firsts, lasts, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tag", "a", "b"])

    rows = (x for b in batches for x in zip(*(b[c].to_pylist() for c in ("gram", "doc", "tag", "lo", "body")), strict=True))
    size = 0
    for k, (_, own) in enumerate(groupby(rows, key=lambda x: x[0])):
        members: dict[bytes, tuple] = {}
        for _, doc, tag, lo, body in own:  # a filter may let in copies of a context; those are repeated as a whole already
            members.setdefault(body, (doc, tag, lo))
        if len(members) > 1:
            bodies += members
            buckets += [k] * len(members)
            places += members.values()
            size += sum(map(len, members))
        if size > _SORTED:
            yield spans()
            bodies, buckets, places, size = [], [], [], 0
    if bodies:
        yield spans()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, n_slots: int = bloom.SLOTS) -> DataFrame:
    """(doc, tag, spans): the covered bytes [a, b) of each document with a repeated window, neither merged nor sorted.

    ``docs`` has doc (long), tag (long) and text, without nulls; (doc, tag) tells texts apart. Filters only spare rows
    that can't matter: one let through by mistake is a true window that proves single in an exact comparison.
    """
    context = docs.sparkSession.sparkContext
    key = os.urandom(32)

    def first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(values), pa.array(counts.astype(np.int64))], names=["gram", "n"])

        for b in batches:
            for found, _, _ in _anchors(b, length, gram):
                held.append(found.gram_hash)
            if sum(map(len, held)) > _FLUSH:
                yield flush()
                held.clear()
        if held:
            yield flush()

    grams = docs.select("text").mapInArrow(first_digit, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    shared = context.broadcast(bloom.of_longs(grams, "gram", n_slots))

    def second_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Members(shared.value, n_slots)
        for b in batches:
            doc, tag = _keys(b)
            for found, rows, shift in _anchors(b, length, gram):
                keep = np.flatnonzero(seen(found.gram_hash))
                if len(keep):
                    r = rows[keep]
                    yield pa.RecordBatch.from_arrays([_signed(found.gram_hash[keep]), _digests(found.contexts(keep), key), pa.array(doc[r]), pa.array(tag[r]), pa.array(found.lo[keep] + shift[keep]), pa.array((found.hi - found.lo)[keep].astype(np.int32))], names=["gram", "context", "doc", "tag", "lo", "more"])

    anchors = stored(docs.mapInArrow(second_digit, "gram bigint, context binary, doc bigint, tag bigint, lo bigint, more int"), "anchors")
    contexts = stored(anchors.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "lo")).alias("first")), "contexts")
    equal = anchors.join(contexts.where(F.col("n") > 1).select("gram", "context"), ["gram", "context"]).select("doc", "tag", F.col("lo").alias("a"), (F.col("lo") + F.col("more") + length).alias("b"))

    # One member of each of several contexts around the same anchor goes on to the sort.
    mixed = cut(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1))
    members = contexts.join(mixed.select("gram"), "gram").select("first.*")
    large = mixed.where(F.col("__n") > BUCKET).select("gram")
    large_slots = bloom.sized(large.count(), n_slots)
    hot = context.broadcast(bloom.of_longs(large, "gram", large_slots))

    def identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bloom.Counter2(n_slots)
        for b in batches:
            count.add(identity(*_keys(b), b["lo"].to_numpy(zero_copy_only=False)))
        yield from count.rows()

    open_ = context.broadcast(bloom.collected(members.mapInArrow(identities, bloom.SCHEMA), "once", n_slots))

    def last_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of small buckets with their context's bytes, and of large ones with each window's digest."""
        seen, chosen, crowded = bloom.Members(shared.value, n_slots), bloom.Members(open_.value, n_slots), bloom.Members(hot.value, large_slots)
        for b in batches:
            doc, tag = _keys(b)
            for found, rows, shift in _anchors(b, length, gram):
                keep = np.flatnonzero(seen(found.gram_hash))
                keep = keep[chosen(identity(doc[rows[keep]], tag[rows[keep]], found.lo[keep] + shift[keep]))]
                for some, is_hot in ((keep[~(many := crowded(found.gram_hash[keep]))], False), (keep[many], True)):
                    for k in range(0, len(some), 4096):  # bounds what is held of a bucket's windows
                        part = some[k : k + 4096]
                        bodies, digests, lo = found.contexts(part), None, found.lo[part]
                        if is_hot:
                            counts = (found.hi - found.lo + 1)[part]
                            digests = _digests([x[i : i + length] for x, n in zip(bodies, counts.tolist(), strict=True) for i in range(n)], key)
                            bodies, part = None, np.repeat(part, counts)
                            lo = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts) + found.lo[part]
                        r, none = rows[part], pa.nulls(len(part), pa.binary())
                        yield pa.RecordBatch.from_arrays([_signed(found.gram_hash[part]), none if bodies is None else pa.array(bodies, pa.binary()), none if digests is None else digests, pa.array(doc[r]), pa.array(tag[r]), pa.array(lo + shift[part])], names=["gram", "body", "window", "doc", "tag", "lo"])

    last = stored(docs.mapInArrow(last_digits, "gram bigint, body binary, window binary, doc bigint, tag bigint, lo bigint"), "suffixes")
    sorted_ = last.where(F.col("body").isNotNull()).select("gram", "doc", "tag", "lo", "body").repartition("gram").sortWithinPartitions("gram", "doc", "tag", "lo").mapInArrow(lambda batches: _sort_buckets(batches, length), "doc bigint, tag bigint, a bigint, b bigint")
    windows = last.where(F.col("window").isNotNull()).select("window", "doc", "tag", "lo")
    repeats = cut(windows.groupBy("window").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("window"))
    crowd = windows.join(repeats, "window").select("doc", "tag", F.col("lo").alias("a"), (F.col("lo") + length).alias("b"))
    return equal.unionByName(sorted_).unionByName(crowd).groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, removed, runs = [], [], []
        spans = b["spans"]
        edges = spans.offsets.to_numpy()
        flat = spans.flatten() if spans.null_count or spans.offset else spans.values
        base = edges[0] if (spans.null_count or spans.offset) else 0
        pairs = np.column_stack([flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)])
        for i, text in enumerate(b["text"].cast(pa.binary()).to_pylist()):
            own = pairs[edges[i] - base : edges[i + 1] - base]
            left, n, k = _cut(text, own) if len(own) else (text, 0, 0)
            kept.append(left)
            removed.append(n)
            runs.append(k)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["octets"], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, n_slots: int = bloom.SLOTS) -> DataFrame:
    """(doc_id, n_bytes, kept, n_removed, n_spans): each text as UTF-8 without the bytes of repeated windows.

    A byte goes if a ``length``-byte string over it also starts anywhere else, in the same text too; strings never cross
    texts and are judged on the input. ``kept`` is binary, as a cut may fall inside a character. A null text is empty.
    Every row of ``docs`` is a document of its own, so repeated rows of ``length`` bytes or more lose everything, and
    rows that share an id but not a text are kept apart (by 64 bits of the text); a null id stays null. An empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tag"), "text")
    spans = stored(repeated_spans(keyed.select("doc", "tag", "text"), length, gram, n_slots), "spans")
    touched = docs.sparkSession.sparkContext.broadcast(bloom.of_longs(spans, "doc", n_slots))

    @F.pandas_udf("boolean")
    def maybe(doc):
        import pandas as pd

        return pd.Series(bloom.Members(touched.value, n_slots)(doc.to_numpy().astype(np.int64).view(np.uint64)))

    told = keyed.withColumn("__maybe", maybe("doc"))
    kept = spans.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), "spans")
    joined = told.where("__maybe").join(kept, (F.col("doc") == F.col("__doc")) & (F.col("tag") == F.col("__tag")), "left")
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    cut = joined.select("doc_id", F.octet_length("text").cast("bigint").alias("octets"), "text", F.coalesce("spans", none).alias("spans")).mapInArrow(_apply, "doc_id bigint, n_bytes bigint, kept binary, n_removed bigint, n_spans bigint")
    whole = told.where(~F.col("__maybe")).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.encode("text", "UTF-8").alias("kept"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"))
    return cut.unionByName(whole)


def substring_report(docs: DataFrame) -> DataFrame:
    """The columns of op4."""
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
