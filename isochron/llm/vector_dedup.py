"""Embedding near-dedup: passes of sorted random hashes find what belongs together, blocks of each component count its links.

A pass orders the vectors of a label by 64 sign hashes of random directions, one after the other, and compares each
vector with its neighbours in that order. Vectors of a small angle share a long run of hashes in most passes, so they
come close in one of them; how many passes are made follows from the number of vectors. Verified pairs of all passes
are united to components. Neighbour windows are bounded, so a vector of a large group doesn't meet all of it there:
within each component every two vectors are compared afterwards, block by block, and only counts leave a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import discard, stored
from isochron.llm.components import components

LEAST, WINDOW, MISS, SEED = 0.98, 512, 1e-4, 7
#: Hashes of a key, and vectors of one component that are compared with as many others at a time.
BITS, BLOCK = 64, 1024


def passes_needed(n: int, window: int = WINDOW, least: float = LEAST, miss: float = MISS) -> int:
    """Passes after which a pair of cosine ``least`` among n vectors has met in no window with a probability of ``miss``.

    A hash tells two such vectors apart with probability acos(least) / pi, and after log2(n / window) common hashes no
    more than a window lies between them.
    """
    alike = (1 - math.acos(least) / math.pi) ** math.ceil(max(0.0, math.log2(max(n, 1) / window)))
    return 1 if alike >= 1 else math.ceil(math.log(miss) / math.log(1 - alike))


def _directions(pass_no: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, pass_no, size]).standard_normal((size, BITS))


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in doubles; a scale is taken out first, so that squares neither vanish nor overflow."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(near: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric table of links reaches."""
    root = np.arange(len(near))
    while True:
        least = np.where(near, root[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _joined(ids: list[bytes], unit: np.ndarray, least: float) -> Iterator[tuple[bytes, bytes]]:
    """(vector, another one that it reaches by links among these)."""
    near = unit @ unit.T >= least
    np.fill_diagonal(near, True)
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    if len(linked):
        root = _groups(near[np.ix_(linked, linked)])
        yield from ((ids[linked[i]], ids[linked[r]]) for i, r in enumerate(root.tolist()) if r != i)


def named_vectors(rows: DataFrame) -> DataFrame:
    """(id, label, size, name, vec) of rows (id, label, embedding): the vector's bytes, and 128 bits that tell label and
    vector; both are null where a row can't be compared."""
    double = rows.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = np.float64 if double else np.float32

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, blobs, sizes = [], [], []
            for i, label, value in zip(b["id"].is_null().to_pylist(), b["label"].to_pylist(), b["embedding"], strict=True):
                ok = not i and label is not None and value.is_valid and value.values.null_count == 0 and len(value.values) > 0
                # Adding zero makes both zeros one.
                x = value.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0) if ok else None
                ok = ok and bool(np.isfinite(x).all() and x.any())
                blobs.append(x.tobytes() if ok else None)
                sizes.append(len(x) if ok else None)
                names.append(hashlib.blake2b(blobs[-1], digest_size=16, key=hashlib.blake2b(repr(label).encode()).digest()).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(sizes, pa.int32()), pa.array(names, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "label", "size", "name", "vec"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(apply, f"id {kinds['id']}, label {kinds['label']}, size int, name binary, vec binary")


def _keyed(vectors: DataFrame, passes: int, kind: str, seed: int) -> DataFrame:
    """Each vector once for each pass, with its key there."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                some = b.take(pa.array(np.flatnonzero(sizes == size)))
                unit = _unit(some["vec"].to_pylist(), kind)
                for p in range(passes):
                    keys = np.packbits(unit @ _directions(p, size, seed) > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([p] * len(unit), pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary())], names=[*some.schema.names, "pass", "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(apply, f"{fields}, pass int, key binary")


def neighbours(vectors: DataFrame, passes: int, kind: str, least: float = LEAST, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(a, b): vectors that reach each other by verified links within neighbour windows of a pass.

    ``vectors`` has name, label, size and vec. Each pass is dealt by ranges of its order, however many vectors a label
    has. A task goes along its range with the ``window`` vectors before; those at its ends go to the next range's ones.
    """
    columns = ("pass", "label", "size")
    label = vectors.schema["label"].dataType.simpleString()

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        links: list[tuple[bytes, bytes]] = []
        head: list[tuple] = []
        tail: list[tuple] = []
        group = None

        def compared(rows: list[tuple]) -> None:
            links.extend(_joined([r[3] for r in rows], _unit([r[4] for r in rows], kind), least))

        def batch(edge: int | None, rows: list[tuple], pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            out = [pa.array([edge] * (len(rows) + len(pairs)), pa.int64())]
            for i, kind_of in enumerate(arrow_kinds):
                out.append(pa.array([r[i] for r in rows] + [None] * len(pairs), kind_of))
            out += [pa.array([r[3] for r in rows] + [a for a, _ in pairs], pa.binary()), pa.array([None] * len(rows) + [b for _, b in pairs], pa.binary()), pa.array([r[4] for r in rows] + [None] * len(pairs), pa.binary())]
            return pa.RecordBatch.from_arrays(out, names=["edge", *columns, "a", "b", "vec"])

        arrow_kinds = None
        fresh: list[tuple] = []
        for b in batches:
            arrow_kinds = arrow_kinds or [b[c].type for c in columns]
            for row in zip(*[b[c].to_pylist() for c in (*columns, "name", "vec")], strict=True):
                if row[:3] != group or len(fresh) == window:
                    if fresh:
                        compared(tail + fresh)
                        tail = (tail + fresh)[-window:]
                    if row[:3] != group:
                        group, tail = row[:3], []
                    fresh = []
                fresh.append(row)
                if len(head) < window:
                    head.append(row)
            if links:
                yield batch(None, [], links)
                links.clear()
        if fresh:
            compared(tail + fresh)
            tail = (tail + fresh)[-window:]
        if arrow_kinds:
            yield batch(None, [], links)
            yield batch(part - 1, head, [])
            yield batch(part, tail, [])

    def across(table: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        ends: dict[tuple, list[tuple]] = {}
        for row in zip(*[table[c].to_pylist() for c in (*columns, "a", "vec")], strict=True):
            ends.setdefault(row[:3], []).append(row)
        for rows in ends.values():
            found.extend(_joined([r[3] for r in rows], _unit([r[4] for r in rows], kind), least))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    order = [*columns, "key", "name"]
    sorted_ = _keyed(vectors.select("name", "label", "size", "vec"), passes, kind, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = stored(sorted_.mapInArrow(along, f"edge bigint, pass int, label {label}, size int, a binary, b binary, vec binary"), "neighbours")
    stitched = seen.where(F.col("edge").isNotNull()).groupBy("edge").applyInArrow(across, "a binary, b binary")
    return seen.where(F.col("edge").isNull()).select("a", "b").unionByName(stitched)


def link_counts(members: DataFrame, kind: str, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(name, n): copies of other vectors of its component that each vector is linked with, all compared.

    ``members`` has root, name, size, copies and vec. Components are laid end to end and cut into blocks of ``block``
    vectors; one that lies in several has every two of its blocks compared, each two in a task of their own.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def counted() -> pa.RecordBatch:
            unit = _unit([r[4] for r in rows], kind)
            roots = np.unique(np.array([r[1].hex() for r in rows]), return_inverse=True)[1]
            near = (unit @ unit.T >= least) & (roots[:, None] == roots[None, :])
            np.fill_diagonal(near, False)
            n = near @ np.array([r[3] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([(part << 32) + number] * len(rows), pa.int64()), pa.array(n, pa.int64())], names=["name", "root", "block", "n"])

        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("size", "root", "name", "copies", "vec")], strict=True):
                if rows and (len(rows) == block or rows[0][0] != row[0]):
                    yield counted()
                    number += 1
                    rows = []
                rows.append(row)
        if rows:
            yield counted()

    def between(table: pa.Table) -> pa.Table:
        side = table["left"].to_numpy(zero_copy_only=False).astype(bool)
        copies, names = table["copies"].to_numpy(), table["name"].to_pylist()
        unit = _unit(table["vec"].to_pylist(), kind)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        near = unit[a] @ unit[b].T >= least
        return pa.table({"name": pa.array([names[i] for i in (*a, *b)], pa.binary()), "n": pa.array(np.concatenate([near @ copies[b], copies[a] @ near]), pa.int64())})

    order = ["size", "root", "name"]
    inner = stored(members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(within, "name binary, root binary, block bigint, n bigint"), "blocks")
    spans = stored(inner.select("root", "block").distinct(), "spans")
    pairs = spans.select("root", F.col("block").alias("first")).join(spans.select("root", F.col("block").alias("second")), "root").where(F.col("first") < F.col("second"))
    ends = pairs.select("root", "first", "second", F.explode(F.array(F.struct(F.col("first").alias("block"), F.lit(True).alias("left")), F.struct(F.col("second").alias("block"), F.lit(False).alias("left")))).alias("e")).select("root", "first", "second", "e.*")
    split = inner.select("name", "root", "block").join(ends, ["root", "block"]).join(members.select("name", "copies", "vec"), "name")
    outer = split.groupBy("root", "first", "second").applyInArrow(between, "name binary, n bigint")
    return inner.select("name", "n").unionByName(outer).groupBy("name").agg(F.sum("n").alias("n"))


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", least: float = LEAST, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: near copies among the vectors of each label.

    Two rows are linked if their labels are equal, their vectors equally long and their cosine, in doubles, at least
    ``least``. ``n_links`` counts the other rows linked with a row, ``component_id`` is the least id that it reaches by
    links, itself included, and ``kept`` says that this is its own. Of two rows that no pass brings together (each pair
    at the threshold itself with probability ``miss``, nearer ones less) the link may be lost unless others connect them.

    Rows with a null id or label, and vectors that are null, empty, zero, or hold a null or a non-finite component link
    with nothing; a null id has a null component and is not kept. Equal vectors are one class, compared once and counted
    as often as they are there; rows that share an id are counted each. Other columns are left out, whatever their names;
    an empty table gives no rows.
    """
    read = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    kind = "f4" if read.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    named = named_vectors(read)
    rows = stored(named.select("id", "name"), "rows")
    vectors = stored(named.where(F.col("name").isNotNull()).groupBy("name", "label", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "vectors")
    most = vectors.groupBy("label", "size").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    joined = stored(components(neighbours(vectors, passes_needed(most, window, least, miss), kind, least, window, seed)), "components")
    members = stored(vectors.join(joined.select(F.col("node").alias("name"), "root"), "name").select("root", "name", "rep", "size", "copies", "vec"), "members")
    counts = link_counts(members, kind, least, block)
    leaders = members.groupBy("root").agg(F.min("rep").alias("leader"))
    led = members.select("name", "root").join(leaders, "root").select("name", "leader").join(counts, "name")
    classes = stored(vectors.select("name", "rep", "copies").join(led, "name", "left").select("name", F.coalesce("leader", "rep").alias("leader"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")), "classes")
    discard(vectors)
    out = rows.join(classes, "name", "left").select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("leader", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def vector_report(embeddings: DataFrame) -> DataFrame:
    """The columns of op11."""
    return near_vectors(embeddings)
