"""N-gram Jaccard join: prefix tokens bring documents into blocks, a count-vector R-tree bounds overlaps, sets verify pairs.

Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of distinct shingles. The passes are

1. signatures: set size, fingerprint and count vector of each document; equal sets make a class, whose least id stands
   for it. Tokens that a task meets repeatedly are counted, for the order of rarity;
2. prefixes: of n shingles in that order, linked documents share three of the first n - ceil(0.75 n) + 3. Two documents
   that share three tokens of at most eight holders each form a block, as do those that share one of more holders; both
   lie around the least of them. One or two shared tokens, as chance brings together, form none;
3. candidates: shingles hash into groups, the counts by group are a point of an R-tree over each block, and the sum of
   coordinate minima with a node's upper corner bounds every overlap below it. Points are a small part of the sets' size;
   only documents that some bound lets pass go on, with those they are joined to by such bounds as their new block;
4. verification in leaves of bounded size: surviving pairs are tested on the sets unless they are connected already, so
   a block of near copies costs about one test for each member. Sets hold 128-bit keyed names of shingles
   (``textkernel.WordNames``), which are the same only for the same words;
5. blocks of several leaves: members outside the block's largest component are searched in its other leaves.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm import bloom, textkernel
from isochron.llm.common import cut, discard, stored, unused
from isochron.llm.components import components

SHINGLE = 5
#: Groups that shingles hash into in a leaf of sets, entries of an R-tree node, and bounds of a leaf: documents, shingles.
GROUPS, FANOUT, LEAF_DOCS, LEAF_SHINGLES = 128, 16, 512, 1 << 21
#: Powers of two between which a point's number of groups lies: two to four shingles in a group, so far as they allow.
LEAST_BITS, MOST_BITS = 4, 14
#: Tokens of the table that orders by rarity; others count as rarer, in the order of their hashes. The order only steers cost.
FREQUENT = 1 << 17
_FLUSH = 1 << 22
#: Tokens that linked documents share at least in their prefixes, and holders up to which a token tells its pairs one by one.
SHARED, FEW = 3, 8
#: Tokens are gone through in slices by value, one after the other: of at most so many tokens, and so many slices where each
#: has the least number.
SLICE, LEAST_SLICE, SLICES = 1 << 24, 1 << 22, 4
#: Leaves' worth of documents of which a block's points are compared at once, and members of blocks whose points move at once.
POINT_LEAVES, POINT_ROWS = 4, 1 << 20


#: A document's set: both halves of its shingles' names, distinct and sorted by the first.
Names = tuple[np.ndarray, np.ndarray]


def distinct(a: np.ndarray, b: np.ndarray) -> Names:
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    if len(a) > 1:
        same = a[1:] == a[:-1]
        if (b[1:] != b[:-1])[same].any():  # two shingles share a first half
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same = a[1:] == a[:-1]
        new = np.append(True, ~(same & (b[1:] == b[:-1])))
        a, b = a[new], b[new]
    return a, b


def _sets(b: pa.RecordBatch, names: textkernel.WordNames, keep: np.ndarray | None = None) -> Iterator[tuple[int, Names]]:
    """(row, set) for the rows of a batch, or the chosen ones."""
    column = b["text"]
    chosen = np.arange(len(column)) if keep is None else keep
    if keep is not None:
        column = column.take(pa.array(keep))
    data, offsets = textkernel.column_bytes(column)
    for i, j, part, at in textkernel.blocks(data, offsets):
        low = textkernel.lower_ascii(part)
        starts, ends, rows = textkernel.words(low, at, textkernel.WHITE)
        first, second, owner = names.shingles(names.words(low, starts, ends), rows, j - i, SHINGLE)
        edges = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            own = slice(edges[k], edges[k + 1])
            yield int(chosen[i + k]), distinct(first[own], second[own])


def fingerprint(names: Names) -> tuple[int, int]:
    """128 bits of a set, as two signed longs: sums over both halves."""
    a, b = (textkernel.mix(x).sum(dtype=np.uint64) for x in names)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_SIGNATURE = "doc bigint, n bigint, print bigint, second bigint, point binary, token bigint, times bigint"


def _signatures(batches: Iterator[pa.RecordBatch], secret: bytes) -> Iterator[pa.RecordBatch]:
    named = textkernel.WordNames(secret)
    names = ["doc", "n", "print", "second", "point", "token", "times"]
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
    held: list[np.ndarray] = []
    size = 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        more = counts > 1
        none = pa.nulls(int(more.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), pa.binary()), pa.array(values[more].view(np.int64)), pa.array(counts[more].astype(np.int64))], names=names)

    for b in batches:
        rows, points = [], []
        for i, s in _sets(b, named):
            rows.append((i, len(s[0]), *fingerprint(s)))
            points.append(pack.compress(point_of(s[0]).tobytes()))
            held.append(s[0])
            size += len(s[0])
            if size > _FLUSH:
                yield flush()
                held.clear()
                size = 0
        i, n, first, second = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(i)), pa.array(n), pa.array(first), pa.array(second), pa.array(points, pa.binary()), none, none], names=names)
    if held:
        yield flush()


def prefix_length(n: int) -> int:
    """How many of n shingles, in an order common to all documents, are sure to meet ``SHARED`` of a linked document's.

    Documents of fewer than ``SHARED`` shingles link with none but equal sets.
    """
    return min(n, n - -(-3 * n // 4) + SHARED)


def slices_of(n: int) -> int:
    """Into how many slices n tokens go."""
    return max(1, -(-n // SLICE), min(SLICES, -(-n // LEAST_SLICE)))


class Rarity:
    """Counts of the most repeated tokens."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.times = tokens[order], times[order]
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.tokens >> np.uint64(44)).astype(np.int64)] = True

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        """The rarest tokens of a sorted set, as many as ``prefix_length`` asks for."""
        p = prefix_length(len(shingles))
        maybe = np.flatnonzero(self.first[(shingles >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, shingles[maybe]), len(self.tokens) - 1)
            known = self.tokens[at] == shingles[maybe]
            if known.any():
                times = np.zeros(len(shingles), np.int64)
                times[maybe[known]] = self.times[at[known]]
                return shingles[np.argsort(times, kind="stable")[:p]]
        return shingles[:p]


class CountTree:
    """An R-tree over count vectors, packed in the order of set size and then of the counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
        self.points, self.sizes = counts[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, least, most = self.points, self.sizes, self.sizes
        while len(upper) > 1:
            cuts = np.arange(0, len(upper), FANOUT)
            upper, least, most = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((upper, least, most))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of all points whose bound allows a link: 7 * overlap >= 3 * (sum of both sizes)."""
        alive = np.zeros(1, np.int64)
        for k, (upper, least, most) in enumerate(reversed(self.levels)):
            if k:
                alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                alive = alive[alive < len(upper)]
            bound = np.minimum(np.minimum(point, upper[alive]).sum(axis=1), np.minimum(most[alive], size))
            alive = alive[7 * bound >= 3 * (size + least[alive])]
            if not len(alive):
                return alive
        if self.levels:
            alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            alive = alive[alive < len(self.points)]
        bound = np.minimum(point, self.points[alive]).sum(axis=1)
        return self.order[alive[7 * bound >= 3 * (size + self.sizes[alive])]]


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """The count vector: how many shingles hash into each group."""
    return np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def point_of(shingles: np.ndarray) -> np.ndarray:
    """The count vector at a resolution by the set's size; sizes that can link differ by one step at most."""
    bits = max(LEAST_BITS, min(MOST_BITS, len(shingles).bit_length() - 2))
    return np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, doc) of rows (hub, doc, point) sorted by hub: each document that a bound joins to others, under the least of them."""
    from itertools import groupby

    unpack = zstandard.ZstdDecompressor()
    rows = (x for b in batches for x in zip(*(b[c].to_pylist() for c in ("hub", "doc", "point")), strict=True))
    out: list[tuple[int, int]] = []
    for _, own in groupby(rows, key=lambda x: x[0]):
        block = [(doc, np.frombuffer(unpack.decompress(point), np.uint32).astype(np.int64)) for _, doc, point in own]
        owner = list(range(len(block)))

        def find(i: int, owner: list[int]) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        for groups in {len(p) for _, p in block}:
            near = [i for i, (_, p) in enumerate(block) if len(p) in (groups, 2 * groups)]
            if len(near) > 1:
                points = np.stack([block[i][1].reshape(-1, groups).sum(axis=0) for i in near])
                sizes = points.sum(axis=1)
                tree = CountTree(points, sizes)
                for k, i in enumerate(near):
                    if len(block[i][1]) == groups:
                        for j in tree.search(points[k], sizes[k]):
                            one, two = find(i, owner), find(near[int(j)], owner)
                            owner[max(one, two)] = min(one, two)
        least: dict[int, int] = {}
        joined: dict[int, int] = {}
        for i, (doc, _) in enumerate(block):
            root = find(i, owner)
            least[root], joined[root] = min(doc, least.get(root, doc)), joined.get(root, 0) + 1
        out += [(least[r], doc) for i, (doc, _) in enumerate(block) if joined[r := find(i, owner)] > 1]
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["hub", "doc"])
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["hub", "doc"])


def linked(a: Names, b: Names) -> bool:
    """The exact test on two sets: a shingle is shared if both halves of its name are."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    n, m = len(a[0]), len(b[0])
    if not n or 4 * n < 3 * m:
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), m - 1)
    same = int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())
    return 7 * same >= 3 * (n + m)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """Rows of sorted batches by (hub, leaf), as (doc, root, query, set)."""
    from itertools import groupby

    def rows():
        for b in batches:
            for hub, leaf, doc, root, query, body in zip(*(b[c].to_pylist() for c in ("hub", "leaf", "doc", "root", "query", "body")), strict=True):
                yield (hub, leaf), (doc, root, query, tuple(np.frombuffer(body, np.uint64).reshape(2, -1)))

    for key, own in groupby(rows(), key=lambda x: x[0]):
        yield key, (x[1] for x in own)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each leaf: among its members, and from the queries sorted behind them to members of other components."""
    out: list[tuple[int, int]] = []
    for _, rows in _groups(batches):
        docs, roots, sets = [], [], []
        tree: CountTree | None = None
        owner: list[int] = []

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        def build() -> CountTree:
            tree = CountTree(np.stack([counts_of(s[0]) for s in sets]), np.array([len(s[0]) for s in sets]))
            owner.extend(range(len(sets)))
            if roots[0] is None:  # not searched yet
                for i, s in enumerate(sets):
                    for j in tree.search(counts_of(s[0]), len(s[0])):
                        if j < i and find(i) != find(int(j)) and linked(s, sets[j]):
                            owner[find(i)] = find(int(j))
                            out.append((docs[i], docs[j]))
            return tree

        for doc, root, query, s in rows:
            if not query:
                docs.append(doc)
                roots.append(root)
                sets.append(s)
                continue
            if tree is None:
                if not sets:
                    continue
                tree = build()
            done = set()
            for j in tree.search(counts_of(s[0]), len(s[0])):
                if roots[j] != root and roots[j] not in done and linked(s, sets[j]):
                    done.add(roots[j])
                    out.append((doc, docs[j]))
        if tree is None and len(sets) > 1:
            build()
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def _leaf_links(rows: DataFrame) -> DataFrame:
    """Links found in rows (hub, leaf, doc, root, query, body), leaf by leaf in sorted order."""
    return rows.repartition("hub", "leaf").sortWithinPartitions("hub", "leaf", "query", "doc").mapInArrow(_links, "a bigint, b bigint")


def most_repeated(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """About the ``limit`` most repeated tokens of ``counts`` (token, times), and no more than come to the driver at once.

    Counts are told apart in steps of a sixteenth of a power of two. How many tokens lie at each step, a few hundred
    numbers, tells the step from which on all are taken, and the share by token of the step below; no task sees them all.
    """
    counted = stored(counts.withColumn("step", F.floor(F.log2("times") * 16).cast("int")), "counts")
    taken, floor, share = 0, None, 0.0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):
        if taken + n > limit:
            floor, share = step, 0.9 * (limit - taken) / n
            break
        taken += n
    some = F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = counted if floor is None else counted.where((F.col("step") > floor) | ((F.col("step") == floor) & some))
    rows = [(r[0], r[1]) for r in found.select("token", "times").collect()]
    discard(counted)
    return rows


def _met(tokens: DataFrame, n_slots: int) -> DataFrame:
    """(hub, doc, times), written: pairs of documents, the least first, with how many of ``tokens`` (token, doc) of few holders they share.

    Documents around the hub of a token of more holders, its least one, count as if they shared ``SHARED`` tokens. Those
    hubs are aggregated in part before they shuffle and written once, so that the join can be split on a token that very
    many hold.
    """
    spark = tokens.sparkSession
    ends = [F.min("doc").alias("hub"), F.max("doc").alias("last"), F.bit_xor("doc").alias("all"), F.count(F.lit(1)).alias("n")]
    told = cut(tokens.groupBy("token").agg(*ends).where(F.col("hub") < F.col("last")))
    between = F.col("all").bitwiseXOR(F.col("hub")).bitwiseXOR(F.col("last"))
    pair = lambda a, b: F.struct(a.alias("hub"), b.alias("doc"))
    ends_of = pair(F.col("hub"), F.col("last"))
    each = F.when(F.col("n") == 2, F.array(ends_of)).otherwise(F.array(ends_of, pair(F.col("hub"), between), pair(between, F.col("last"))))
    few = told.where(F.col("n") <= 3).select(F.explode(each).alias("p")).select("p.*")
    block = lambda df: df.select("hub", "doc").distinct().withColumn("times", F.lit(SHARED).cast("bigint"))
    around = None
    many = told.where(F.col("n") > 3).select("token", "hub", "n")
    if n := many.count():
        slots = bloom.sized(n, n_slots)
        met = spark.sparkContext.broadcast(bloom.of_longs(many, "token", slots))

        def several_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = bloom.Members(met.value, slots)
            for b in batches:
                keep = seen(b["token"].to_numpy().view(np.uint64))
                if keep.any():
                    yield b.filter(pa.array(keep))

        held = tokens.mapInArrow(several_hold, "token bigint, doc bigint").join(many, "token")
        around = cut(held.select("token", "hub", "doc", "n").where((F.col("n") <= FEW) | (F.col("hub") != F.col("doc"))))
        sets = around.where(F.col("n") <= FEW).groupBy("token").agg(F.collect_set("doc").alias("docs"))
        each = sets.select(F.explode("docs").alias("hub"), "docs").select("hub", F.explode("docs").alias("doc")).where(F.col("hub") < F.col("doc"))
        few = few.unionByName(each)
    found = few.where(F.col("hub") != F.col("doc")).groupBy("hub", "doc").agg(F.count(F.lit(1)).alias("times"))
    if around is not None:
        found = found.unionByName(block(around.where(F.col("n") > FEW)))
    found = cut(found)
    for done in (told, *([around] if around is not None else [])):
        discard(done)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = bloom.SLOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Words are the runs of bytes other than white space, A-Z lower-cased; a set holds the distinct runs of five words, or
    the whole sequence of fewer. Texts without words, and nulls, have empty sets and link with nothing: each is its own
    component. Rows that share an id are all returned and reach each other's links; a null id has a null component and
    takes no part. An empty table gives no rows; other columns of ``docs`` are not read. Ties don't matter: components
    and their least ids are the same for any order.
    """
    spark = docs.sparkSession
    secret = os.urandom(64)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    scanned = stored(rows.mapInArrow(lambda batches: _signatures(batches, secret), _SIGNATURE), "signatures")
    sizes = cut(scanned.where(F.col("n").isNotNull()).select("doc", "n", "print", "second"))
    known = sizes.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = cut(known.groupBy("print", "second").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n"))
    held = known.join(classes, ["print", "second"]).where(F.col("doc") != F.col("rep")).select("doc", "rep").distinct()
    # An id with several sets stays a node of its own, linked to the class of each; all others go by their class.
    several = cut(known.groupBy("doc").agg(F.min(F.struct("print", "second")).alias("__a"), F.max(F.struct("print", "second")).alias("__b")).where(F.col("__a") != F.col("__b")).select("doc"))
    tied = held.join(several, "doc", "left_semi")
    copied = cut(held.join(several, "doc", "left_anti"))

    frequent = most_repeated(scanned.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times")), FREQUENT)
    rarity = spark.sparkContext.broadcast(Rarity(np.array([r[0] for r in frequent] or [0], np.int64).view(np.uint64), np.array([r[1] for r in frequent] or [0], np.int64)))

    # Copies are left to their representatives. A filter of all others is asked, which may let a copy through.
    emitters = None
    if not copied.isEmpty():
        alone = known.join(copied, "doc", "left_anti").select("doc").distinct()
        emitter_slots = bloom.sized(alone.count(), n_slots)
        emitters = spark.sparkContext.broadcast(bloom.of_longs(alone, "doc", emitter_slots))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, named = rarity.value, set(), textkernel.WordNames(secret)
        sends = bloom.Members(emitters.value, emitter_slots) if emitters else None
        for b in batches:
            doc = b["doc"].to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, owners = [], []
            for i, s in _sets(b, named, None if sends is None else np.flatnonzero(sends(doc.view(np.uint64)))):
                if len(s[0]) < SHARED or (mark := fingerprint(s)) in seen:
                    continue  # this task has sent an equal set's tokens already
                if len(seen) < 1 << 18:
                    seen.add(mark)
                p = order.prefix(s[0])
                tokens.append(p)
                owners.append(np.full(len(p), doc[i]))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], names=["token", "doc"])

    tokens = stored(rows.where(F.col("doc").isNotNull()).mapInArrow(prefixes, "token bigint, doc bigint"), "tokens")
    slices = slices_of(tokens.count())
    told = [_met(tokens.where(F.pmod("token", F.lit(slices)) == i), n_slots) for i in range(slices)]
    renamed = copied.select(F.col("doc").alias("__doc"), F.col("rep").alias("__rep"))
    as_rep = lambda df, c: df.join(renamed, F.col(c) == F.col("__doc"), "left").withColumn(c, F.coalesce("__rep", c)).drop("__doc", "__rep")
    by_class = as_rep(as_rep(reduce(DataFrame.unionByName, told), "hub"), "doc").where(F.col("hub") != F.col("doc"))
    # A pair is the same either way round; a row that stands for a block stays with its hub.
    single = F.col("times") < SHARED
    ends = [F.when(single, f("hub", "doc")).otherwise(F.col(c)).alias(c) for f, c in ((F.least, "hub"), (F.greatest, "doc"))]
    pairs = cut(by_class.groupBy(*ends).agg(F.sum("times").alias("times")).where(F.col("times") >= SHARED).select("hub", "doc"))
    for done in (tokens, *told):
        discard(done)
    members = pairs.unionByName(pairs.select("hub", F.col("hub").alias("doc")).distinct())

    widths = known.groupBy("doc").agg(F.max("n").alias("__size"))

    def in_leaves(blocks: DataFrame) -> DataFrame:
        """(hub, doc, leaves, leaf): how many leaves a block takes, and which is the document's."""
        shape = blocks.join(widths, "doc").groupBy("hub").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__size"))
        leaves = F.greatest(F.ceil(F.col("__n") / LEAF_DOCS), F.ceil(F.col("__size") / LEAF_SHINGLES)).cast("int")
        # Few blocks take several leaves; theirs are written once, so that the join can be split on a hub of many members.
        large = cut(shape.select("hub", leaves.alias("leaves")).where(F.col("leaves") > 1))
        return blocks.join(large, "hub", "left").withColumn("leaves", F.coalesce("leaves", F.lit(1))).withColumn("leaf", F.pmod(F.xxhash64("doc"), F.col("leaves")).cast("int"))

    rough = cut(in_leaves(members))
    points = scanned.where(F.col("n") > 0).groupBy("doc", "print", "second").agg(F.min("point").alias("point")).drop("print", "second")
    bounded = rough.where(F.col("leaves") <= POINT_LEAVES)
    turns = -(-bounded.count() // POINT_ROWS)
    near = []
    for i in range(turns):
        own = bounded.where(F.pmod(F.xxhash64("hub"), F.lit(turns)) == i).join(points, "doc").select("hub", "doc", "point")
        found = own.repartition("hub").sortWithinPartitions("hub", "doc").mapInArrow(_candidates, "hub bigint, doc bigint")
        near.append(cut(found) if turns > 1 else found)
    blocks = cut(reduce(DataFrame.unionByName, [*near, rough.where(F.col("leaves") > POINT_LEAVES).select("hub", "doc")]).distinct())
    for done in (scanned, pairs, rough, *(near if turns > 1 else [])):
        discard(done)
    leafed = cut(in_leaves(blocks))

    wanted_slots = bloom.sized(blocks.count(), n_slots)
    wanted = spark.sparkContext.broadcast(bloom.of_longs(blocks, "doc", wanted_slots))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sent, named = bloom.Members(wanted.value, wanted_slots), set(), textkernel.WordNames(secret)
        for b in batches:
            doc = b["doc"].to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(seen(doc.view(np.uint64)))
            got = []
            for i, s in _sets(b, named, keep):
                key = (int(doc[i]), *fingerprint(s))
                if key not in sent:
                    sent.add(key)
                    got.append((*key, s[0].tobytes() + s[1].tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "print", "second", "body"])

    # A repeated id can have several sets; each is a member of its own, and met once. Sets only move to be told apart from
    # their repetitions if some are repeated.
    scans = stored(rows.where(F.col("doc").isNotNull()).mapInArrow(bodies, "doc bigint, print bigint, second bigint, body binary"), "sets")
    again = scans.groupBy("doc", "print", "second").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    sets = scans if again.isEmpty() else scans.groupBy("doc", "print", "second").agg(F.min("body").alias("body"))
    sets = sets.drop("print", "second")
    none = F.lit(None).cast("bigint").alias("root")
    first = cut(_leaf_links(leafed.join(sets, "doc").select("hub", "leaf", "doc", none, F.lit(False).alias("query"), "body")))

    links = first
    spread = leafed.where(F.col("leaves") > 1)
    if not spread.isEmpty():
        found = components(first)
        rooted = spread.join(found.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        largest = rooted.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("__n")).groupBy("hub").agg(F.max(F.struct("__n", "root")).alias("__most")).select("hub", F.col("__most.root").alias("__largest"))
        outside = rooted.join(largest, "hub").where(F.col("root") != F.col("__largest")).select("hub", "doc", "root")
        queries = outside.join(spread.select("hub", "leaf").distinct(), "hub").select("hub", "leaf", "doc", "root", F.lit(True).alias("query"))
        both = rooted.select("hub", "leaf", "doc", "root", F.lit(False).alias("query")).unionByName(queries)
        links = cut(first.unionByName(_leaf_links(both.join(sets, "doc").select("hub", "leaf", "doc", "root", "query", "body"))))
    discard(scans)

    roots = cut(components(links.unionByName(tied.select(F.col("doc").alias("a"), F.col("rep").alias("b")))))
    classed = sizes.join(renamed, F.col("doc") == F.col("__doc"), "left").select("doc", "n", F.coalesce("__rep", "doc").alias("__rep"))
    placed = classed.join(roots.select(F.col("node").alias("__node"), "root"), F.col("__rep") == F.col("__node"), "left")
    return placed.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "__rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The least id of each component, with the documents' own columns; rows repeated under one id stay together."""
    name = unused(docs, "__id")
    kept = jaccard_components(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
