"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Two sources are compared by their joint histogram: how many terms have the counts (a, b) in them. A difference of shares
depends on the two counts alone, so it is worked out once for each cell and taken as often as the cell has terms. Only
terms that both sources have are counted pair by pair; cells with a zero follow from each source's own histogram.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.llm.common import discard, stored

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that one task compares at a time, and sources on each side of it.
BLOCK_TERMS, TILE = 16_384, 64
#: Distinct terms that a task holds before it passes them on, and bytes of a text that are cut into words at once.
_HELD, _PIECE = 400_000, 1 << 21

#: Letters, lower-cased, and bytes of longer code points stay; all else ends a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_pieces(text: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``size`` bytes of text."""
    plain = text.translate(_FOLD)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of a term in the texts of a source, and how many of them hold it.

    A row is a text; null counts as ''. Tasks sum up what they read before anything is shuffled.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        n_docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (of, by), found in n.items():
                words, held = list(found), n_docs[of, by]
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(words)), pa.array([by] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([held[w] for w in words], pa.int64())], names=["lang", "source", "term", "n", "n_docs"])
            n.clear(), n_docs.clear()

        for b in batches:
            for of, by, body in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.large_binary()), strict=True):
                mine: set[bytes] = set()
                for words in term_pieces(body.as_py()):
                    n[of, by].update(words)
                    mine.update(words)
                n_docs[of, by].update(mine)
            if sum(map(len, n.values())) > _HELD:
                yield from flush()
        yield from flush()

    clean = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = clean.mapInArrow(tally, "lang string, source string, term string, n bigint, n_docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, terms: Column, prior: int = PRIOR, scale: int = SCALE) -> Column:
    """1 + floor(scale (count + prior) / (total + prior * terms)), exact at any size of the counts."""
    top = F.lit(scale).cast("decimal(10,0)") * (count + prior).cast("decimal(19,0)")
    return F.call_function("div", top, (total + prior * terms).cast("decimal(19,0)")) + 1


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A copy of each entry for each pair of tiles that its source's tile is part of."""
    for b in batches:
        tile = b["no"].to_numpy() // size
        n = -(-b["n_sources"].to_numpy() // size)
        at = np.repeat(np.arange(b.num_rows), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        mine = tile[at]
        yield pa.RecordBatch.from_arrays([*[b[c].take(pa.array(at)) for c in ("lang", "block", "term", "no", "n")], pa.array(np.minimum(mine, other), pa.int32()), pa.array(np.maximum(mine, other), pa.int32())], names=["lang", "block", "term", "no", "n", "ta", "tb"])


_CELLS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("na", pa.int64()), ("nb", pa.int64()), ("terms", pa.int64())])


def _cells(key: tuple, table: pa.Table, size: int) -> pa.Table:
    """Cells (na, nb) of each two sources of two tiles, over the terms of one block that both have."""
    lang, ta, tb = key[0].as_py(), key[2].as_py(), key[3].as_py()
    terms = table["term"].combine_chunks().dictionary_encode()
    numbers, at = np.unique(table["no"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(numbers), len(terms.dictionary)), np.int64)
    counts[at, terms.indices.to_numpy()] = table["n"].to_numpy()
    # Each source's distinct counts by rank, so that a pair of counts is one number.
    ranks = [np.unique(c, return_inverse=True) for c in counts]
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, a in enumerate(numbers.tolist()):
        for j in range(i + 1, len(numbers)):
            b = int(numbers[j])
            if ta != tb and a // size == b // size:
                continue
            both = np.flatnonzero((counts[i] > 0) & (counts[j] > 0))
            (va, ra), (vb, rb) = ranks[i], ranks[j]
            cell, n = np.unique(ra[both] * len(vb) + rb[both], return_counts=True)
            for have, x in zip(out, (np.full(len(n), a), np.full(len(n), b), va[cell // len(vb)], vb[cell % len(vb)], n), strict=True):
                have.append(x)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table([pa.array([lang] * len(flat[0]), pa.string()), *[pa.array(x, f.type) for x, f in zip(flat, list(_CELLS)[1:], strict=True)]], schema=_CELLS)


def joint_counts(entries: DataFrame, n_terms: int, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, a, b, na, nb, terms): how many terms have na > 0 occurrences in source a and nb > 0 in source b, a < b by number.

    ``entries`` has lang, term, no, n_sources and n > 0, and ``n_terms`` terms in all. Terms are dealt in blocks and
    sources in tiles, so that a task holds a bounded table whatever the number of either.
    """
    block = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-n_terms // block_terms)))).cast("int")
    dealt = entries.select("lang", block.alias("block"), "term", "no", "n_sources", "n").mapInArrow(lambda batches: _tiles(batches, tile), "lang string, block int, term string, no int, n bigint, ta int, tb int")
    parts = dealt.groupBy("lang", "block", "ta", "tb").applyInArrow(lambda key, rows: _cells(key, rows, tile), "lang string, a int, b int, na bigint, nb bigint, terms bigint")
    return parts.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms"))


def with_zero_cells(joint: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """``joint`` with the cells (na, 0) and (0, nb): of a source's own histogram what no joint cell takes.

    ``own`` has lang, no, n and terms, ``pairs`` lang, a and b. The cell (0, 0) is what a language's terms leave.
    """
    less, zero = (-F.col("terms")).alias("terms"), F.lit(0).cast("bigint")
    rows = joint
    for side, count, na, nb in (("a", "na", F.col("na"), zero), ("b", "nb", zero, F.col("nb"))):
        mine = own.select("lang", F.col("no").alias(side), F.col("n").alias(count), "terms")
        rows = rows.unionByName(joint.select("lang", "a", "b", na.alias("na"), nb.alias("nb"), less))
        rows = rows.unionByName(pairs.join(mine, ["lang", side]).select("lang", "a", "b", na.alias("na"), nb.alias("nb"), "terms"))
    return rows.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms")).where(F.col("terms") != 0)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others and from the language.

    Terms are runs of letters and of code points beyond ASCII, A-Z lower-cased; those in at least ``least_docs`` texts of
    a language count there. A group's share of a term is smoothed (``share``). Part ``pair`` has a row for each other
    source of the language with the sum of differences over all terms; part ``term`` the ``top`` terms that a source has
    and uses more than its language does, by how much. Ranks start at 1, the greatest value first, then the lesser item.

    Null lang, source and text count as ''. Each row is a text of its own, repeated ones too; ids play no part. A source
    without any kept term has its rows in ``pair``, with 0 where its language keeps none. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    counted = stored(term_counts(docs, lang, source, text), "term-counts")
    kept = stored(counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_docs).drop("n_docs"), "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("n_sources", F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int"))
    entries = stored(counted.join(kept, ["lang", "term"]).join(numbered, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", "no", "n_sources"), "kept-counts")
    discard(counted)

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "no").agg(F.sum("n").alias("total"))
    sized = stored(numbered.join(totals, ["lang", "no"], "left").join(langs, "lang", "left").select("lang", "source", "no", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v"), "lang_total"), "sources")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = entries.join(sized.drop("source"), ["lang", "no"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where(F.col("value") > 0)
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    of = lambda side: sized.select("lang", F.col("no").alias(side), F.col("source").alias(f"source_{side}"), F.col("total").alias(f"total_{side}"), *(["v"] if side == "a" else []))
    pairs = of("a").join(of("b"), "lang").where(F.col("a") < F.col("b"))
    own = entries.groupBy("lang", "no", "n").agg(F.count(F.lit(1)).alias("terms"))
    cells = with_zero_cells(stored(joint_counts(entries, kept.count(), block_terms, tile), "joint-counts"), own, pairs.select("lang", "a", "b"))
    apart = lambda na, nb: F.abs(share(na, F.col("total_a"), F.col("v")) - share(nb, F.col("total_b"), F.col("v")))
    sums = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum("terms").alias("some"), F.sum(F.col("terms") * apart(F.col("na"), F.col("nb"))).alias("sum"))
    zero = F.lit(0).cast("bigint")
    rest = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("some", zero)) * apart(zero, zero)).otherwise(zero)
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source_a", "source_b", (F.coalesce("sum", zero) + rest).alias("value"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    others = valued.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(by_value))
    return others.unionByName(terms)


def divergence_report(docs: DataFrame) -> DataFrame:
    """The columns of op12."""
    return divergence(docs)
