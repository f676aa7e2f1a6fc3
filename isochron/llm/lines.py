"""Line dedup: two Bloom filters find suspected repeats; only those shuffle, for the exact count and the choice of owner."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm import bloom
from isochron.llm.common import cut, texts

WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def key_digest(key: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a key of at least ``min_chars`` code points, else None."""
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    out = {key_digest(line_key(x), min_chars) for x in text.split(b"\n")}
    out.discard(None)
    return out


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2] if digests else np.zeros(0, np.uint64)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, n_slots: int) -> DataFrame:
    """(id, keys): for each document the digests of the lines that it loses to a larger id.

    First pass: each task fills the once-seen and twice-seen filters with its documents' distinct keys; merged, the
    twice-seen one has every key of two documents. Second pass: keys that it holds are suspects and shuffle as 16-byte
    digests, are counted exactly, and those of ``min_docs`` documents keep their lines in the largest id only.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bloom.Counter2(n_slots)
        for b in batches:
            pending: list[bytes] = []
            for text in texts(b["text"]):
                pending.extend(_digests(text, min_chars))
            count.add(_hashes(pending))
        yield from count.rows()

    twice = spark.sparkContext.broadcast(bloom.collected(source.mapInArrow(fill, bloom.SCHEMA), "twice", n_slots))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Members(twice.value, n_slots)
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(texts(b["text"])):
                found = _digests(text, min_chars)
                keys.extend(found)
                rows.extend([i] * len(found))
            keep = np.flatnonzero(seen(_hashes(keys)))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.binary()), b["id"].take(pa.array(np.array(rows, np.int64)[keep] if len(keep) else [], pa.int64()))], names=["key", "id"])

    held = cut(source.mapInArrow(suspects, f"key binary, id {docs.schema[id_col].dataType.simpleString()}").distinct())
    # Written once, so that the join deals both sides anew and adaptive execution can split a line that very many hold.
    owners = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")).where(F.col("n") >= min_docs).select("key", "owner"))
    return held.join(owners, "key").where(F.col("id") != F.col("owner")).groupBy("id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, n_slots: int = bloom.SLOTS) -> DataFrame:
    """All columns of ``docs`` with the deduplicated text, plus ``__n_lines`` (before) and ``__n_dropped``.

    A text is cut at newlines; null and empty texts are one empty line and come back as they are. A line is dropped if
    its key has at least ``min_chars`` code points, is found in ``min_docs`` or more documents, and this is not the
    largest id that holds it; every copy within the owner stays. Rows that share an id count as one document and lose
    the same lines; rows with a null id are not counted and keep all lines. Other columns pass through untouched, also
    those named like the text's neighbours; an empty table gives an empty result.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs, n_slots)
    names = docs.columns
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at_id, at_text = names.index(id_col), names.index(text_col)
    joined = wide.join(drops.select(F.col("id").alias("__id"), F.col("keys").alias("__keys")), F.col(f"c{at_id}") == F.col("__id"), "left").drop("__id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = b[f"c{at_text}"]
            out, lines, dropped = [], [], []
            for text, null, keys in zip(texts(source), source.is_null().to_pylist(), b["__keys"].to_pylist(), strict=True):
                lines.append(text.count(b"\n") + 1)
                if keys:
                    lose = set(keys)
                    cut_up = text.split(b"\n")
                    kept = [x for x in cut_up if key_digest(line_key(x), min_chars) not in lose]
                    dropped.append(len(cut_up) - len(kept))
                    out.append(b"\n".join(kept))
                else:
                    dropped.append(0)
                    out.append(None if null else text)
            columns = [pa.array(out, pa.binary()).cast(source.type) if i == at_text else b[f"c{i}"] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "__n_lines", "__n_dropped"])

    schema = ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names)))
    done = joined.mapInArrow(apply, f"{schema}, __n_lines bigint, __n_dropped bigint")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "__n_lines", "__n_dropped")


def line_report(docs: DataFrame) -> DataFrame:
    """The digest columns of op5."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
