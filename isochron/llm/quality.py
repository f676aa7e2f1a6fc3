"""Quality classifier: how much better a dictionary of good text compresses a document than one of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from isochron.llm.common import texts, unused

#: Bounds of what is fitted on: labelled documents drawn for each label, with their whole texts, and bytes of a dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 1500, 110_000
#: Compression level, bytes that are compressed at a time, and bytes of the pieces that dictionaries are trained on. Parts are
#: short so that a text's likeness to the dictionaries counts and not its likeness to itself.
LEVEL, PART, PIECE = 3, 120, 300


def draw(docs: DataFrame, labels: DataFrame, sample_docs: int) -> list[Row]:
    """At most ``sample_docs`` rows of each label, chosen by a hash of the id; labels with crc32(id) mod 4 = 2 are never read."""
    usable = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__most")).where(F.col("quality") == F.col("__most")).drop("__most")
    drawn = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    return sorted(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])


class CompressionModel:
    """A trained dictionary of good and one of bad text, and the curve that turns the size difference into a probability.

    The difference of a text is (bad - good) / (bad + good), where good and bad are the sizes that the dictionaries
    compress it to, summed over its parts: positive for text like the good. The score is a logistic curve over it, so it
    rises with the difference and depends on nothing else.
    """

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.slope, self.offset = 0.0, 0.0
        self._packers: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def difference(self, text: bytes) -> float:
        """Whole text, part by part; an empty one is one empty part."""
        if self._packers is None:
            kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
            for k in kinds:
                k.precompute_compress(level=LEVEL)
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=k, write_content_size=False, write_checksum=False, write_dict_id=False).compress for k in kinds]
        by_good, by_bad = self._packers
        good = bad = 0
        for at in range(0, max(1, len(text)), PART):
            part = text[at : at + PART]
            good += len(by_good(part))
            bad += len(by_bad(part))
        return (bad - good) / (bad + good)

    def calibrate(self, differences: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> None:
        """Fit the curve by Newton steps on texts that the dictionaries haven't seen; a falling one is made flat."""
        spread = float(differences.std()) or 1.0
        x = np.column_stack([np.ones(len(differences)), differences / spread])
        w = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(2), x.T @ (good - p) - ridge * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if w[1] < 0:
            share = (good.sum() + 1) / (len(good) + 2)
            w = np.array([np.log(share / (1 - share)), 0.0])
        self.offset, self.slope = float(w[0]), float(w[1] / spread)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * differences, -30, 30)))


def dictionary(bodies: list[bytes], limit: int) -> bytes:
    """The library's dictionary training over pieces of the bodies; where they are too few for it, their bytes as they are."""
    pieces = [x[i : i + PIECE] for x in bodies for i in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(limit, pieces).as_bytes() if len(pieces) > 7 else b"\n".join(pieces)[:limit] or b" " * 8
    except zstandard.ZstdError:  # it refuses small or uniform input
        return b"\n".join(pieces)[:limit] or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> CompressionModel:
    """Fit on the bounded draw: a third of it trains the dictionaries, the others calibrate the curve.

    With no usable label, or one label only, the curve is flat or nearly so.
    """
    rows = [(r["quality"], r["text"].encode("utf-8", "surrogatepass")) for r in draw(docs, labels, sample_docs)]
    bodies = {q: [t for k, t in rows if k == q] for q in (0, 1)}
    model = CompressionModel(*(dictionary(bodies[q][::3], DICTIONARY_BYTES) for q in (1, 0)))
    rest = [(q, t) for q in (0, 1) for i, t in enumerate(bodies[q]) if i % 3]
    found = np.array([model.difference(t) for _, t in rest] or [0.0])
    model.calibrate(found, np.array([q for q, _ in rest] or [0.5], float))
    return model


def score_batches(model, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([model.difference(t) for t in texts(b[text_col])], float)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(found), pa.float64())], names=[*b.schema.names, "__score"])


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", name: str = "__score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, 0 to 1, of the whole text (null: empty); equal texts score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"
    schema = ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names)))
    out = wide.mapInArrow(lambda batches: score_batches(sent.value, batches, at), f"{schema}, __score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__score").alias(name))


THRESHOLD = 0.7


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6: one row for each row of ``docs``, whatever its id; equal texts score alike.

    Null texts score as empty ones. Labels are used as ``draw`` says: once for each id, not at all where an id has both or
    a null; an empty table of documents gives no rows.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns, whatever their names.

    Each row is kept or not by its own text: null texts go as empty ones do, repeated ids and null ids are rows like others.
    """
    name = unused(docs, "__score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
