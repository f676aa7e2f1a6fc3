"""Bloom filters with a slot count that is a parameter, so that what is broadcast never grows with the data.

A filter too small for its input only lets more rows through to the exact step behind it; it never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 3
#: Slots of a filter; two bits each, so at most 8 MB are sent to a task.
SLOTS = 1 << 25
_SEGMENT = 1 << 19

_PACKED = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def slots_of(hashes: np.ndarray, n_slots: int) -> np.ndarray:
    """(PROBES, n) slot numbers of 64-bit hashes."""
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(n_slots) for i in range(PROBES)]).astype(np.int64)


class Counter2:
    """Saturating counts 0, 1, 2 for each slot: the once-seen and the twice-seen filter side by side."""

    def __init__(self, n_slots: int):
        self.state = np.zeros(n_slots, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes):
            for at in slots_of(hashes, len(self.state)):
                at.sort()
                first = np.append(True, at[1:] != at[:-1])
                more = np.append(~first[1:], False)[first]
                at = at[first]
                self.state[at] = np.minimum(self.state[at] + 1 + more, 2)

    def rows(self) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(0, len(self.state), _SEGMENT):
            part = self.state[s : s + _SEGMENT]
            if part.any():
                once, twice = (pack.compress(np.packbits(part >= k).tobytes()) for k in (1, 2))
                yield pa.RecordBatch.from_pydict({"segment": [s // _SEGMENT], "once": [once], "twice": [twice]}, schema=_PACKED)


SCHEMA = "segment int, once binary, twice binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    have: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for segment, once, twice in zip(b["segment"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist(), strict=True):
            one, two = (np.frombuffer(unpack.decompress(x), np.uint8) for x in (once, twice))
            if segment in have:
                o, t = have[segment]
                have[segment] = [o | one, t | two | (o & one)]
            else:
                have[segment] = [one, two]
    for segment, pair in have.items():
        yield pa.RecordBatch.from_pydict({"segment": [segment], **{k: [pack.compress(v.tobytes())] for k, v in zip(("once", "twice"), pair, strict=True)}}, schema=_PACKED)


def sized(n: int, most: int = SLOTS) -> int:
    """Slots for n values, eight for each, within bounds; n is a count of what goes into the filter."""
    return min(most, max(_SEGMENT, 1 << (8 * max(1, n) - 1).bit_length()))


def merged(parts: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """Filters of tasks (rows of ``Counter2.rows``) summed up segment by segment.

    In two levels: each segment is first dealt to several tasks by where a row comes from, so that no task merges the
    filters of all input tasks however many there are.
    """
    segments = max(1, n_slots // _SEGMENT)
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks > segments:
        salted = parts.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(tasks // segments)))
        parts = salted.repartition(tasks, "segment", "__salt").drop("__salt").mapInArrow(_merge, SCHEMA)
    return parts.repartition(max(1, min(16, segments)), "segment").mapInArrow(_merge, SCHEMA)


def collected(parts: DataFrame, level: str, n_slots: int = SLOTS) -> bytes:
    """The merged filter's bits, packed and compressed: n_slots / 8 bytes before compression, whatever the input."""
    bits = np.zeros(max(1, -(-n_slots // 8)), np.uint8)
    for segment, packed in merged(parts, n_slots).select("segment", level).collect():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(packed)), np.uint8)
        bits[segment * _SEGMENT // 8 : segment * _SEGMENT // 8 + len(part)] = part
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


class Members:
    """Answers membership from the bits of ``collected``."""

    def __init__(self, packed: bytes, n_slots: int = SLOTS):
        self.n_slots, self.bits = n_slots, np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in slots_of(hashes, self.n_slots):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        return found


def of_longs(df: DataFrame, column: str, n_slots: int = SLOTS) -> bytes:
    """The filter of a long column's distinct values."""

    def fill(batches):
        count = Counter2(n_slots)
        for b in batches:
            count.add(b[column].drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield from count.rows()

    return collected(df.select(F.col(column)).mapInArrow(fill, SCHEMA), "once", n_slots)
