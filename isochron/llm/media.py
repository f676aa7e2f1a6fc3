"""Media columns: payloads as PNG in binary columns, read back through checked chunks, with cosine-transform hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a pixel, by PNG colour type, at 8 bits.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Bytes of a row of the images made here: 64 pixels of three samples.
ROW_BYTES = 192
#: Bytes of samples that a decoded image may have: a binary column holds no larger value.
MOST_SAMPLES = (1 << 31) - 1


class BadImage(ValueError):
    """The bytes are no PNG that this reader takes: wrong signature, order, checksum, length or filter."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A 64 pixel wide truecolour PNG whose samples are the payload; its length is a positive multiple of 192.

    Each row takes the cheapest of the filters None, Sub and Up by the sum of absolute differences.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    sub, up = rows.copy(), rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, sub, up)])
    kind = cost.argmin(axis=0)
    body = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    body[:, 0] = kind
    body[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of each chunk, its checksum tested."""
    if image[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise BadImage("truncated chunk")
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(image):
            raise BadImage("truncated chunk")
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise BadImage(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise BadImage("no IEND")


def unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters; ``step`` is the bytes of a pixel. Runs of one of the first three kinds go as a whole."""
    out = rows.copy()
    i, n = 0, len(rows)
    while i < n:
        j = i + 1
        while j < n and kinds[j] == kinds[i]:
            j += 1
        kind = kinds[i]
        if kind == 1:
            part = out[i:j].reshape(j - i, -1, step)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            if i:
                out[i] += out[i - 1]
            np.cumsum(out[i:j], axis=0, dtype=np.uint8, out=out[i:j])
        elif kind in (3, 4):
            for r in range(i, j):
                above = out[r - 1].astype(np.int64) if r else np.zeros(rows.shape[1], np.int64)
                line = out[r].astype(np.int64)
                for c in range(0, len(line), step):
                    left = line[c - step : c] if c else np.zeros(step, np.int64)
                    over = above[c : c + step]
                    if kind == 3:
                        guess = (left + over) >> 1
                    else:
                        corner = above[c - step : c] if c else np.zeros(step, np.int64)
                        base = left + over - corner
                        a, b, d = abs(base - left), abs(base - over), abs(base - corner)
                        guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, over, corner))
                    line[c : c + step] = (line[c : c + step] + guess) & 255
                out[r] = line
        elif kind:
            raise BadImage(f"filter {kind}")
        i = j
    return out


def decode_png(image: bytes) -> np.ndarray:
    """(height, width, samples) of an 8-bit, non-interlaced PNG without a palette."""
    head, packed, ended = None, [], False
    for kind, body in chunks(image):
        if head is None and kind != b"IHDR":
            raise BadImage("IHDR is not first")
        if kind == b"IHDR":
            if head is not None or len(body) != 13:
                raise BadImage("IHDR")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise BadImage("no IHDR or IEND")
    width, height, depth, colour, packing, filtering, interlaced = head
    if not width or not height:
        raise BadImage("no pixels")
    if packing or filtering:
        raise BadImage("compression or filter method")
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise BadImage("only 8-bit, non-interlaced images without a palette")
    step = CHANNELS[colour]
    want = height * (width * step + 1)
    if want > MOST_SAMPLES:
        raise BadImage("more samples than a column's value can hold")
    stream = zlib.decompressobj()
    try:  # never more than the header promises
        raw = np.frombuffer(stream.decompress(b"".join(packed), want), np.uint8)
        more = stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error as e:
        raise BadImage(f"samples: {e}") from None
    if len(raw) != want or more or not stream.eof:
        raise BadImage("length of the samples")
    raw = raw.reshape(height, -1)
    return unfilter(raw[:, 1:], raw[:, 0], step).reshape(height, width, step)


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))


_SIDE, _KEPT = 32, 8
_COSINES = _cosines(_SIDE)[:_KEPT]


def _means(values: np.ndarray, n: int) -> np.ndarray:
    """n means over equal parts of the first axis; a shorter axis repeats its rows."""
    edges = np.arange(n + 1) * len(values) / n
    low = edges[:-1].astype(np.int64)
    high = np.maximum(np.ceil(edges[1:]).astype(np.int64), low + 1)
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (sums[high] - sums[low]) / (high - low)[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """Eight bytes: which of the 64 lowest frequencies lie above their median (the mean itself left out of it)."""
    grey = pixels.mean(axis=2)
    small = _means(_means(grey, _SIDE).T.copy(), _SIDE).T
    low = np.round((_COSINES @ small @ _COSINES.T).ravel(), 5)
    return np.packbits(low > np.median(low[1:])).tobytes()


def pad(payload: bytes) -> bytes:
    """Spaces appended up to a positive multiple of a row."""
    return payload + b" " * (-len(payload) % ROW_BYTES if payload else ROW_BYTES)


def to_images(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``__image`` (binary PNG) and ``__n_bytes`` (bytes before padding).

    A null or empty text makes one row of spaces. Equal texts make equal images. One image has to fit in a task's
    memory a few times over. Columns of ``df`` keep their names and values; an empty table stays empty.
    """
    kind = "struct<image: binary, n_bytes: bigint>"

    @F.pandas_udf(kind)
    def make(column):
        import pandas as pd

        raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column]
        return pd.DataFrame({"image": [encode_png(pad(x)) for x in raw], "n_bytes": [len(x) for x in raw]})

    got = df.withColumn("__made", make(F.col(f"`{text_col}`")))
    return got.withColumns({"__image": F.col("__made.image"), "__n_bytes": F.col("__made.n_bytes")}).drop("__made")


def read_images(df: DataFrame, image_col: str = "__image") -> DataFrame:
    """All columns of ``df`` and ``__payload``, ``__hash`` (8 bytes) and ``__error`` (null if the image is sound).

    A null image gives nulls; a damaged one gives the error and nulls in the others, never an exception.
    """
    kind = "struct<payload: binary, hash: binary, error: string>"

    @F.pandas_udf(kind)
    def read(column):
        import pandas as pd

        rows = []
        for image in column:
            try:
                pixels = None if image is None else decode_png(image)
                rows.append((None, None, None) if pixels is None else (pixels.tobytes(), cosine_hash(pixels), None))
            except BadImage as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["payload", "hash", "error"])

    got = df.withColumn("__read", read(F.col(f"`{image_col}`")))
    return got.withColumns({"__payload": F.col("__read.payload"), "__hash": F.col("__read.hash"), "__error": F.col("__read.error")}).drop("__read")


def media_report(docs: DataFrame) -> DataFrame:
    """The digest columns of op2: images are written once as a binary column and all else is told from what is read back.

    A row for each row of ``docs``: null and empty texts make one row of spaces, repeated rows and ids stay, a null id stays
    null, and an empty table gives no rows. An image that can't be read back fails the query.
    """
    made = stored(to_images(docs.select(F.col("doc_id").cast("bigint"), "text")).select("doc_id", "__image", "__n_bytes"), "media")
    read = read_images(made).withColumn("__payload", F.coalesce("__payload", F.raise_error(F.col("__error"))))
    return read.select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.length("__payload").cast("bigint").alias("payload_bytes"), F.sha2("__payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("__payload", -16, 16)).alias("tail_crc32"), F.length("__image").cast("bigint").alias("media_bytes"), F.sha2("__image", 256).alias("media_sha256"), F.lower(F.hex("__hash")).alias("feature"),
    )
