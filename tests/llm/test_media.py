"""PNG columns: exact round trips, all filters, damaged files, and the digests of op2."""

import struct
import zlib

import numpy as np
import pytest

from isochron.llm import media, queries
from tests.llm import brute


def png(pixels, kinds, colour=2):
    """A PNG whose rows take the given filters, byte by byte as the format's text has it."""
    height, width, step = pixels.shape
    rows = pixels.reshape(height, -1).astype(int)
    body = b""
    for r, kind in enumerate(kinds):
        out = []
        for c, x in enumerate(rows[r]):
            left = rows[r][c - step] if c >= step else 0
            up = rows[r - 1][c] if r else 0
            corner = rows[r - 1][c - step] if r and c >= step else 0
            near = min((abs(left + up - corner - v), k, v) for k, v in enumerate((left, up, corner)))[2]
            out.append((x - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        body += bytes([kind, *out])
    packed = zlib.compress(body)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_all_filters(colour):
    rng = np.random.default_rng(colour)
    pixels = rng.integers(0, 256, (11, 9, media.CHANNELS[colour]), dtype=np.uint8)
    kinds = [4, 3, 0, 1, 2, 2, 1, 4, 4, 3, 3]
    assert (media.decode_png(png(pixels, kinds, colour)) == pixels).all()


def test_damage_is_told():
    good = media.encode_png(media.pad(b"some text"))
    for k in (0, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(media.BadImage):
            media.decode_png(bytes(bad))
    for cut in (4, 20, 50, len(good) - 5):
        with pytest.raises(media.BadImage):
            media.decode_png(good[:cut])
    with pytest.raises(media.BadImage):
        media.unfilter(np.zeros((1, 3), np.uint8), np.array([7]), 3)


def test_near_images_have_near_hashes():
    rng = np.random.default_rng(1)
    base = np.cumsum(rng.normal(0, 6, (64, 64, 3)), axis=0).clip(-100, 100) + 128
    noisy = (base + rng.normal(0, 2, base.shape)).clip(0, 255)
    other = np.cumsum(rng.normal(0, 6, (64, 64, 3)), axis=1).clip(-100, 100) + 128
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert far(base, noisy) <= 4 < far(base, other)


def test_op2_over_the_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.queries()["op2_media_columns"](spark, sf).collect()
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), brute.sha(want), zlib.crc32(want[-16:]))
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"]) and len(r["feature"]) == 16


def test_columns_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "é" * 300_000, "k"), (3, "x" * 192, "k"), (None, "x" * 193, "k")], "doc_id bigint, text string, image string")
    read = media.read_images(media.to_images(docs))
    assert read.columns == ["doc_id", "text", "image", "__image", "__n_bytes", "__payload", "__hash", "__error"]
    for r in read.collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["__payload"]) == media.pad(raw) and len(r["__payload"]) % 192 == 0 and r["__n_bytes"] == len(raw) and r["__error"] is None
    assert media.read_images(media.to_images(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(None,), (b"no image",)], "__image binary")
    assert sorted((r["__error"] or "") for r in media.read_images(broken).collect()) == ["", "signature"]


def test_report_reads_a_written_binary_column(spark, monkeypatch):
    kept = []

    def keep(df, label, store=media.stored):
        kept.append(store(df, label))
        return kept[-1]

    monkeypatch.setattr(media, "stored", keep)
    docs = spark.createDataFrame([(1, None), (2, "é" * 5_000), (None, "x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in media.media_report(docs).collect()}
    assert dict(kept[0].dtypes)["__image"] == "binary" and kept[0].inputFiles()
    for r in kept[0].collect():
        image, pixels = bytes(r["__image"]), media.decode_png(bytes(r["__image"]))
        want = got[r["doc_id"]]
        assert (want["media_bytes"], want["media_sha256"], want["feature"]) == (len(image), brute.sha(image), media.cosine_hash(pixels).hex())
        assert (want["payload_sha256"], want["tail_crc32"]) == (brute.sha(pixels.tobytes()), zlib.crc32(pixels.tobytes()[-16:]))
    monkeypatch.setattr(media, "stored", lambda df, label: df.withColumn("__image", media.F.lit(b"no image")))
    with pytest.raises(Exception, match="signature"):
        media.media_report(docs).collect()


@pytest.mark.parametrize("head", [(0, 1, 8, 2, 0, 0, 0), (1, 0, 8, 2, 0, 0, 0), (1, 1, 16, 2, 0, 0, 0), (1, 1, 8, 3, 0, 0, 0), (1, 1, 8, 2, 1, 0, 0), (1, 1, 8, 2, 0, 1, 0), (1, 1, 8, 2, 0, 0, 1), (2**31, 2**31, 8, 2, 0, 0, 0), (2, 1, 8, 2, 0, 0, 0)])
def test_every_odd_header_is_told_and_fails_no_job(spark, head):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = [zlib.compress(b"\0abc"), b"no stream", zlib.compress(b"\0" * 1000)[:-5]]
    images = [media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + chunk(b"IDAT", d) + chunk(b"IEND", b"") for d in data]
    images += [media.SIGNATURE + chunk(b"IHDR", b"short") + chunk(b"IEND", b""), media.SIGNATURE + chunk(b"IEND", b"")]
    got = media.read_images(spark.createDataFrame([(x,) for x in images], "__image binary")).collect()
    assert all(r["__error"] and r["__payload"] is None and r["__hash"] is None for r in got)


def test_the_feature_is_a_plain_cosine_transform():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    small = pixels.mean(axis=2).reshape(32, 2, 32, 2).mean(axis=(1, 3))
    low = []
    for u in range(8):
        for v in range(8):
            low.append(round(sum(small[y][x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 5))
    middle = sorted(low[1:])[31]
    assert media.cosine_hash(pixels) == bytes(sum((low[8 * k + i] > middle) << (7 - i) for i in range(8)) for k in range(8))
