"""The legacy archive converter: ARC parsing, synthesised WARC records, and reading back."""

import gzip
import os

import pytest

from isochron.llm import warc
from isochron.llm.common import fresh_path

TRICKY = ["", "plain", "WARC/1.0\r\n\r\nContent-Length: 9\r\n\r\n", "\r\n\r\n\r\n", "filedesc://x 0\n12", "é" * 1000, "\0\x01"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    archive = warc.arc_preamble(version) + b"".join(warc.arc_record(version, f"http://h/{i} x", t.encode()) for i, t in enumerate(TRICKY))
    found = list(warc.parse_arc(archive))
    assert [a.payload.decode() for a in found] == TRICKY
    assert {a.version for a in found} == {version} and found[1].fields["url"] == "http://h/1%20x"
    (head, block), = warc.parse_warc(warc.warc_record(found[1], warc.record_id(7)))
    assert head["WARC-Type"] == "resource" and block == b"plain" and head["Content-Type"] == "text/html"
    assert head["WARC-Date"] == "2024-01-01T00:00:00Z" and head["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(b'plain')}"


@pytest.mark.parametrize("text", TRICKY)
def test_http_messages_are_responses_and_revisits(text):
    body = text.encode()
    (arc,) = warc.parse_arc(warc.arc_preamble(1) + warc.arc_record(1, "http://h/", warc.http_message(body)))
    (response, block), = warc.parse_warc(warc.warc_record(arc, warc.record_id(7)))
    (revisit, head), = warc.parse_warc(warc.warc_record(arc, warc.record_id(8), warc.record_id(7)))
    assert (response["WARC-Type"], revisit["WARC-Type"]) == ("response", "revisit") and warc.page_of(revisit["WARC-Refers-To"]) == 7
    assert block == head + body and warc.split_http(block) == (head, body) and f"Content-Length: {len(body)}".encode() in head
    assert response["WARC-Payload-Digest"] == revisit["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(body)}"
    assert response["Content-Type"] == "application/http; msgtype=response" and response["WARC-Block-Digest"] == f"sha1:{warc.base32_sha1(block)}"


def test_members_stand_alone():
    parts = [b"", b"a" * 200_000, os.urandom(150_000), b"end"]
    packed = [warc.member(x) for x in parts]
    found = list(warc.members(b"".join(packed[:2]) + b"\0\0" + b"".join(packed[2:])))
    assert [x for _, x in found] == parts and found[3][0] == sum(map(len, packed[:3])) + 2
    assert gzip.decompress(b"".join(packed)) == warc.unpacked(b"".join(packed)) == b"".join(parts)
    assert list(warc.members(b"plain")) == [(0, b"plain")] and list(warc.members(b"")) == [(0, b"")]
    for bad in (packed[3][:-1], packed[3] + b"x", packed[3][:12] + b"\xff" * 8):
        with pytest.raises(warc.BadArchive):
            list(warc.members(bad))


def test_damaged_archives_are_told():
    good = warc.arc_preamble(1) + warc.arc_record(1, "u", b"payload")
    for bad in (good[:-5], good[:-9], good.replace(b"text/html 7", b"text/html x"), good.replace(b"text/html 7", "text/html ²".encode()), b"no newline", good.replace(b"u 0.0.0.0", b"u")):
        with pytest.raises(warc.BadArchive):
            list(warc.parse_arc(bad))
    with pytest.raises(warc.BadArchive):
        list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nab\r\n\r\n"))
    for head in (b"WARC-Type: response", b"Content-Length: -1", b"Content-Length: x"):
        with pytest.raises(warc.BadArchive):
            list(warc.parse_warc(b"WARC/1.0\r\n" + head + b"\r\n\r\n\r\n\r\n"))


def test_dates_and_identifiers():
    assert [warc.warc_date(x) for x in ("20230405060708", "20230405", "2023", "20231350", "-")] == ["2023-04-05T06:07:08Z", "2023-04-05T00:00:00Z", *["1970-01-01T00:00:00Z"] * 3]
    assert warc.page_of("<urn:uuid:00000000-0000-0000-0000-000000000001>") is None
    assert [warc.page_of(warc.record_id(i)) for i in (0, 1, -1, 2**63 - 1, -(2**63))] == [0, 1, -1, 2**63 - 1, -(2**63)]


def test_write_and_read_back(spark):
    rows = [(i, f"http://h/{i}", t, "x", "y") for i, t in enumerate(TRICKY * 2)] + [(50, None, None, "x", "y"), (51, "", "solo", "x", "y"), (51, "", "solo", "x", "y"), (None, "u", "lost", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, refers_to string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.warc_report(pages).collect())
    best = {}
    for i, _, t, _, _ in rows:
        if i is not None:
            best[t or ""] = max(best.get(t or "", -1), i)
    want = []
    for i, _, t, _, _ in rows:
        if i is not None:
            body, top = (t or "").encode(), best[t or ""]
            want.append((i, "response" if i == top else "revisit", None if i == top else top, len(body), warc.base32_sha1(body)))
    assert got == sorted(want, key=lambda r: r[0])
    assert warc.warc_report(pages.limit(0)).count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long payload"), (4, "u", "long payload")], "page_id bigint, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages, path, min_bytes=5)
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.read_warc(spark, path).collect() if r["refers_to"] is not None) == [(3, 4)]


def test_archives_are_bounded_by_bytes_and_indexed(spark):
    big = os.urandom(9_000_000).hex()
    rows = [(i, f"http://h/{i}", os.urandom(3000).hex()) for i in range(60)] + [(100, "http://h/big", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages, path, archive_bytes=40_000)
    read = warc.read_warc(spark, path).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["read_digest"]) for r in read) == [(i, len(t), warc.base32_sha1(t.encode())) for i, _, t in rows]
    files = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).collect()}
    large = {r["file"] for r in read if r["page_id"] == 100}
    assert len(files) > 5 and len(large) == 1 and all(len(c) <= 40_000 for f, c in files.items() if f not in large)
    for name, content in files.items():
        kinds = [h["WARC-Type"] for h, _ in warc.parse_warc(gzip.decompress(content))]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}
    for r in read:
        (head, _), = warc.parse_warc(next(x for _, x in warc.members(files[r["file"]][r["offset"] :])))
        assert head["WARC-Record-ID"] == r["record_id"] == warc.record_id(r["page_id"])


def test_convert_arc_files(spark, tmp_path):
    folder = tmp_path / "arc"
    folder.mkdir()
    for version, pack in ((1, gzip.compress), (2, bytes)):
        (folder / f"v{version}.arc").write_bytes(pack(warc.arc_preamble(version) + b"".join(warc.arc_record(version, f"http://h/{i}", t.encode()) for i, t in enumerate(TRICKY))))
    (folder / "empty.arc").write_bytes(b"")
    warc.convert_arc(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    got = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert len(got) == 2 * len(TRICKY) == len({r["record_id"] for r in got}) and {r["page_id"] for r in got} == {None}
    assert sorted(r["block_digest"] for r in got) == sorted(warc.base32_sha1(t.encode()) for t in TRICKY * 2)


def test_damaged_files_give_rows_and_hold_nothing_up(spark, tmp_path):
    folder = tmp_path / "arc"
    folder.mkdir()
    record = lambda i: warc.arc_record(1, f"http://h/{i}", b"payload")
    good = warc.arc_preamble(1) + record(1) + record(2)
    (folder / "good.arc").write_bytes(good)
    (folder / "blank.arc").write_bytes(good.replace(b"http://h/2", b"http://h/a b  c"))
    (folder / "length.arc").write_bytes(warc.arc_preamble(1) + record(3) + record(4).replace(b"text/html 7", "text/html ²".encode()) + record(5))
    (folder / "short.arc").write_bytes(gzip.compress(good[:-3]))
    (folder / "torn.arc").write_bytes(warc.member(warc.arc_preamble(1) + record(6)) + warc.member(record(7))[:-9])
    warc.convert_arc(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    got = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    uris = sorted(r["target_uri"] for r in got if r["error"] is None)
    assert uris == sorted([*["http://h/1"] * 3, "http://h/2", "http://h/a%20b%20%20c", "http://h/3", "http://h/6"])
    told = {r["target_uri"].rpartition("/")[2]: r["error"] for r in got if r["error"] is not None}
    assert sorted(told) == ["length.arc", "short.arc", "torn.arc"] and "length" in told["length.arc"] and "member" in told["torn.arc"]

    other = tmp_path / "other"
    other.mkdir()
    whole = [warc.member(warc.warc_record(next(warc.parse_arc(good)), warc.record_id(i))) for i in range(3)]
    (other / "part-0.warc").write_bytes(whole[0] + whole[1] + whole[2][:-9])
    (other / "part-1.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: none\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + b"junk")
    read = warc.read_warc(spark, f"file://{other}").collect()
    assert sorted(r["page_id"] for r in read if r["error"] is None) == [0, 1]
    assert sorted((r["file"][-6:], r["offset"]) for r in read if r["error"] is not None) == [("0.warc", len(whole[0]) + len(whole[1])), ("1.warc", 0), ("1.warc", 0)]


def test_equal_payloads_are_told_by_sha256(spark):
    """Of two texts with one SHA-1 neither would be lost: the key has nothing to do with the header's digest."""
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", None), (4, "u", "")], "page_id bigint, url string, html string")
    found = sorted((r["page_id"], len(r["payload"]), r["refers_to"]) for r in warc.references(pages).collect())
    assert found == [(1, 32, 2), (3, 32, 4)]
