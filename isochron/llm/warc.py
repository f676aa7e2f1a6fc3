"""Legacy archive converter: ARC records to WARC records, with archives written and read through Spark's own file sinks."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.llm.common import cut, fresh_path, texts

END = b"\r\n"
#: Half of a record's UUID that marks it as made from a page number; the other half is that number.
_MARK = 0x6973_6F63_6872_8F6E
#: Fields of the header line of an ARC record, by the version that the archive's first record states.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
#: Bytes of one archive file at most, as a file is read back whole in one task; a single larger record has its own.
ARCHIVE_BYTES = 64 << 20
#: Bytes of rows that a task holds before it hands them on.
_FLUSH = 8 << 20


#: A declared length: ASCII digits, few enough to be one.
_DIGITS = re.compile("[0-9]{1,15}")
#: The type of a record that tells of damage found while converting.
_DAMAGE = "text/x-damage"


class BadArchive(ValueError):
    """A header line or a declared length that doesn't fit the archive, or a member that can't be read, which begins at ``at``."""

    def __init__(self, problem: str, at: int | None = None):
        super().__init__(problem)
        self.at = at


def record_id(page_id: int) -> str:
    """The identifier of a page's record: the page number is its lower half."""
    return f"<urn:uuid:{uuid.UUID(int=(_MARK << 64) | (page_id & (1 << 64) - 1))}>"


def page_of(identifier: str) -> int | None:
    """Inverse of ``record_id``; None where the identifier isn't made from a page number."""
    high, low = divmod(uuid.UUID(identifier.strip("<>").rpartition(":")[2]).int, 1 << 64)
    return None if high != _MARK else low - (1 << 64) if low >> 63 else low


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str) -> str:
    """A URL or a name as one field: blanks and control characters percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text) or "-"


def arc_preamble(version: int, name: str = "pages.arc") -> bytes:
    """The first record of an archive: the version block that names the fields to come."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 isochron\n{names}\n".encode()
    line = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20240101000000", "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(len(body))}
    return " ".join(line[k] for k in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str = "20240101000000", mime: str = "text/html", name: str = "pages.arc") -> bytes:
    """One record: header line, payload, newline."""
    line = {"url": _field(url), "ip": "0.0.0.0", "date": date, "type": mime, "result": "200", "checksum": hashlib.md5(payload).hexdigest(), "location": "-", "offset": "0", "file": name, "length": str(len(payload))}
    return " ".join(line[k] for k in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n"


@dataclass
class Arc:
    """A parsed ARC record."""

    version: int
    fields: dict[str, str]
    payload: bytes


def parse_arc(archive: bytes, version: int | None = None) -> Iterator[Arc]:
    """Records of an archive: each header line is read by the version the archive states, each payload by its declared length.

    A header line's fields are told from its right end, as old archives have URLs with blanks. ``BadArchive`` is raised
    where the archive can't be followed any further; the records before have been given by then.
    """
    at = 0
    while at < len(archive):
        if archive[at : at + 1] == b"\n":
            at += 1
            continue
        end = archive.find(b"\n", at)
        if end < 0:
            raise BadArchive("header line without an end")
        line = archive[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = line[0].startswith("filedesc://")
        if not _DIGITS.fullmatch(line[-1]):
            raise BadArchive(f"declared length in the header line at byte {at}")
        size = int(line[-1])
        payload = archive[end + 1 : end + 1 + size]
        if len(payload) != size:
            raise BadArchive("payload shorter than declared")
        if first:
            version = int(payload[:1]) if _DIGITS.fullmatch(payload[:1].decode("ascii", "replace")) else 1
        names = ARC_FIELDS.get(version or 1)
        if names is None or len(line) < len(names):
            raise BadArchive(f"{len(line)} fields in the header line of version {version} at byte {at}")
        if len(line) > len(names):
            behind = len(names) - 1
            line = [_field(" ".join(line[:-behind])), *line[-behind:]]
        at = end + 1 + size
        if not first:
            yield Arc(version or 1, dict(zip(names, line, strict=True)), payload)


def warc_date(arc_date: str) -> str:
    """14 (or fewer) digits to the ISO form in UTC; what can't be read becomes the epoch."""
    try:
        return datetime.strptime(arc_date.ljust(14, "0") if len(arc_date) >= 8 else "", "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def http_message(html: bytes) -> bytes:
    """A page as the response that a server would have sent; it is what an archive keeps of it."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP response; None for a block that isn't one."""
    end = block.find(END + END)
    return (block[: end + 4], block[end + 4 :]) if block.startswith(b"HTTP/") and end >= 0 else None


def warc_record(arc: Arc, identifier: str, refers_to: str | None = None) -> bytes:
    """The WARC record synthesised from an ARC record.

    An HTTP message is a response, or a revisit of the record ``refers_to``, which keeps the message's head only; what
    was archived without its HTTP head is a resource. The payload digest is always of the full payload.
    """
    message = split_http(arc.payload)
    head, payload = message or (b"", arc.payload)
    kind = "resource" if message is None else "response" if refers_to is None else "revisit"
    block = head if kind == "revisit" else arc.payload
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Target-URI: {arc.fields['url']}", f"WARC-Date: {warc_date(arc.fields['date'])}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {arc.fields['type'] if message is None else 'application/http; msgtype=response'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + END + block + END + END


def damage_record(source: str, problem: str) -> bytes:
    """A record that tells what was wrong with an archive that was converted, so that the damage is known where its records are."""
    block = problem.encode()
    lines = ["WARC/1.0", "WARC-Type: metadata", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#damage')}>", f"WARC-Target-URI: {_field(source)}", f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {_DAMAGE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + END + block + END + END


def warc_info() -> bytes:
    """The record that opens each archive and says what it holds."""
    block = b"software: isochron\r\nformat: WARC File Format 1.0\r\n"
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + END + block + END + END


def member(record: bytes) -> bytes:
    """A record as one gzip member, so that it can be read from its offset alone."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def members(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; zero bytes between members are skipped. Plain bytes are one member."""
    if archive[:2] != b"\x1f\x8b":
        yield 0, archive
        return
    view, at = memoryview(archive), 0
    while at < len(archive):
        if archive[at] == 0:
            at += 1
            continue
        # Fed piece by piece, as what follows a member is copied when it ends.
        inflate, start, parts = zlib.decompressobj(31), at, []
        try:
            while not inflate.eof and at < len(archive):
                parts.append(inflate.decompress(view[at : at + 65_536]))
                at += 65_536
        except zlib.error as e:
            raise BadArchive(f"gzip member at byte {start}: {e}", start) from e
        if not inflate.eof:
            raise BadArchive(f"gzip member at byte {start} without an end", start)
        at = min(at, len(archive)) - len(inflate.unused_data)
        yield start, b"".join(parts)


def unpacked(archive: bytes) -> bytes:
    """The content of all members of an archive."""
    return b"".join(content for _, content in members(archive))


def readable(archive: bytes) -> tuple[bytes, str | None]:
    """(content, problem): the content of the members before the first damaged one, and what is wrong with that."""
    parts: list[bytes] = []
    try:
        for _, content in members(archive):
            parts.append(content)
    except BadArchive as e:
        return b"".join(parts), str(e)
    return b"".join(parts), None


def parse_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; text inside a block is never searched for headers."""
    at = 0
    while at < len(archive):
        split = archive.find(END + END, at)
        if split < 0 or not archive.startswith(b"WARC/", at):
            raise BadArchive(f"no record at byte {at}")
        head = archive[at:split].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in head)}
        if not _DIGITS.fullmatch(fields.get("Content-Length", "")):
            raise BadArchive(f"record at byte {at}: its declared length")
        size = int(fields["Content-Length"])
        block = archive[split + 4 : split + 4 + size]
        if len(block) != size or archive[split + 4 + size : split + 8 + size] != END + END:
            raise BadArchive(f"record at byte {at}: its length")
        yield fields, block
        at = split + 8 + size


def _payload_key(html: Column) -> Column:
    """The 256 bits by which payloads are equal; SHA-1, which can be made to collide, only stands in headers."""
    return F.unhex(F.sha2(F.encode(F.coalesce(html, F.lit("")), "UTF-8"), 256))


def references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload, refers_to) of the pages whose payload a larger page_id holds too; keyed by SHA-256 and size."""
    keyed = pages.select("page_id", _payload_key(F.col("html")).alias("payload"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes))
    # Written once, so that the join below deals both sides anew and a payload that many pages share can be split.
    winners = cut(keyed.groupBy("payload", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where(F.col("refers_to") > F.col("least")).drop("least"))
    return keyed.join(winners, ["payload", "size"]).where(F.col("page_id") != F.col("refers_to")).select("page_id", "payload", "refers_to").distinct()


def _archived(records: Iterator[bytes], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (archive, place, record) of gzip members dealt to archives of at most ``limit`` bytes, each opened by its warcinfo."""
    archive, place, used, held, rows = -1, 0, limit, 0, []

    def flush() -> pa.RecordBatch:
        numbers, places, packed = zip(*rows, strict=True)
        # The sink ends each row with a zero byte, which is the last byte of a member of less than 16 MiB anyway.
        cut = [m[:-1] if m[-1] == 0 else m for m in packed]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(places, pa.int64()), pa.array(cut, pa.binary()).cast(pa.string(), safe=False)], names=["archive", "place", "record"])

    for record in records:
        packed = member(record)
        if used + len(packed) + 1 > limit:
            opening = member(warc_info())
            archive, place, used = archive + 1, 0, len(opening)
            rows.append((archive, place, opening))
        place, used, held = place + 1, used + len(packed) + 1, held + len(packed)
        rows.append((archive, place, packed))
        if held >= _FLUSH:
            yield flush()
            held, rows = 0, []
    if rows:
        yield flush()


def _save(rows: DataFrame, path: str) -> None:
    """Write rows of ``_archived``: a file for each archive of a task, in the order of its places."""
    placed = rows.sortWithinPartitions("archive", "place").select("archive", "record")
    placed.write.partitionBy("archive").option("lineSep", "\0").text(path)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write WARC archives of one record for each row of ``pages`` (page_id, url, html); other columns are ignored.

    Each page is laid out as an ARC record of its HTTP message (version 1 or 2 in turn) and converted from it. A null
    html is empty, a null url is "-"; rows with a null page_id are left out, as their record could not be told apart. Of
    equal payloads of at least ``min_bytes`` bytes the largest page_id is the response; rows that repeat it are responses
    too. An empty table gives no archives.

    Each record is a gzip member of its own, and an archive ends before the record that would take it beyond
    ``archive_bytes``. The files are made by the text sink, so they can lie in any store that Spark writes to; its line
    separator is a zero byte, the last byte of each member, or for records of 16 MiB or more a byte of padding behind it,
    which readers of gzip skip.
    """
    refs = references(pages, min_bytes).select(F.col("page_id").alias("__page"), F.col("payload").alias("__payload"), "refers_to")
    keyed = pages.where(F.col("page_id").isNotNull()).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("__own", _payload_key(F.col("html")))
    joined = keyed.join(refs, (F.col("page_id") == F.col("__page")) & (F.col("__own") == F.col("__payload")), "left").select("page_id", "url", "html", "refers_to")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for page, url, html, ref in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), texts(b["html"]), b["refers_to"].to_pylist(), strict=True):
                version = 1 + (page & 1)
                (arc,) = parse_arc(arc_preamble(version) + arc_record(version, url or "", http_message(html)))
                yield warc_record(arc, record_id(page), None if ref is None else record_id(ref))

    _save(joined.mapInArrow(lambda batches: _archived(records(batches), archive_bytes), "archive int, place bigint, record string"), path)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert whole ARC files (plain or gzip) to WARC archives; records are named by file and place.

    Each file is read in one task, as its lengths chain its records; ARC files are about 100 MB by convention. Of a damaged
    file the records before the damage are converted, and a metadata record tells what was wrong, as what follows a wrong
    length can't be told from a payload; ``read_warc`` shows it in ``error``. Other files are not held up. An empty file
    gives no records. Records keep their order within an archive, equal ones are all kept, and none is a revisit.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                whole, problem = readable(content)
                try:
                    for i, arc in enumerate(parse_arc(whole)):
                        yield warc_record(arc, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{i}')}>")
                except BadArchive as e:
                    problem = problem or str(e)
                if problem:
                    yield damage_record(path, problem)

    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    _save(files.mapInArrow(lambda batches: _archived(records(batches), archive_bytes), "archive int, place bigint, record string"), warc_path)


READ_SCHEMA = "page_id bigint, record_id string, record_type string, target_uri string, date string, payload_bytes bigint, payload_digest string, refers_to bigint, block_digest string, read_digest string, file string, offset bigint, error string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``, but for the warcinfo records; a folder without files gives none.

    ``page_id`` and ``refers_to`` are null where an identifier isn't made from a page number. ``payload_digest`` is the
    declared one; ``block_digest`` and ``read_digest`` are computed from the block and the payload read, the latter null
    for revisits, whose payload lies elsewhere and whose ``payload_bytes`` is what their HTTP head declares. ``file`` and
    ``offset`` tell where the record's gzip member begins, so that the table, once written, is an index. A record without
    the fields of its type, or an archive that can't be followed any further, gives a row with ``error``, its file and
    the offset of its member, and nulls; the records before stay. So does a record that tells of damage found in conversion.
    """

    def row_of(fields: dict[str, str], block: bytes, path: str, offset: int) -> tuple:
        kind = fields["WARC-Type"]
        head, payload = split_http(block) or (b"", block)
        ref, size = fields.get("WARC-Refers-To"), len(payload)
        if kind == "revisit":
            declared = [x.partition(b":")[2].strip().decode("ascii", "replace") for x in head.split(END) if x.lower().startswith(b"content-length:")]
            size = int(declared[0]) if declared and _DIGITS.fullmatch(declared[0]) else None
        error = block.decode("utf-8", "replace") if fields.get("Content-Type") == _DAMAGE else None
        return (page_of(fields["WARC-Record-ID"]), fields["WARC-Record-ID"], kind, fields["WARC-Target-URI"], fields["WARC-Date"], size, fields.get("WARC-Payload-Digest", "").rpartition(":")[2] or None,
                page_of(ref) if ref else None, base32_sha1(block), None if kind == "revisit" else base32_sha1(payload), path, offset, error)

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        offset = 0
        bad = lambda problem, at: (*[None] * 10, path, at, str(problem))
        try:
            for offset, unit in members(content):
                for fields, block in parse_warc(unit):
                    if fields.get("WARC-Type") != "warcinfo":
                        try:
                            yield row_of(fields, block, path, offset)
                        except (KeyError, ValueError) as e:
                            yield bad(f"record without a readable {e}", offset)
        except BadArchive as e:
            yield bad(e, offset if e.at is None else e.at)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                rows = list(rows_of(path, content))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)


def warc_report(pages: DataFrame) -> DataFrame:
    """The columns of op7, from archives written to the shared folder and read back.

    A response's digest and size are of the payload that was read, a revisit's those its record declares. Nulls, ties,
    repeated rows and empty tables are as ``write_warc`` has them.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages.select(F.col("page_id").cast("bigint"), "url", "html"), path)
    return read_warc(pages.sparkSession, path).select("page_id", "payload_bytes", F.coalesce("read_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
