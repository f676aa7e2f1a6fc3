"""Glyphs of PDF pages, with size and place: files are cut into pages, and pages are read on their own.

Read are objects, object streams and page trees; content that is stored plainly or deflated; simple fonts, and composite
ones by their map to Unicode. A damaged file gives the pages that can be reached, a page in another coding no glyphs.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(?:(?P<open><<|\[)|(?P<close>>>|\])|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<text>\()|<(?P<hex>[0-9A-Fa-f\0\t\n\f\r ]*)>|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+))")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, as /Font."""


class Word(str):
    """An operator or a keyword."""


class Ref(int):
    """The number of another object."""


class Scanner:
    """Objects one after the other; ``at`` is where the last one ended. The end of the data, or what is none, ends it."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __iter__(self):
        return self

    def __next__(self):
        m = _TOKEN.match(self.data, self.at)
        if not m:
            raise StopIteration
        self.at, kind = m.end(), m.lastgroup
        if kind == "number":
            return float(m[kind]) if b"." in m[kind] else int(m[kind])
        if kind == "name":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[kind]).decode("latin-1"))
        if kind == "hex":
            digits = re.sub(rb"\s|\0", b"", m[kind])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == "text":
            return self._text()
        if kind == "open":
            return self._group(m[kind])
        return Word(m[m.lastgroup].decode("latin-1"))

    def _text(self) -> bytes:
        out, depth, data, i = bytearray(), 1, self.data, self.at
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                c = data[i + 1 : i + 2]
                out += b"" if c in (b"\n", b"\r") else _ESCAPES.get(c, c)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.at = i
        return bytes(out)

    def _group(self, opened: bytes):
        found: list = []
        for x in self:
            if isinstance(x, Word) and x in (">>", "]"):
                break
            if isinstance(x, Word) and x == "R" and len(found) > 1:
                found[-2:] = [Ref(found[-2])]
            else:
                found.append(x)
        return found if opened == b"[" else {k: v for k, v in zip(found[::2], found[1::2], strict=False) if isinstance(k, Name)}


class File:
    """The objects of one file, found by their headers; a number that comes twice counts where it comes last."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.streams = data, {}, {}
        at = 0
        while m := re.compile(rb"(\d+)[ \t\r\n]+\d+[ \t\r\n]+obj\b").search(data, at):
            scan = Scanner(data, m.end())
            value = next(scan, None)
            at = max(scan.at, m.end())
            self.objects[int(m[1])] = value
            begins = re.compile(rb"[ \t\r\n]*stream\r?\n").match(data, at)
            if isinstance(value, dict) and begins:
                size = value.get("Length")
                end = begins.end() + size if isinstance(size, int) and not isinstance(size, Ref) else data.find(b"endstream", begins.end())
                self.streams[int(m[1])] = data[begins.end() : end if end >= 0 else len(data)]
                at = max(at, end)
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._packed(number, value)

    def _packed(self, number: int, head: dict) -> None:
        body = self.stream(Ref(number)) or b""
        n, first = self.get(head.get("N")) or 0, self.get(head.get("First")) or 0
        numbers = [x for x, _ in zip(Scanner(body), range(2 * n), strict=False)]
        for i, offset in zip(numbers[::2], numbers[1::2], strict=False):
            self.objects.setdefault(i, next(Scanner(body, first + offset), None))

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(int(x))
        return x

    def stream(self, ref) -> bytes | None:
        """The content of a stream; None in a coding that isn't read."""
        raw, head = self.streams.get(int(ref)), self.get(ref)
        if raw is None or not isinstance(head, dict):
            return None
        coded = self.get(head.get("Filter"))
        for name in [] if coded is None else coded if isinstance(coded, list) else [coded]:
            if name not in ("FlateDecode", "Fl"):
                return None
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> Iterator[dict]:
        """Each page with what it inherits, in the order of the tree."""
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo: list = [(v.get("Pages"), {}) for v in roots[-1:]]
        seen = set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else -1)
            mine = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Kids") is None:
                yield mine | node
            else:
                todo.extend((k, mine) for k in reversed(self.get(node["Kids"]) or []))

    def font(self, ref) -> dict:
        """What glyphs need of a font: bytes a code, characters and widths of codes, and how far it goes below the line."""
        font = self.get(ref) or {}
        wide = font.get("Subtype") == "Type0"
        inner = self.get((self.get(font.get("DescendantFonts")) or [{}])[0]) if wide else font
        chars: dict[str, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            chars = _unicode_map(self.stream(font["ToUnicode"]) or b"")
        widths: dict[str, float] = {}
        if wide:
            listed = self.get(inner.get("W")) or []
            i = 0
            while i + 1 < len(listed):
                first, then = listed[i], self.get(listed[i + 1])
                if isinstance(then, list):
                    widths |= {str(first + k): w for k, w in enumerate(then)}
                    i += 2
                else:
                    widths |= {str(k): listed[i + 2] for k in range(first, min(then, first + 65536) + 1)} if i + 2 < len(listed) else {}
                    i += 3
        else:
            widths = {str((self.get(font.get("FirstChar")) or 0) + k): w for k, w in enumerate(self.get(font.get("Widths")) or [])}
        below = (self.get(inner.get("FontDescriptor")) or {}).get("Descent", 0) if isinstance(inner, dict) else 0
        return {"bytes": 2 if wide else 1, "chars": chars, "widths": widths, "default": (inner.get("DW", 1000) if wide else 500), "below": min(0, below)}


def _unicode_map(cmap: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    text = lambda x: x.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", cmap, re.S):
        found = list(Scanner(body))
        step = 2 if kind == b"bfchar" else 3
        for row in (found[i : i + step] for i in range(0, len(found) - step + 1, step)):
            first = int.from_bytes(row[0], "big")
            if step == 2:
                out[str(first)] = text(row[1])
            else:
                for k in range(min(int.from_bytes(row[1], "big") - first, 65535) + 1):
                    base = row[2]
                    out[str(first + k)] = text(base[k]) if isinstance(base, list) and k < len(base) else text((int.from_bytes(base, "big") + k).to_bytes(len(base), "big")) if isinstance(base, bytes) else ""
    return out


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def glyphs_of(content: bytes, fonts: dict, height: float) -> Iterator[tuple[str, float, float, float, float]]:
    """(character, x, end, top, size) of each glyph that a content stream shows, in its order."""
    unit = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    space, saved = unit, []
    line = here = unit
    font, size, lead, extra, blank, rise = {"bytes": 1, "chars": {}, "widths": {}, "default": 500, "below": 0}, 0.0, 0.0, 0.0, 0.0, 0.0
    given: list = []

    def show(data: bytes) -> Iterator[tuple]:
        nonlocal here
        for i in range(0, len(data), font["bytes"]):
            code = int.from_bytes(data[i : i + font["bytes"]], "big")
            c = font["chars"].get(str(code)) or (bytes([code]).decode("cp1252", "replace") if font["bytes"] == 1 else "�")
            at = _times([1, 0, 0, 1, 0, rise], _times(here, space))
            scale = abs(at[3]) or abs(at[2])
            forward = font["widths"].get(str(code), font["default"]) / 1000 * size
            end = _times([1, 0, 0, 1, forward, 0], _times(here, space))
            yield c, at[4], end[4], height - (at[5] + (1 + font["below"] / 1000) * size * scale), size * scale
            here = _times([1, 0, 0, 1, forward + extra + (blank if code == 32 and font["bytes"] == 1 else 0), 0], here)

    for x in Scanner(content):
        if not isinstance(x, Word):
            given.append(x)
            continue
        if x == "q":
            saved.append(space)
        elif x == "Q" and saved:
            space = saved.pop()
        elif x == "cm" and len(given) == 6:
            space = _times(given, space)
        elif x == "BT":
            line = here = unit
        elif x == "Tf" and len(given) == 2:
            font, size = fonts.get(given[0], font), float(given[1])
        elif x in ("TL", "Tc", "Tw", "Ts") and given:
            lead, extra, blank, rise = (float(given[-1]) if x == name else old for name, old in zip(("TL", "Tc", "Tw", "Ts"), (lead, extra, blank, rise), strict=True))
        elif x in ("Td", "TD") and len(given) == 2:
            lead = -given[1] if x == "TD" else lead
            line = here = _times([1, 0, 0, 1, *given], line)
        elif x == "Tm" and len(given) == 6:
            line = here = [float(v) for v in given]
        elif x in ("T*", "'", '"'):
            if x == '"' and len(given) == 3:
                blank, extra = given[0], given[1]
            line = here = _times([1, 0, 0, 1, 0, -lead], line)
        if x in ("Tj", "'", '"') and given and isinstance(given[-1], bytes):
            yield from show(given[-1])
        elif x == "TJ" and given and isinstance(given[-1], list):
            for piece in given[-1]:
                if isinstance(piece, bytes):
                    yield from show(piece)
                elif isinstance(piece, (int, float)):
                    here = _times([1, 0, 0, 1, -piece / 1000 * size, 0], here)
        given = []


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, pos, glyph, x, end, top, size) of the PDF files at ``path``: pages from 0, ``top`` from the page's upper edge.

    A file is cut into its pages in one task, as its objects may lie anywhere in it; pages are then dealt anew and read
    each on its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                file = File(data)
                rows = []
                for i, page in enumerate(file.pages()):
                    refs = page.get("Contents")
                    listed = file.get(refs)
                    try:
                        parts = [file.stream(r) or b"" for r in (listed if isinstance(listed, list) else [refs]) if isinstance(r, Ref)]
                    except zlib.error:
                        parts = []
                    fonts = file.get((file.get(page.get("Resources")) or {}).get("Font")) or {}
                    box = [float(v) for v in file.get(page.get("MediaBox")) or [0, 0, 595, 842]]
                    rows.append((name, i, b"\n".join(parts), json.dumps({k: file.font(v) for k, v in fonts.items()}), box[3]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.float64()), strict=True)], names=["path", "page", "content", "fonts", "height"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, page, content, fonts, height in zip(*[b[c].to_pylist() for c in ("path", "page", "content", "fonts", "height")], strict=True):
                found = list(glyphs_of(content, json.loads(fonts), height))
                if found:
                    glyph, *numbers = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([page] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(glyph), *[pa.array(n, pa.float64()) for n in numbers]], names=["path", "page", "pos", "glyph", "x", "end", "top", "size"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    pages = files.mapInArrow(cut, "path string, page int, content binary, fonts string, height double").repartition("path", "page")
    return pages.mapInArrow(read, "path string, page int, pos int, glyph string, x double, end double, top double, size double")


def lines_of(glyphs: DataFrame, apart: float = 3.0) -> DataFrame:
    """(path, page, pos, line): the text lines of pages, from the top down; lines are told by the feet of their glyphs.

    Glyphs whose feet lie within ``apart`` of the one above are one line, and a gap of more than that between two of them
    is a blank. A page is one group.
    """
    foot = F.col("top") + F.col("size")
    down = Window.partitionBy("path", "page").orderBy("__foot", "x", "pos")
    rows = glyphs.withColumn("__foot", foot).withColumn("__new", F.coalesce((F.col("__foot") - F.lag("__foot").over(down) > apart).cast("int"), F.lit(1)))
    rows = rows.withColumn("__line", F.sum("__new").over(down))
    along = Window.partitionBy("path", "page", "__line").orderBy("x", "pos")
    gap = F.col("x") - F.lag("end").over(along) > apart
    told = rows.withColumn("__text", F.when(gap & (F.col("glyph") != " "), F.concat(F.lit(" "), "glyph")).otherwise(F.col("glyph")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "pos", "__text"))), lambda g: g["__text"]), "")
    return told.groupBy("path", "page", (F.col("__line") - 1).cast("int").alias("pos")).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("line"))


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, pos, line) of the body of PDF files: footnotes and the numbers that refer to them are left out."""
    from isochron.sources.documents import layout_lines

    return lines_of(layout_lines(read_glyphs(spark, path), ["path", "page"]))
