"""Readers of semi-structured documents: cells, paragraphs, lines, links, payload fields and record blocks."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.operators import scan

#: Running headers, footers and notes of gazette texts that are no part of a document.
NOISE = (
    r"CÔNG BÁO/Số|^\s*PAGE\s+\d+|^\s*\d+\s*$|^VĂN BẢN PHÁP LUẬT KHÁC|^VĂN BẢN HỢP NHẤT|^Số\s+\d+\s*\+\s*\d+|^MỤC LỤC$|^Trang$"
    r"|^Văn bản hợp nhất số\s+\d+/VBHN|^\(Đăng từ Công báo|^\d{1,2}-\d{1,2}-\d{4}\s*-?\s*$"
    r"|^\d*\s*(Khoản|Điều|Điểm|Mục|Chương|Phần)\s+này\s+được\s+(bãi bỏ|sửa đổi|bổ sung|thay thế|hủy bỏ)|^Văn bản này được hợp nhất|^Văn bản hợp nhất này không"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, text): whole text files, numbered by the digits before their suffix."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return read.withColumn("part", F.coalesce(F.nullif(F.regexp_extract("path", r"_(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("int"), F.lit(0)))


def cells(texts: DataFrame) -> DataFrame:
    """(..., pos, cell): converted texts cut at cell marks and newlines, trimmed, blank ones kept; other columns stay."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", r"[\x07\n]")).alias("pos", "cell")).withColumn("cell", F.trim("cell"))


def lines(texts: DataFrame) -> DataFrame:
    """(..., pos, line): prose lines; rows of tables, blanks and running headers are left out; other columns stay."""
    cut = texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where(~F.col("line").contains("\x07")).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(NOISE))


def skip_preambles(prose: DataFrame, marker: str, doc: list[str]) -> DataFrame:
    """From each part its lines from the first structural marker on; a part without one stays whole."""
    first = prose.where(F.col("line").rlike(marker)).groupBy(*doc, "part").agg(F.min("pos").alias("__first"))
    return prose.join(first, [*doc, "part"], "left").where(F.col("__first").isNull() | (F.col("pos") >= F.col("__first"))).drop("__first")


def ordered(rows: DataFrame, doc: list[str]) -> DataFrame:
    """Adds ``ord``: the place of a row in its document over all parts, from 1, counted segment by segment. A document is one
    sequence, so ``doc`` names at least one column."""
    if not doc:
        raise ValueError("rows are numbered document by document: name the columns that tell documents apart")
    placed = rows.withColumn("__at", F.shiftleft(F.col("part").cast("bigint"), 40) + F.col("pos"))
    return scan.running(placed, doc, [scan.count("ord", F.lit(True))], "__at").drop("__at")


#: The namespace of word-processor markup.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraphs(content: bytes) -> list[str]:
    """Texts of the paragraphs of one word-processor package, in the order of their ends; what can be read of a damaged one.

    The main part is parsed as XML and freed paragraph by paragraph. Some writers put backslashes into part names or leave
    the namespace undeclared, so an element that declares it is put around the content.
    """
    out: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            parts = {p.filename.replace("\\", "/"): p for p in package.infolist()}
            if "word/document.xml" not in parts:
                return out
            body = package.read(parts["word/document.xml"]).removeprefix(b"\xef\xbb\xbf").lstrip()
            if body.startswith(b"<?xml"):
                body = body.partition(b"?>")[2]
            parser = ElementTree.XMLPullParser(["end"])
            for piece in (f'<all xmlns:w="{_WORD[1:-1]}">'.encode(), body, b"</all>"):
                parser.feed(piece)
                for _, node in parser.read_events():
                    if node.tag == f"{_WORD}p":
                        out.append("".join(t.text or "" for t in node.iter(f"{_WORD}t")))
                        node.clear()
    except (zipfile.BadZipFile, ElementTree.ParseError):
        pass
    return out


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of packages of paragraphs; one file is read in one task."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(contents):
        return contents.map(lambda x: _paragraphs(bytes(x)))

    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(split("content")).alias("pos", "line"))


def layout_lines(glyphs: DataFrame, page: list[str], body: float = 13, inline: float = 11) -> DataFrame:
    """Glyphs (size, top) of pages without footnotes: body sizes, and smaller ones down to the last body line."""
    bottom = F.max(F.when(F.round("size") >= body, F.col("top"))).over(Window.partitionBy(*page))
    keep = (F.col("size") >= body) | ((F.col("size") >= inline) & (F.col("top") <= F.coalesce("__bottom", F.lit(float("inf"))) + 2))
    return glyphs.withColumn("__bottom", bottom).where(keep).drop("__bottom")


def links(pages: DataFrame, page_id: str, markup: str, pattern: str | None = None) -> DataFrame:
    """(page_id, pos, href): the unescaped targets of a page's links, those that match ``pattern`` if given."""
    found = pages.select(page_id, F.posexplode(F.expr(f"regexp_extract_all({markup}, 'href=\"([^\"]*)\"', 1)")).alias("pos", "href"))
    found = found.withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
    return found.where(F.col("href").rlike(pattern)) if pattern else found


def first_link(found: DataFrame, page_id: str) -> DataFrame:
    """The first link of each page."""
    return found.groupBy(page_id).agg(F.min(F.struct("pos", "href"))["href"].alias("href"))


def payload_fields(df: DataFrame, payload: Column, names: list[str]) -> DataFrame:
    """Text fields of a JSON-like payload that is no whole document, by name; null where absent."""
    return df.withColumns({n: F.nullif(F.regexp_extract(payload, f'"{n}":"([^"]*)"', 1), F.lit("")) for n in names})


def payload_levels(payloads: DataFrame, payload: str) -> DataFrame:
    """(level, n): how many nodes of each level a payload's outline names."""
    found = payloads.select(F.explode(F.expr(f"""regexp_extract_all({payload}, '"level":"(Chapter|Article|Clause|Point)"', 1)""")).alias("level"))
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def record_blocks(texts: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each block that begins with '- id:', its fields without quotes; absent ones are empty."""
    blocks = texts.select(F.posexplode(F.split("text", r"(?m)^- id:")).alias("pos", "block")).where(F.col("pos") > 0)
    field = lambda k: F.regexp_replace(F.trim(F.regexp_extract("block", rf"(?m)^\s+{k}:[ \t]*(.*)$", 1)), "^['\"]|['\"]$", "")
    return blocks.select(F.trim(F.regexp_extract("block", r"^([^\n]*)", 1)).alias("id"), *[field(k).alias(k) for k in fields])
