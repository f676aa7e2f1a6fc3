"""PDF pages: objects, fonts, places, and the filter of footnotes."""

import zlib

import pytest
from pyspark.sql import functions as F

from isochron.sources import pages


def pdf(contents, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Times /FirstChar 32 /Widths [%s] >>" % (b"500 " * 95), pack=False, extra=()):
    """A file of one page for each content stream; object 3 is the font, extra objects from 200."""
    pieces = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents))), len(contents)), font]
    objects = [(i + 1, p) for i, p in enumerate(pieces)] + list(extra)
    for i, c in enumerate(contents):
        body = zlib.compress(c) if pack else c
        objects += [(10 + 2 * i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)), (11 + 2 * i, b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if pack else b"", body))]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


BODY = b"BT /F1 14 Tf 72 780 Td (Body one) Tj 0 -20 Td [(Bo) -20 (dy) -800 (two)] TJ /F1 8 Tf (40) Tj ET q 1 0 0 1 0 -100 cm BT /F1 12 Tf 1 0 0 1 72 800 Tm (inline small) Tj ET Q BT /F1 14 Tf 72 650 Td (last \\(body\\) \\101) Tj ET BT /F1 12 Tf 72 100 Td (foot note) Tj ET"


@pytest.mark.parametrize("pack", [False, True])
def test_glyphs_and_lines(spark, tmp_path, pack):
    (tmp_path / "a.pdf").write_bytes(pdf([BODY, b"BT /F1 14 Tf 20 TL 72 700 Td (first) Tj T* (second) Tj (third) ' ET"], pack=pack))
    (tmp_path / "bad.pdf").write_bytes(b"no file")
    glyphs = pages.read_glyphs(spark, f"file://{tmp_path}")
    sizes = {r["size"] for r in glyphs.where("page = 0").collect()}
    assert sizes == {14.0, 12.0, 8.0}
    first = glyphs.where("page = 0 and pos = 0").first()
    assert (first["glyph"], first["x"], first["top"]) == ("B", 72.0, 842 - 780 - 14)
    got = [(r["page"], r["line"]) for r in pages.read_pdf_lines(spark, f"file://{tmp_path}").orderBy("page", "pos").collect()]
    assert got == [(0, "Body one"), (0, "Body two"), (0, "inline small"), (0, "last (body) A"), (1, "first"), (1, "second"), (1, "third")]


def test_composite_fonts_map_to_unicode(spark, tmp_path):
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [200 0 R] /ToUnicode 201 0 R >>"
    cmap = b"/CIDInit begincmap 2 beginbfchar <0001> <0110> <0002> <1EC1> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0075> <0020>] endbfrange endcmap"
    extra = [(200, b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [1 [700 600] 16 18 400] /FontDescriptor << /Descent -200 >> >>"), (201, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap))]
    (tmp_path / "v.pdf").write_bytes(pdf([b"BT /F1 14 Tf 72 700 Td <000100100002002000210010> Tj ET"], font, extra=extra))
    found = pages.read_glyphs(spark, f"file://{tmp_path}").orderBy("pos").collect()
    assert "".join(r["glyph"] for r in found) == "Đaều a"
    assert [round(r["end"] - r["x"], 3) for r in found[:3]] == [9.8, 5.6, 8.4]
    assert found[0]["top"] == pytest.approx(842 - (700 + 0.8 * 14))


def test_objects_inside_object_streams():
    inner = b"1 0 2 40 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [] >>"
    packed = zlib.compress(inner)
    data = b"%%PDF\n9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(packed), packed)
    file = pages.File(data)
    assert file.objects[1]["Type"] == "Catalog" and list(file.pages()) == [{"Type": "Pages", "Kids": []}] or list(file.pages()) == []
    assert pages.File(b"").pages() is not None and list(pages.File(b"\x00\xff(((").pages()) == []
    looped = pages.File(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R 3 0 R] >> endobj 3 0 obj << /Type /Page >> endobj")
    assert len(list(looped.pages())) == 1


def test_lines_of_an_empty_page(spark):
    none = spark.createDataFrame([], "path string, page int, pos int, glyph string, x double, end double, top double, size double")
    assert pages.lines_of(none).count() == 0
    two = spark.createDataFrame([("p", 0, 1, "b", 20.0, 25.0, 10.0, 14.0), ("p", 0, 0, "a", 10.0, 15.0, 10.5, 14.0)], none.schema)
    assert [r["line"] for r in pages.lines_of(two).collect()] == ["a b"]
    assert F.col("x") is not None
