"""Parsers on small documents in the forms of the gazette."""

import zipfile

from pyspark.sql import functions as F

from isochron.operators import parsers
from isochron.sources import documents

CELLS = ["Biểu thuế nhập khẩu nói chung", "BIỂU THUẾ XUẤT KHẨU", "0301.11.10", "Cá cảnh", "", "0", "BIỂU THUẾ NHẬP KHẨU", "0301.11.10", "Cá", "cảnh khác", "15", "BIỂU THUẾ XUẤT KHẨU", "0301.11.20", "Theo hướng dẫn", "8703.23.91", "Xe", "*", "9801.00.10", "Hàng đặc biệt", "8481.80.99", "7,5", "9802.00.00", "Khác", "3"]


def frame(spark, cells, name="cell"):
    return spark.createDataFrame([("d", i, c) for i, c in enumerate(cells)], f"doc string, ord int, {name} string")


def test_tariff_rows(spark):
    rows = parsers.special_rows(parsers.tariff_rows(frame(spark, CELLS), ["doc"]), ["doc"])
    got = [(r.annex, r.hs, r.description, r.rate, r.corresponding) for r in rows.orderBy("row_no").collect()]
    assert got == [("I", "03011110", "Cá cảnh", "0", None), ("II", "03011110", "Cá", "15", None), ("II", "03011120", "Theo hướng dẫn", None, None), ("II", "87032391", "Xe", "*", None), ("II", "98010010", "Hàng đặc biệt", "7,5", "84818099"), ("II", "98020000", "Khác", "3", None)]


def test_rate_runs(spark):
    cells = ["0101.21.00", "Ngựa", "", "5", "", "4", "3", "2", "1", "0", "0102.21.00", "Bò", "*", "0103.10.00", "không có"]
    rows = parsers.tariff_rows(frame(spark, cells), ["doc"])
    assert [(r.hs, r.rates) for r in rows.orderBy("row_no").collect()] == [("01012100", ["5", "4", "3", "2", "1", "0"]), ("01022100", ["*"]), ("01031000", [])]


def test_fragments_and_regions(spark):
    cells = frame(spark, ["1111", "Phụ lục IV", "0407", "21", "00", "Trứng", "80", "1701", "13", "00", "x", "2401", "10", "10", "90", "Hết"])
    inside = parsers.region(cells, ["doc"], F.col("cell").startswith("Phụ lục IV"), F.col("cell") == "Hết")
    assert [(r.hs, r.rate) for r in parsers.fragmented_codes(inside, ["doc"]).orderBy("row_no").collect()] == [("04072100", "80"), ("17011300", None), ("24011010", "90")]


def test_nomenclature(spark):
    cells = ["84.81", "Vòi, van", "8481.80", "- Thiết bị khác:", "- - Van lốp:", "8481.80.11", "- - - Bằng đồng", "8481.80.12", "- - - Khác", "8481.80.99", "- - Loại khác", "84.82", "Ổ lăn", "8482.10.00", "- Ổ bi", "8481.80.11", "- Lần hai"]
    got = {r.hs: r.path for r in parsers.nomenclature_paths(frame(spark, cells), ["doc"]).collect()}
    assert got["84818011"] == "Vòi, van › Thiết bị khác › Van lốp › Bằng đồng" and got["84818012"].endswith("Van lốp › Khác")
    assert got["84818099"] == "Vòi, van › Thiết bị khác › Loại khác" and got["84821000"] == "Ổ lăn › Ổ bi"


LAW = ["Căn cứ Luật", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "Mở đầu", "1. Khoản một", "tiếp", "a) Điểm a", "tiếp điểm", "b) Điểm b", "2. Khoản hai", "Mục 1", "HỒ SƠ", "Điều 2. Đối tượng", "Toàn văn", "Chương II", "THỦ TỤC", "Điều 3.12Đăng ký", "1.33 Nộp", "Điều 1. Hiệu lực thi hành", "Lặp lại", "Nơi nhận: x", "Điều 9. Sau chữ ký"]


def test_provisions_and_chunks(spark):
    prose = frame(spark, LAW, "line").withColumnRenamed("doc", "document").withColumn("short", F.lit("NĐ 1"))
    nodes = parsers.provisions(prose)
    got = [(r.ptype, r.number, r.parent_key, r.path) for r in nodes.orderBy("order_index").collect()]
    assert got == [
        ("chuong", "I", None, "NĐ 1 › Chương I"), ("dieu", "1", "d::chuong-I", "NĐ 1 › Chương I › Điều 1"), ("khoan", "1", "d::dieu-1", "NĐ 1 › Chương I › Điều 1 › Khoản 1"),
        ("diem", "a", "d::dieu-1-khoan-1", "NĐ 1 › Chương I › Điều 1 › Khoản 1 › Điểm a"), ("diem", "b", "d::dieu-1-khoan-1", "NĐ 1 › Chương I › Điều 1 › Khoản 1 › Điểm b"), ("khoan", "2", "d::dieu-1", "NĐ 1 › Chương I › Điều 1 › Khoản 2"),
        ("muc", "1", "d::chuong-I", "NĐ 1 › Chương I › Mục 1"), ("dieu", "2", "d::chuong-I-muc-1", "NĐ 1 › Chương I › Mục 1 › Điều 2"), ("chuong", "II", None, "NĐ 1 › Chương II"), ("dieu", "3", "d::chuong-II", "NĐ 1 › Chương II › Điều 3"), ("khoan", "1", "d::dieu-3", "NĐ 1 › Chương II › Điều 3 › Khoản 1"),
    ]
    body = {r.key: r.body for r in nodes.collect()}
    assert body["d::dieu-1-khoan-1"] == "Khoản một\ntiếp\na) Điểm a\ntiếp điểm\nb) Điểm b" and body["d::dieu-1-khoan-1-diem-a"] == "Điểm a\ntiếp điểm"
    docs = spark.createDataFrame([("d", "Tóm tắt", "2024-01-01", None, None)], "number string, summary string, effective_from string, effective_to string, effectiveness string")
    made = {r.provision_key: r for r in parsers.chunks(nodes, docs).collect()}
    assert sorted(made) == ["d::dieu-1-khoan-1", "d::dieu-1-khoan-2", "d::dieu-2", "d::dieu-3-khoan-1"]
    assert made["d::dieu-2"].body == "Điều 2. Đối tượng\nToàn văn" and made["d::dieu-2"].embed_text.startswith("Tóm tắt\n") and made["d::dieu-2"].effectiveness == "con_hieu_luc"
    with_ids = parsers.with_parents(nodes.withColumn("id", F.xxhash64("key")))
    assert with_ids.where(F.col("parent_key").isNotNull() & F.col("parent_id").isNull()).isEmpty()
    assert {r.ptype: r.n for r in parsers.structural_counts(nodes).collect()} == {"chuong": 2, "muc": 1, "dieu": 3, "khoan": 3, "diem": 2}


def test_readers(spark, tmp_path):
    for i, body in ((2, "tựa\nChương II\nhai\n12\n"), (10, "không dấu\nCÔNG BÁO/Số 5\nx\x07y\n"), (1, "mở\nĐiều 1. Một\n")):
        (tmp_path / f"law_{i}.txt").write_text(body)
    prose = documents.lines(documents.read_texts(spark, str(tmp_path / "law_*.txt"))).withColumn("doc", F.lit("d"))
    kept = documents.ordered(documents.skip_preambles(prose, f"{parsers.CHAPTER}|{parsers.ARTICLE}", ["doc"]), ["doc"])
    assert [r.line for r in kept.orderBy("ord").collect()] == ["Điều 1. Một", "Chương II", "hai", "không dấu"]
    cells = documents.cells(spark.createDataFrame([(1, "a\x07 b \n\x07c")], "part int, text string"))
    assert [r.cell for r in cells.orderBy("pos").collect()] == ["a", "b", "", "c"]
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word\\document.xml", "<w:p><w:tab/><w:t>Điều &amp; </w:t><w:t xml:space='preserve'>một</w:t></w:p><w:p><w:t>hai</w:t></w:p>")
    assert [r.line for r in documents.read_paragraphs(spark, str(tmp_path / "x.docx")).orderBy("pos").collect()][:2] == ["Điều & một", "hai"]
    glyphs = spark.createDataFrame([(1, 14.0, 10.0), (1, 14.0, 50.0), (1, 12.0, 40.0), (1, 12.0, 90.0), (1, 8.0, 20.0)], "page int, size double, top double")
    assert documents.layout_lines(glyphs, ["page"]).count() == 3


def test_records_links_payloads(spark):
    body = "head\n- id: imp-001\n  hs_code: '8481.80.99'\n  applied_rate: \"12%\"\n- id: imp-002\n  hs_code: 0301.11.10\n  applied_rate: KCT\n"
    got = documents.record_blocks(spark.createDataFrame([(body,)], "text string"), ["hs_code", "applied_rate", "note"]).collect()
    assert [tuple(r) for r in got] == [("imp-001", "8481.80.99", "12%", ""), ("imp-002", "0301.11.10", "KCT", "")]
    pages = spark.createDataFrame([(1, '<a href="/a.doc?x=1&amp;y=2">k</a><a href="/b.pdf">')], "page_id int, html string")
    assert [r.href for r in documents.links(pages, "page_id", "html", r"\.doc").collect()] == ["/a.doc?x=1&y=2"]
    payload = spark.createDataFrame([('{"docNum":"12/2024","level":"Article","level":"Article","level":"Point"}',)], "p string")
    assert documents.payload_fields(payload, F.col("p"), ["docNum", "issueDate"]).collect()[0][1:] == ("12/2024", None)
    assert {r.level: r.n for r in documents.payload_levels(payload, "p").collect()} == {"Article": 2, "Point": 1}


def test_paragraphs_of_a_package_with_its_own_namespaces(tmp_path):
    body = (
        '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:o="urn:other"><w:body>'
        '<w:p w:rsidR="1"><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">Điều &lt;1&gt; </w:t></w:r><o:x><w:r><w:t>một</w:t></w:r></o:x></w:p><w:p/><w:p><w:r><o:t>no text</o:t></w:r></w:p></w:body></w:document>'
    )
    for name in ("word/document.xml", "word\\document.xml"):
        with zipfile.ZipFile(tmp_path / "y.docx", "w") as z:
            z.writestr(name, body)
        assert documents._paragraphs((tmp_path / "y.docx").read_bytes()) == ["Điều <1> một", "", ""]
    assert documents._paragraphs(b"no package") == []
