"""Answers, wording, search and loading on hand-made rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.operators import tariff
from isochron.sources import tables


@pytest.fixture(scope="module")
def data(spark):
    s = tables.schemas()
    schedules = spark.createDataFrame([(1, "NK_uu_dai", "MFN", None, False), (2, "ACFTA", "A-C", "E", True), (3, "XK", "export", None, False), (4, "NK_ngoai_han_ngach", "out", None, False), (5, "NK_uu_dai_98", "98", None, False)], s["tariff_schedule"])
    annexes = spark.createDataFrame([(1, 1, "I", "x", "export"), (2, 1, "II", "n", "import")], s["annex"])
    decrees = spark.createDataFrame([(1, "26/2023", "t", None, None, date(2023, 7, 15), None)], s["decree"])

    def rate(i, hs, annex, schedule, kind, percent, amount=None, start=date(2023, 7, 15), end=None, gone=None):
        return (i, hs, 1, annex, schedule, kind, percent, amount, "USD" if amount else None, "pc" if amount else None, 4 if kind == "trq" else None, start, end, 1, None, None, datetime(2026, 1, 1), gone)

    rates = spark.createDataFrame(
        [rate(1, "84818099", 2, 1, "ad_valorem", Decimal("10")), rate(2, "84818099", 2, 2, "ad_valorem", Decimal("0")), rate(3, "84818099", 1, 3, "ad_valorem", Decimal("7.5")), rate(4, "17019910", 2, 1, "trq", Decimal("25")), rate(5, "87032490", 2, 1, "compound", Decimal("5"), Decimal("10000")), rate(6, "87032391", 2, 1, "excluded", None), rate(7, "84818099", 2, 1, "ad_valorem", Decimal("99"), gone=datetime(2025, 1, 1))],
        s["tariff_rate"],
    )
    goods = spark.createDataFrame([("84818099", "Vòi và van", "Loại khác", "Vòi và van › Loại khác"), ("84818011", "Ống", "VÒI", "Ống › VÒI nước"), ("84818012", "Vòing", "x", "Vòing › x")], s["hs_description"])
    duties = spark.createDataFrame([(1, "84818099", "CN", "X", "QD1", "percent", Decimal("35.58"), None, None, None, date(2024, 1, 1), None, None, None), (2, "84818099", "AU", "Y", "QD2", "absolute", None, Decimal("3"), "USD", "t", date(2024, 1, 1), None, None, None)], s["anti_dumping_duty"])
    return {"rates": rates, "schedules": schedules, "annexes": annexes, "decrees": decrees, "goods": goods, "duties": duties}


def test_nested_answer(data):
    got = tariff.lookup(**data, hs="8481.80.99", day="2026-01-05", origin="cn").collect()[0].asDict(True)
    assert got["import"]["mfn"]["statement"] == "10%" and got["export"]["statement"] == "7.5%"
    assert [p["statement"] for p in got["import"]["preferential"]] == ["0% nếu có C/O form E hợp lệ, ngược lại 10% (MFN)"]
    assert [d["statement"] for d in got["anti_dumping"]] == ["Chống bán phá giá 35.58% (cộng thêm thuế NK), xuất xứ CN"]
    assert got["notes"] == [tariff.NOTE_CERTIFICATE] and got["goods"]["heading"] == "Vòi và van"


def test_notes_and_forms(data):
    quota = tariff.lookup(**data, hs="17019910", day="2026-01-05", origin="JP").collect()[0]
    assert quota.notes[0] == tariff.NOTE_QUOTA and "JP" in quota.notes[1] and quota.goods is None and quota.anti_dumping == []
    assert tariff.lookup(**data, hs="87032490", day="2026-01-05").collect()[0]["import"].mfn.statement == "5% + 10000.00 USD/pc"
    assert tariff.lookup(**data, hs="87032391", day="2026-01-05").collect()[0].notes == [tariff.NOTE_EXCLUDED]
    assert [r.origin_country for r in tariff.anti_dumping(data["duties"], "2026-01-05").orderBy("origin_country").collect()] == ["AU", "CN"]


def test_refusals(data):
    with pytest.raises(tariff.RateNotFound):
        tariff.lookup(**data, hs="99999999", day="2026-01-05")
    with pytest.raises(tariff.RateNotFound):
        tariff.lookup(**data, hs="84818099", day="2020-01-01")
    for hs, day in (("123", "2026-01-05"), ("84818099", "5/1/2026")):
        with pytest.raises(ValueError):
            tariff.lookup(**data, hs=hs, day=day)


def test_search(data):
    mfn = tariff.current_mfn(data["rates"], data["schedules"], "2026-01-05")
    found = [(r.hs_code, r.mfn) for r in tariff.search(data["goods"], mfn, "vòi").collect()]
    assert found == [("84818099", Decimal("10")), ("84818011", None)]
    assert [r.hs_code for r in tariff.search(data["goods"], mfn, "x", "8481.80.1").collect()] == ["84818011", "84818012"]
    assert [r.hs_code for r in tariff.search(data["goods"], mfn, "vòing", "848").collect()] == ["84818012"]
    with pytest.raises(ValueError):
        tariff.search(data["goods"], mfn, "a")


def test_text_functions(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).collect()[0]
    got = row(a=text.dotted_code(F.lit("84818099")), b=text.upper_or_null(F.lit(" cn ")), c=text.upper_or_null(F.lit("  ")), d=text.parse_percent(F.lit("7,5")), e=text.parse_percent(F.lit("KCT")), f=text.show_percent(F.lit(Decimal("10.0000"))), g=text.show_percent(F.lit(None).cast("decimal(7,4)")), h=text.path_tail(F.lit("a › b › c")), i=text.ellipsis(F.lit("abcdef"), 3), j=text.last_cell(F.lit("a | b | 7")), k=text.dash_depth(F.lit("- - - Loại khác:")), l=text.undashed(F.lit("- - Loại khác:")), m=text.first_object(F.lit('x {"a": 1} y')), n=text.unescape_html(text.escape_html(F.lit("<a & 'b'>"))), o=text.parse_percent(F.lit("12%")))
    assert tuple(got)[:15] == ("8481.80.99", "CN", None, Decimal("7.5000"), None, "10", "0", "b › c", "abc…", "7", 3, "Loại khác", '{"a": 1}', "<a & 'b'>", Decimal("12.0000"))
    assert text.query_terms("Thuế của VAN và van, 84!") == ["thuế", "van", "84"]
    assert row(a=text.composed(F.lit("é"))).a == "é"


def test_loading(spark, tmp_path, data):
    path = str(tmp_path / "rates")
    assert not tables.populated(spark, path)
    assert tables.load_unless_populated(spark, data["rates"], path) and not tables.load_unless_populated(spark, data["rates"], path)
    assert tables.load_unless_populated(spark, data["rates"], path, force=True)
    tables.append(data["rates"].limit(1), path)
    assert spark.read.parquet(path).count() == 8
    keyed = tables.with_keys(spark.createDataFrame([("b",), ("a",)], "code string"), ["code"])
    assert sorted(map(tuple, keyed.collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "x.ndjson").write_text('{"hs": "1", "rates": ["5"]}\n\n{"hs": "2", "rates": []}\n')
    (tmp_path / "x.json").write_text('[{"hs": "1", "rate": "50"},\n {"hs": "2", "rate": null}]')
    assert tables.read_ndjson(spark, str(tmp_path / "x.ndjson"), "hs string, rates array<string>").where("hs is not null").count() == 2
    assert tables.read_json_array(spark, str(tmp_path / "x.json"), "hs string, rate string").count() == 2
    assert tables.health(spark, ["nowhere"]) == {"status": "degraded", "missing": ["nowhere"], "error": None}


def test_typing_and_first_rows(spark):
    rows = spark.createDataFrame([("1", 1, None), ("1", 2, "5"), ("1", 3, "7"), ("2", 1, None), ("2", 2, None), ("3", 1, "*")], "hs string, pos int, rate string")
    first = tariff.first_rows(rows, "hs", "pos", prefer="rate")
    assert sorted(map(tuple, first.select("hs", "pos").collect())) == [("1", 2), ("2", 1), ("3", 1)]
    typed = tariff.typed_rows(first, spark.createDataFrame([("1",)], "hs string"))
    assert sorted((r.hs, r.rate_type) for r in typed.collect()) == [("1", "trq"), ("3", "excluded")]
