"""The seventeen schema checks: eight rows that must be representable, nine that must be rejected."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from isochron.operators import integrity, temporal

SCHEMA = "id bigint, hs_code string, annex_id int, schedule string, rate_type string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, out_of_quota_annex_id int, effective_from date, effective_to date, superseded_at string"


def rate(i, hs="03011110", annex=2, schedule="MFN", kind="ad_valorem", percent="10", amount=None, quota=None, start="2023-07-15", end=None, gone=None):
    money = (Decimal(amount), "USD", "pc") if amount else (None, None, None)
    return (i, hs, annex, schedule, kind, None if percent is None else Decimal(percent), *money, quota, date.fromisoformat(start), date.fromisoformat(end) if end else None, gone)


GOOD = {
    "import annex": rate(1, percent="15"),
    "export annex": rate(2, annex=1, schedule="XK", percent="0"),
    "excluded": rate(3, hs="87032391", kind="excluded", percent=None),
    "absolute": rate(4, hs="87032490", kind="specific", percent=None, amount="10000"),
    "conditional": rate(5, hs="84818099", schedule="ACFTA", percent="0"),
    "quota": rate(6, hs="17019910", kind="trq", percent="25", quota=4),
    "before": rate(7, hs="27101221", percent="10", end="2026-03-08"),
    "after": rate(8, hs="27101221", percent="10", start="2026-05-01"),
}
BAD = {
    "excluded with a number": (rate(1, kind="excluded", percent="5"), "rate_shape"),
    "ad valorem with an amount": (rate(1, amount="3"), "rate_shape"),
    "quota without a pointer": (rate(1, kind="trq"), "rate_shape"),
    "no annex": (rate(1, annex=None), "annex_mandatory"),
    "ends before it starts": (rate(1, end="2020-01-01"), "interval_order"),
    "seven digits": (rate(1, hs="0301111"), "hs_code_digits"),
    "unknown type": (rate(1, kind="free"), "rate_shape"),
}


@pytest.mark.parametrize("name", GOOD)
def test_accepted(spark, name):
    assert integrity.violations(spark.createDataFrame([GOOD[name]], SCHEMA), integrity.rate_rules()).isEmpty()


@pytest.mark.parametrize("name", BAD)
def test_rejected(spark, name):
    row, rule = BAD[name]
    assert [r.rule for r in integrity.violations(spark.createDataFrame([row], SCHEMA), integrity.rate_rules()).collect()] == [rule]


def test_null_code_is_rejected(spark):
    found = integrity.violations(spark.createDataFrame([rate(1, hs=None)], SCHEMA), integrity.rate_rules())
    assert [r.rule for r in found.collect()] == ["hs_code_digits"]


def test_overlap_of_live_rows(spark):
    rows = [rate(1, hs="27101221", end="2026-03-08"), rate(2, hs="27101221", start="2026-04-01", end="2026-04-30"), rate(3, hs="27101221", start="2026-04-10", end="2026-05-10")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.id for r in temporal.overlap_flags(df, ["hs_code", "annex_id", "schedule"], "effective_from", "effective_to", ["id"]).collect()] == [3]
    assert [(r.first, r.second) for r in temporal.overlap_pairs(df, ["hs_code"], "effective_from", "effective_to", "id").collect()] == [(2, 3)]


def test_append_only(spark):
    old = spark.createDataFrame([rate(1), rate(2), rate(3), rate(4, gone="2026-01-01"), rate(5)], SCHEMA)
    new = spark.createDataFrame([rate(2, percent="11"), rate(3, gone="2026-02-01"), rate(4, gone="2026-02-01"), rate(5), rate(6)], SCHEMA)
    assert sorted(map(tuple, integrity.append_only_diff(old, new, "id").collect())) == [(1, "deleted"), (2, "changed"), (4, "second stamp")]


def test_lapse_reads_one_row_each(spark):
    base = spark.createDataFrame([rate(1, hs="27101221", percent="10")], SCHEMA)
    cuts = spark.createDataFrame([("27101221", date(2026, 3, 9), date(2026, 4, 30), Decimal(0))], "hs_code string, a date, b date, v decimal(7,4)")
    pieces = temporal.split_around(base, cuts, ["hs_code"], "effective_from", "effective_to", "rate_percent", "a", "b", "v")
    for day, want in (("2025-01-01", 10), ("2026-03-15", 0), ("2026-05-15", 10)):
        assert [int(r.rate_percent) for r in pieces.where(temporal.valid_at(day)).collect()] == [want]


def test_duty_shapes_and_stacking(spark):
    duties = spark.createDataFrame(
        [("72104900", "CN", "percent", Decimal("35.58"), None, None, None, date(2025, 1, 1), None), ("72104900", "KR", "percent", Decimal("5"), Decimal("3"), None, None, date(2025, 1, 1), None), ("72104900", "JP", "absolute", None, Decimal("3"), "USD", "t", date(2025, 1, 1), None)],
        "hs_code string, origin_country string, duty_kind string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, effective_from date, effective_to date",
    )
    assert [r.origin_country for r in integrity.violations(duties, integrity.duty_rules()).collect()] == ["KR"]
    base = spark.createDataFrame([rate(1, hs="72104900", percent="15"), rate(2, hs="11111111")], SCHEMA)
    both = base.join(duties.where(F.col("origin_country") == "CN").select("hs_code", F.col("rate_percent").alias("extra")), "hs_code", "left")
    assert sorted((r.hs_code, float(r.extra or 0)) for r in both.collect()) == [("11111111", 0.0), ("72104900", 35.58)]


def test_orphans_and_duplicates(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(1,), (1,)], "pid int")
    assert [r.id for r in integrity.orphans(child, parent, "parent", "pid").collect()] == [2]
    assert [tuple(r) for r in integrity.duplicates(parent, ["pid"]).collect()] == [(1, 2)]
