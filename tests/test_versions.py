"""Versioned tables: the schema's seventeen checks as refused or accepted changes, and writers that meet."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.operators import integrity
from isochron.sources.versions import Outdated, Refused, Rules, VersionedTable

DDL = "id bigint, hs_code string, annex_id int, schedule string, rate_type string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, out_of_quota_annex_id int, effective_from date, effective_to date, superseded_at timestamp"


def rate(i, hs="03011110", annex=2, kind="ad_valorem", percent="10", start="2023-07-15", end=None, gone=None):
    return (i, hs, annex, "MFN", kind, None if percent is None else Decimal(percent), None, None, None, None, date.fromisoformat(start), date.fromisoformat(end) if end else None, gone)


@pytest.fixture
def table(spark, tmp_path):
    rules = Rules("id", integrity.rate_rules, (["hs_code", "annex_id", "schedule"], "effective_from", "effective_to"), "superseded_at")
    return VersionedTable(spark, f"file://{tmp_path}/rates", T.StructType.fromDDL(DDL), lambda: F.substring("hs_code", 1, 2), rules)


def rows(spark, *found):
    return spark.createDataFrame(list(found), T.StructType.fromDDL(DDL))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_changes_are_refused_or_become_versions(spark, table):
    assert table.current().number == 0 and table.read().count() == 0
    table.append(rows(spark, rate(1), rate(2, "27101221", end="2026-03-08"), rate(3, "27101221", start="2026-05-01"), rate(4, annex=1, percent="0")))
    first = table.current()
    assert first.number == 1 and sorted(first.parts) == ["03", "27"]
    for bad, broken in (
        ([rate(5, "27101221", start="2026-05-10")], ["overlap"]), ([rate(3, "27109999"), rate(6, kind="trq")], ["unique_key", "rate_shape"]),
        ([rate(6, "03099990", annex=None), rate(7, "0301111"), rate(8, "03099992", end="2020-01-01")], ["annex_mandatory", "hs_code_digits", "interval_order"]),
    ):
        with pytest.raises(Refused) as e:
            table.append(rows(spark, *bad))
        assert set(broken) <= set(e.value.broken)
        assert table.current() == first and ids(table.read()) == [1, 2, 3, 4]
    table.append(rows(spark, rate(5, "27101221", start="2026-03-09", end="2026-04-30", percent="0")))
    assert ids(table.read()) == [1, 2, 3, 4, 5] and ids(table.read(1)) == [1, 2, 3, 4]
    # The part that wasn't touched is where it was.
    assert table.current().parts["03"] == first.parts["03"] != table.current().parts["27"]
    assert all("of_part=27" in f for f in table.read(parts=["27"]).inputFiles())


def test_rows_are_only_added_and_stamped_once(spark, table):
    table.append(rows(spark, rate(1), rate(2, "27101221")))
    for changed in ([], [rate(1, percent="11")], [rate(1, gone=datetime(2026, 1, 1)), rate(1)]):
        with pytest.raises(Refused):
            table.commit(rows(spark, *changed), ["03"], table.current())
    name = spark.createDataFrame([(1,)], "id bigint")
    table.supersede(name)
    assert [(r["id"], r["superseded_at"] is not None) for r in table.read().orderBy("id").collect()] == [(1, True), (2, False)]
    stamp = table.read(parts=["03"]).first()["superseded_at"]
    table.supersede(name)
    assert table.read(parts=["03"]).first()["superseded_at"] == stamp
    with pytest.raises(Refused) as e:
        table.commit(table.read(parts=["03"]).withColumn("superseded_at", F.lit("2020-01-01").cast("timestamp")), ["03"], table.current())
    assert e.value.broken == {"second stamp": 1}
    # With the former row out of force its successor may begin on the same day.
    table.append(rows(spark, rate(3)))
    assert ids(table.read().where("superseded_at is null")) == [2, 3]
    with pytest.raises(Refused) as e:
        table.commit(rows(spark, rate(9, "99999999")), ["03"], table.current())
    assert "part" in e.value.broken and "deleted" in e.value.broken


def test_of_two_writers_one_wins(spark, table):
    base = table.append(rows(spark, rate(1)))
    table.append(rows(spark, rate(2, "27101221")), base)
    with pytest.raises(Outdated):
        table.append(rows(spark, rate(3, "27101299")), base)
    assert ids(table.read()) == [1, 2]
    # A writer that died while it wrote its manifest leaves one that counts as none.
    fs, at = table._at("manifests/0000000003.json")
    fs.create(at, False).close()
    assert table.current().number == 2
    assert table.append(rows(spark, rate(3, "27101299"))).number == 4 and ids(table.read()) == [1, 2, 3]
    assert table.vacuum(2) == []
    assert len(table.vacuum(1)) == 1
    table.replace(rows(spark, rate(3, "27101299"), rate(2, "27101221"), rate(4, "27101230")))
    assert len(table.vacuum(1)) == 1
    assert ids(table.read()) == [1, 2, 3, 4]
