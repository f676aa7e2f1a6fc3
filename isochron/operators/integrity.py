"""Data-quality gates in the place of constraints and triggers: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HS8 = r"^\d{8}$"


def _absent(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNull()
    return out


def _present(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def rate_shape() -> Column:
    """Which columns a rate type needs and forbids; an unknown type never fits."""
    money = ("amount", "amount_currency", "amount_unit")
    kind = F.col("rate_type")
    return (
        F.when(kind == "ad_valorem", _present("rate_percent") & _absent(*money))
        .when(kind == "specific", _absent("rate_percent") & _present(*money))
        .when(kind == "compound", _present("rate_percent", *money))
        .when(kind == "excluded", _absent("rate_percent", "amount"))
        .when(kind == "trq", _present("rate_percent", "out_of_quota_annex_id"))
        .otherwise(False)
    )


def duty_shape() -> Column:
    """The same for anti-dumping duties."""
    return (
        F.when(F.col("duty_kind") == "percent", _present("rate_percent") & _absent("amount"))
        .when(F.col("duty_kind") == "absolute", _absent("rate_percent") & _present("amount", "amount_currency", "amount_unit"))
        .otherwise(False)
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row that breaks a rule, once for each such rule, named in ``rule``; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def rate_rules() -> dict[str, Column]:
    """Row rules of the rate table."""
    return {
        "hs_code_digits": F.col("hs_code").rlike(HS8),
        "annex_mandatory": F.col("annex_id").isNotNull(),
        "interval_order": F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")),
        "rate_shape": rate_shape(),
    }


def duty_rules() -> dict[str, Column]:
    """Row rules of the anti-dumping table."""
    return {
        "hs_code_digits": F.col("hs_code").rlike(HS8),
        "interval_order": F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")),
        "duty_shape": duty_shape(),
    }


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias("__parent")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("__parent"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def append_only_diff(old: DataFrame, new: DataFrame, key: str, stamp: str = "superseded_at") -> DataFrame:
    """(key, violation) between two snapshots: deleted rows, changes of any column but a first stamp, a second stamp."""
    names = [c for c in old.columns if c not in (key, stamp)]
    a = old.select(F.col(key), F.struct(*names).alias("a"), F.col(stamp).alias("sa"), F.lit(True).alias("ha"))
    b = new.select(F.col(key).alias("__key"), F.struct(*names).alias("b"), F.col(stamp).alias("sb"), F.lit(True).alias("hb"))
    both = a.join(b, F.col(key) == F.col("__key"), "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    rule = (
        F.when(F.col("hb").isNull(), "deleted")
        .when(F.col("ha").isNull(), None)
        .when(~same, "changed")
        .when(F.col("sa").isNotNull() & ~F.col("sa").eqNullSafe(F.col("sb")), "second stamp")
    )
    return both.select(F.coalesce(F.col(key), F.col("__key")).alias(key), rule.alias("violation")).where(F.col("violation").isNotNull())
