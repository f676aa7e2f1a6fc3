"""Schemas of the engine's tables, and readers and writers for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schemas() -> dict[str, T.StructType]:
    """One StructType for each table; built on demand, as DDL needs a running session."""
    ddl = {
        "hs_version": "id int, code string, effective_from date, effective_to date, note string",
        "decree": "id int, number string, title string, signed_date date, gazette_date date, effective_from date, effective_to date",
        "annex": "id int, decree_id int, code string, name string, trade_direction string",
        "tariff_schedule": "id int, code string, name string, fta_form string, requires_co boolean",
        "tariff_rate": "id bigint, hs_code string, hs_version_id int, annex_id int, schedule_id int, rate_type string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, out_of_quota_annex_id int, effective_from date, effective_to date, source_decree_id int, conditions string, source_cell_text string, recorded_at timestamp, superseded_at timestamp",
        "anti_dumping_duty": "id bigint, hs_code string, origin_country string, exporter string, decision_number string, duty_kind string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, effective_from date, effective_to date, recorded_at timestamp, superseded_at timestamp",
        "hs_description": "hs_code string, heading string, description string, path string",
        "lookup_confirmation": "id bigint, hs_code string, origin string, as_of_date date, schedule string, verdict string, staff_name string, note string, response_snapshot string, created_at timestamp",
        "legal_document": "id int, number string, title string, doc_type string, effectiveness string, effective_from date, effective_to date, source_url string, embed_model string, superseded_at timestamp",
        "legal_provision": "id bigint, document_id int, key string, parent_id bigint, ptype string, number string, order_index int, heading string, body string, path string, citation_label string, effectiveness string, effective_from date, effective_to date",
        "legal_chunk": "id bigint, provision_id bigint, article_provision_id bigint, document_id int, sac_prefix string, body string, embed_text string, embedding array<float>, tokens array<string>, effective_from date, effective_to date, effectiveness string",
    }
    return {k: T.StructType.fromDDL(v) for k, v in ddl.items()}


#: Enums sort by declaration, not by name.
TRADE_DIRECTIONS = ("import", "export")
RATE_TYPES = ("ad_valorem", "specific", "compound", "excluded", "trq")
DUTY_KINDS = ("percent", "absolute")
VERDICTS = ("correct", "wrong", "unsure")


def ordinal(column: str, values: tuple[str, ...]):
    """Place of an enum's value in its declaration, for sorting; others last."""
    place = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return place


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object on each line; no inference, blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def reload(df: DataFrame, path: str) -> None:
    """Replace a table's content, so that a repeated load leaves the same rows."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(path)


def populated(spark: SparkSession, path: str, live_only: bool = True) -> bool:
    """Whether a table holds a (live) row; False where nothing was written yet. Reads until the first row only."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    if live_only and "superseded_at" in df.columns:
        df = df.where(F.col("superseded_at").isNull())
    return not df.limit(1).isEmpty()


def load_unless_populated(spark: SparkSession, df: DataFrame, path: str, force: bool = False) -> bool:
    """Load unless live rows are there already; says whether it loaded."""
    if not force and populated(spark, path):
        return False
    reload(df, path)
    return True


def load(facts: DataFrame, facts_path: str, dimension: DataFrame, dimension_path: str, force: bool = False) -> bool:
    """Facts unless they are there already, the dimension always; says whether facts were loaded."""
    reload(dimension, dimension_path)
    return load_unless_populated(facts.sparkSession, facts, facts_path, force)


def emit_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object on each line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def emit_lines(df: DataFrame, column: str, path: str) -> None:
    """One column as text, a row a line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def emit_arrays(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Files that are one JSON array each, of about ``rows`` rows, dealt by their hash; nulls written out."""
    files = F.lit(max(1, -(-df.count() // rows)))
    dealt = df.select(F.struct("*").alias("__row")).withColumn("file", F.pmod(F.xxhash64("__row"), files))
    arrays = dealt.groupBy("file").agg(F.to_json(F.collect_list("__row"), {"ignoreNullFields": "false"}).alias("value"))
    arrays.write.mode("overwrite").partitionBy("file").text(path)


def scratch(spark: SparkSession) -> str:
    """A new folder's path for files that are read again: in the shared folder of ``spark.checkpoint.dir``, or a local
    one where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="isochron-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of a new folder, for what is read several times over."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_keys(df: DataFrame, natural: list[str], name: str = "id") -> DataFrame:
    """Surrogate keys 1, 2, ... in the order of the natural key: the same for the same rows on every load.

    For dimensions: the numbering is one ordered window.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*natural)))


def resolve(df: DataFrame, dimension: DataFrame, on: dict[str, str], key: str, name: str) -> DataFrame:
    """Replace a natural key by a dimension's surrogate; rows without a match keep a null key."""
    named = dimension.select(*[F.col(v).alias(f"__{v}") for v in on.values()], F.col(key).alias(name))
    condition = None
    for left, right in on.items():
        part = F.col(left) == F.col(f"__{right}")
        condition = part if condition is None else condition & part
    return df.join(named, condition, "left").drop(*[f"__{v}" for v in on.values()])


def health(spark: SparkSession, tables: list[str]) -> dict[str, object]:
    """ok if a query runs and each table is in the catalogue, else degraded and what is missing."""
    try:
        spark.sql("SELECT 1").collect()
        missing = [t for t in tables if not spark.catalog.tableExists(t)]
    except Exception as e:
        return {"status": "degraded", "missing": tables, "error": str(e)[:200]}
    return {"status": "degraded" if missing else "ok", "missing": missing, "error": None}
