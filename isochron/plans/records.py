"""Queries of what surrounds the lookups: packages and pages read, tables changed under rules, requests refused, streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.functions import text
from isochron.operators import integrity, parsers, tariff
from isochron.plans import lookups
from isochron.sources import documents, pages
from isochron.sources.tables import health, read_table, schemas, scratch
from isochron.sources.versions import Outdated, Refused, Rules, VersionedTable
from isochron.streaming import ingest, priors

#: Suppliers of one file, and of one page of it.
_FILE, _PAGE = 100, 20


def _save_binary(rows: DataFrame, make, path: str) -> None:
    """Write what ``make`` gives for each row (file, lines) as a file of its own: the text sink takes any bytes, and ends
    each file with a newline that readers of packages and pages skip."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [make(lines) for lines in b["lines"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], pa.array(bodies, pa.binary()).cast(pa.string(), safe=False)], names=["file", "value"])

    rows.mapInArrow(built, "file bigint, value string").write.partitionBy("file").text(path)


def _file_of(path: str):
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("bigint").alias("file")


def _docx(lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{x[: len(x) // 2]}</w:t></w:r><w:r><w:t>{x[len(x) // 2 :]}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def package_paragraphs(spark, d):
    """Paragraphs of word-processor packages, one package for each hundred suppliers."""
    s = read_table(spark, d, "supplier")
    said = F.concat(F.lit("Điều "), F.col("s_suppkey").cast("string"), F.lit(". "), "s_name", F.lit(" &amp; con"))
    made = s.groupBy(F.expr(f"s_suppkey div {_FILE}").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", said.alias("x")))), lambda r: r["x"]).alias("lines"))
    path = scratch(spark)
    _save_binary(made, _docx, path)
    return documents.read_paragraphs(spark, f"{path}/*/*.txt").select(_file_of("path"), F.col("pos").cast("bigint").alias("pos"), "line")


def _pdf(lines: list[dict]) -> bytes:
    """Lines (page, y, size, text) as a file of pages; texts are plain ASCII."""
    numbers = sorted({x["page"] for x in lines})
    content = {n: " ".join(f"BT /F1 {x['size']:g} Tf 72 {x['y']:g} Td ({x['text']}) Tj ET" for x in lines if x["page"] == n) for n in numbers}
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(numbers)))}] >>", f"<< /Type /Font /Subtype /Type1 /BaseFont /Times /FirstChar 32 /Widths [{'500 ' * 95}] >>"]
    for i, n in enumerate(numbers):
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(content[n])} >>\nstream\n{content[n]}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{i + 1} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects)) + "trailer << /Root 1 0 R >>\n%%EOF").encode()


def pdf_body_lines(spark, d):
    """Body lines of PDF pages: smaller lines within the body stay, footnotes and the numbers that refer to them go."""
    k, at = F.col("s_suppkey"), F.col("s_suppkey") % _PAGE
    page = F.expr(f"s_suppkey div {_PAGE}").cast("int").alias("page")
    line = lambda y, size, said: F.struct(k.alias("k"), page, y.cast("double").alias("y"), F.lit(float(size)).alias("size"), said.alias("text"))
    top = 800 - at * 32
    name = F.concat(F.lit("Line "), k.cast("string"), F.lit(" "), "s_name")
    every = F.array_compact(F.array(
        F.when(k % 3 == 0, line(top, 12, F.concat(F.lit("amended "), k.cast("string")))), line(top - 16, 14, name), F.when(k % 4 == 0, line(top - 9, 8, F.lit("40"))), F.when(at == 0, line(F.lit(60), 12, F.lit("foot note of the page"))),
    ))
    s = read_table(spark, d, "supplier").select(F.expr(f"s_suppkey div {_FILE}").alias("file"), F.explode(every).alias("l"))
    path = scratch(spark)
    _save_binary(s.groupBy("file").agg(F.array_sort(F.collect_list("l")).alias("lines")), _pdf, path)
    found = pages.read_pdf_lines(spark, f"{path}/*/*.txt")
    return found.select(_file_of("path"), F.col("page").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("pos"), "line")


def catalogue_health(spark, d):
    """Which tables the catalogue has, and how many rows each; one is missing on purpose."""
    names = ("orders", "customer", "events", "documents")
    for n in names:
        read_table(spark, d, n).createOrReplaceTempView(f"health_{n}")
    told = health(spark, [f"health_{n}" for n in (*names, "absent")])
    out = spark.createDataFrame([("absent", "missing" if "health_absent" in told["missing"] else "there", 0)], "name string, state string, n bigint")
    for n in names:
        state = "missing" if f"health_{n}" in told["missing"] else "there"
        out = out.unionByName(spark.table(f"health_{n}").agg(F.lit(n).alias("name"), F.lit(state).alias("state"), F.count(F.lit(1)).alias("n")))
    return out.withColumn("status", F.lit(told["status"]))


_GUARDED = "id bigint, hs_code string, annex_id int, rate_type string, rate_percent decimal(7,4), amount decimal(14,2), amount_currency string, amount_unit string, out_of_quota_annex_id int, effective_from date, effective_to date, superseded_at timestamp"


def guarded_load(spark, d):
    """Changes of a rate table one after the other: accepted ones make a version, others are refused and leave the last one.

    Customers are codes with a rate for each of two years; every second gets a third.
    """
    k = F.col("c_custkey")
    year = lambda i: F.make_date(F.lit(1990 + i), F.lit(1), F.lit(1))
    row = lambda i, start, end, percent="10": F.struct((k * 10 + i).alias("id"), F.lpad(k.cast("string"), 8, "0").alias("hs_code"), F.lit(2).alias("annex_id"), F.lit("ad_valorem").alias("rate_type"), F.lit(percent).cast("decimal(7,4)").alias("rate_percent"), *[F.lit(None).cast(t).alias(n) for n, t in (("amount", "decimal(14,2)"), ("amount_currency", "string"), ("amount_unit", "string"), ("out_of_quota_annex_id", "int"))], start.alias("effective_from"), end.alias("effective_to"), F.lit(None).cast("timestamp").alias("superseded_at"))
    c = read_table(spark, d, "customer")
    full = lambda i: row(i, year(i), F.date_sub(year(i + 1), 1))
    rows = lambda df, *made: df.select(F.explode(F.array(*made)).alias("r")).select("r.*")
    table = VersionedTable(spark, scratch(spark), T.StructType.fromDDL(_GUARDED), lambda: F.pmod(F.col("hs_code").cast("int"), F.lit(8)), Rules("id", integrity.rate_rules, (["hs_code", "annex_id"], "effective_from", "effective_to"), "superseded_at"))
    first = None
    told = []

    def step(name, change):
        try:
            change()
            outcome, broken = "accepted", ""
        except Refused as e:
            outcome, broken = "refused", str(e)
        except Outdated:
            outcome, broken = "outdated", ""
        now = table.read().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("superseded_at").isNull()).alias("live")).first()
        told.append((name, outcome, broken, table.current().number, now["n"], now["live"]))

    step("load", lambda: table.append(rows(c, full(0), full(1))))
    first = table.current()
    step("append", lambda: table.append(rows(c.where(k % 2 == 0), full(2))))
    step("overlap", lambda: table.append(rows(c.where(k % 5 == 0), row(5, F.lit("1990-06-01").cast("date"), F.lit("1990-06-30").cast("date")))))
    step("second writer", lambda: table.append(rows(c.where(k % 7 == 0), full(6)), first))
    step("supersede", lambda: table.supersede(c.where(k % 3 == 0).select((k * 10).alias("id"))))
    step("rate changed", lambda: table.replace(table.read().withColumn("rate_percent", F.when(F.col("id") % 10 == 1, F.lit(11)).otherwise(F.col("rate_percent")).cast("decimal(7,4)"))))
    step("deleted", lambda: table.replace(table.read().where(F.col("id") % 10 != 1)))
    return spark.createDataFrame(told, "step string, outcome string, broken string, version bigint, n bigint, live bigint")


def lookup_outcomes(spark, d):
    """Requests as people send them: refused for their code or their day, without a rate, or found with how many."""
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    code = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    asked = o.groupBy("o_orderkey").agg(F.max("o_custkey").alias("o_custkey")).select(
        "o_orderkey", F.when(k % 10 == 0, F.lit("12")).when(k % 10 == 1, text.dotted_code(code)).when(k % 10 == 2, F.concat(F.lit(" "), code)).when(k % 10 == 3, F.lit(None)).otherwise(code).alias("hs"),
        F.when(k % 7 == 0, F.lit("1998-02-30")).when(k % 7 == 1, F.lit("17.6.1998")).when(k % 7 == 2, F.lit("1901-01-01")).otherwise(lookups.DAY).alias("day"), F.lit(" cn").alias("origin"),
    )
    done = tariff.request_outcomes(asked, lookups.frame(spark, d, "rate"), "o_orderkey")
    return done.select("o_orderkey", "outcome", "n_rates", "from_origin")


def answer_order(spark, d):
    """Rates in force of each code in the order of an answer: import before export, then by schedule."""
    return tariff.ordered_rates(tariff.rates_in_force(*lookups._facts(spark, d), lookups.DAY)).select("hs_code", "trade_direction", "schedule", F.col("effective_from").cast("string").alias("effective_from"), F.col("place").cast("bigint").alias("place"))


def search_messages(spark, d):
    """The chat's answers to searches by brand: the first eight goods and how many are left."""
    goods = read_table(spark, d, "part").select(F.col("p_brand").alias("keyword"), F.col("p_partkey").alias("place"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("hs_code"), F.concat_ws(" › ", "p_type", "p_brand", "p_name").alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).cast("decimal(7,4)").alias("mfn"))
    return tariff.candidate_messages(goods, "keyword", "place")


def quoted_citations(spark, d):
    """The first three citations of each answer, quoted: articles are groups of four documents."""
    docs = read_table(spark, d, "documents").select(F.expr("doc_id div 10").alias("answer"), "doc_id", F.concat(F.lit("Điều "), F.col("doc_id").cast("string")).alias("label"), F.substring("text", 1, 900).alias("body"), F.when(F.col("doc_id") % 2 == 0, "con_hieu_luc").otherwise("het_hieu_luc").alias("effectiveness"), F.when(F.col("doc_id") % 3 == 0, F.lit("2020-01-01").cast("date")).alias("effective_from"), F.when(F.col("doc_id") % 6 == 0, F.lit("2021-01-01").cast("date")).alias("effective_to"))
    return tariff.quoted(docs, "answer", "doc_id").select("answer", F.md5("quotes").alias("quotes_md5"))


def typed_chunks(spark, d):
    """Chunks in the table's own types: vectors and words as arrays, counted by language with their sizes."""
    docs = read_table(spark, d, "documents").join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    kinds = schemas()["legal_chunk"]
    made = docs.select("lang", F.col("embedding").cast(kinds["embedding"].dataType).alias("embedding"), text.word_list(F.col("text")).cast(kinds["tokens"].dataType).alias("tokens"))
    return made.groupBy("lang", F.typeof("embedding").alias("vector_type"), F.typeof("tokens").alias("words_type")).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_vectors"), F.sum(F.size("tokens")).alias("n_words"))


def _arriving(df: DataFrame, folder: str, column: str, last: DataFrame | None = None, cuts: int = 3) -> Iterator[DataFrame]:
    """A stream of ``df`` each time that one of about equal stretches of ``column`` has come, the least first, ``last`` with
    the last of them. A run finds its files new, and they are one batch; all tasks write and read them."""
    spark = df.sparkSession
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    span = (hi - lo) / cuts
    for i in range(cuts):
        from_, to = lo + span * i, lo + span * (i + 1)
        part = df.where((F.col(column) >= F.lit(from_)) & ((F.col(column) < F.lit(to)) | F.lit(i == cuts - 1)))
        (part if last is None or i < cuts - 1 else part.unionByName(last)).write.parquet(f"{folder}/{i}")
        yield spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(folder)


@contextmanager
def _state_on_disk(spark) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, whose rows aren't counted."""
    settings = (priors.STATE_STORE, priors.UNCOUNTED)
    before = {name: spark.conf.get(name, None) for name, _ in settings}
    for setting in settings:
        spark.conf.set(*setting)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def streamed_priors(spark, d):
    """The last lookup before each event, from a stream, in event order; a last row moves the watermark behind all others."""
    folder = scratch(spark)
    log = read_table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("lookup"))
    end = spark.createDataFrame([(-1, -1, "2200-01-01", None)], "event_id bigint, user_id bigint, ts string, lookup bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    with _state_on_disk(spark):
        for stream in _arriving(log, f"{folder}/in", "ts", end):
            told = priors.streaming_priors(stream, "user_id", "ts", "event_id", "lookup", "1 hour", 24 * 3600)
            told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, event_id bigint, ts timestamp, prior bigint").parquet(f"{folder}/out").select("event_id", "user_id", "prior")


def streamed_log(spark, d):
    """Verdicts of chat messages that a stream writes, read twice from one checkpoint: each counts once, rejected ones apart."""
    folder = scratch(spark)
    e, i = read_table(spark, d, "events"), F.col("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x in ("đúng rồi", "sai, phải là 0202.30.00", "cảm ơn", "không chắc", "nhầm rồi")]), (i % 5 + 1).cast("int"))
    messages = e.select(
        i.alias("message_id"), F.col("ts").cast("timestamp").alias("at"), F.when(i % 7 == 0, "bot").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("sender"), F.lit("t").alias("thread"), F.lit(False).alias("is_group"), said.alias("message"),
        F.lit(None).cast("array<struct<uid: string, pos: int, len: int>>").alias("mentions"), F.lit(False).alias("has_image"), F.lit("2024-06-01").alias("day"), F.when(i % 4 != 0, "01012100").alias("prior_code"), F.lit(None).cast("string").alias("prior_day"),
    )
    with _state_on_disk(spark):
        for stream in _arriving(messages.unionByName(messages.where(i % 3 == 0)), f"{folder}/in", "at"):
            for _ in range(2):
                ingest.ingest(stream, f"{folder}/log", f"{folder}/state", "message_id", "at", lambda b: ingest.chat_log(b, "bot"), "2 days").awaitTermination()
    kinds = [ingest.read_log(spark, f"{folder}/log", o).withColumn("outcome", F.lit(o)) for o in ("accepted", "rejected")]
    return kinds[0].unionByName(kinds[1]).groupBy("outcome", "problem", "verdict", "next_code", "note").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("n_messages"))


def unrooted_nodes(spark, d):
    """Customers under nations whose regions are missing, and two nations that stand above each other: nodes without a root."""
    n = read_table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.when(F.col("n_nationkey") < 2, F.concat(F.lit("n"), (1 - F.col("n_nationkey")).cast("string"))).when(F.col("n_nationkey") % 3 == 0, F.lit("gone")).alias("parent_key"))
    c = read_table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("parent_key"))
    return parsers.unrooted(n.unionByName(c))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries, by name."""
    rate = lookups._given("rate", "schedule", "annex", "decree")
    day = lookups.DAY
    in_force = f"superseded_at IS NULL AND effective_from <= DATE '{day}' AND (effective_to IS NULL OR effective_to >= DATE '{day}')"
    tail = "p_brand || ' › ' || p_name"
    dotted = "substr(hs, 1, 4) || '.' || substr(hs, 5, 2) || '.' || substr(hs, 7, 2)"
    return {
        "package_paragraphs": f"SELECT s_suppkey // {_FILE} AS file, row_number() OVER (PARTITION BY s_suppkey // {_FILE} ORDER BY s_suppkey) - 1 AS pos, 'Điều ' || s_suppkey || '. ' || s_name || ' & con' AS line FROM supplier",
        "pdf_body_lines": f"""WITH l AS (SELECT s_suppkey AS k, 1 AS o, 'Line ' || s_suppkey || ' ' || s_name AS line FROM supplier UNION ALL SELECT s_suppkey, 0, 'amended ' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
            SELECT k // {_FILE} AS file, dense_rank() OVER (PARTITION BY k // {_FILE} ORDER BY k // {_PAGE}) - 1 AS page, row_number() OVER (PARTITION BY k // {_PAGE} ORDER BY k, o) - 1 AS pos, line FROM l""",
        "catalogue_health": "SELECT *, 'degraded' AS status FROM (SELECT 'absent' AS name, 'missing' AS state, 0 AS n UNION ALL SELECT 'orders', 'there', count(*) FROM orders UNION ALL SELECT 'customer', 'there', count(*) FROM customer UNION ALL SELECT 'events', 'there', count(*) FROM events UNION ALL SELECT 'documents', 'there', count(*) FROM documents) z",
        "guarded_load": """WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE c_custkey % 2 = 0) AS b, count(*) FILTER (WHERE c_custkey % 3 = 0) AS g, count(*) FILTER (WHERE c_custkey % 5 = 0) AS o FROM customer)
            SELECT step, outcome, broken, version, n, live FROM (
              SELECT 'load' AS step, 'accepted' AS outcome, '' AS broken, 1 AS version, 2 * a AS n, 2 * a AS live FROM c UNION ALL SELECT 'append', 'accepted', '', 2, 2 * a + b, 2 * a + b FROM c
              UNION ALL SELECT 'overlap', 'refused', 'overlap: ' || o, 2, 2 * a + b, 2 * a + b FROM c UNION ALL SELECT 'second writer', 'outdated', '', 2, 2 * a + b, 2 * a + b FROM c
              UNION ALL SELECT 'supersede', 'accepted', '', 3, 2 * a + b, 2 * a + b - g FROM c UNION ALL SELECT 'rate changed', 'refused', 'changed: ' || a, 3, 2 * a + b, 2 * a + b - g FROM c
              UNION ALL SELECT 'deleted', 'refused', 'deleted: ' || a, 3, 2 * a + b, 2 * a + b - g FROM c) z""",
        "lookup_outcomes": f"""{lookups._given("rate")}, r AS (SELECT hs_code, count(*) AS n FROM rate WHERE {in_force} GROUP BY 1), a AS (SELECT o_orderkey, lpad(CAST(max(o_custkey) AS VARCHAR), 8, '0') AS code FROM orders GROUP BY 1)
            SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 3) THEN 'hs' WHEN o_orderkey % 7 IN (0, 1) THEN 'date' WHEN o_orderkey % 7 = 2 OR n IS NULL THEN 'not_found' ELSE 'found' END AS outcome,
              CASE WHEN o_orderkey % 10 NOT IN (0, 3) AND o_orderkey % 7 > 2 THEN coalesce(n, 0) ELSE 0 END AS n_rates, 'CN' AS from_origin FROM a LEFT JOIN r ON hs_code = code""",
        "answer_order": f"""{rate} SELECT hs_code, trade_direction, s.code AS schedule, CAST(effective_from AS VARCHAR) AS effective_from, row_number() OVER (PARTITION BY hs_code ORDER BY CASE trade_direction WHEN 'import' THEN 0 ELSE 1 END, s.code, r.id) AS place
            FROM rate r JOIN schedule s ON schedule_id = s.id JOIN annex a ON annex_id = a.id JOIN decree d ON source_decree_id = d.id WHERE {in_force}""",
        "search_messages": f"""WITH g AS (SELECT p_brand AS keyword, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS hs, CASE WHEN p_partkey % 3 = 0 THEN p_size || '%' ELSE '—' END AS mfn, {tail} AS tail, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
            SELECT keyword, max(n) AS n, '🔎 "' || keyword || '" — ' || max(n) || ' mã phù hợp. Nhắn MÃ kèm xuất xứ để xem thuế đầy đủ:' || chr(10) || string_agg('• ' || {dotted} || '  ·  MFN ' || mfn || '  ·  ' || tail, chr(10) ORDER BY rn)
              || CASE WHEN max(n) > 8 THEN chr(10) || '…và ' || (max(n) - 8) || ' mã nữa — gõ cụ thể hơn để thu hẹp.' ELSE '' END || chr(10) || 'Ví dụ: "' || min_by({dotted}, rn) || ' TQ".' AS message FROM g WHERE rn <= 8 GROUP BY keyword""",
        "quoted_citations": """WITH q AS (SELECT doc_id, doc_id // 10 AS answer, trim(regexp_replace(substr(text, 1, 900), '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rn FROM documents)
            SELECT answer, md5(string_agg('📖 Điều ' || doc_id || CASE WHEN doc_id % 2 = 1 THEN ' ⚠️ het_hieu_luc' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN ' · hiệu lực từ 2020-01-01→2021-01-01' WHEN doc_id % 3 = 0 THEN ' · hiệu lực từ 2020-01-01' ELSE '' END
              || chr(10) || '“' || CASE WHEN length(t) > 480 THEN substr(t, 1, 480) || '…' ELSE t END || '”', chr(10) ORDER BY rn)) AS quotes_md5 FROM q WHERE rn <= 3 GROUP BY answer""",
        "typed_chunks": """SELECT lang, 'array<float>' AS vector_type, 'array<string>' AS words_type, count(*) AS n, count(vec_id) AS n_vectors,
            CAST(sum(len(list_filter(string_split_regex(regexp_replace(nfc_normalize(lower(coalesce(text, ''))), '[^\\p{L}\\p{M}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang""",
        "streamed_priors": """SELECT event_id, user_id, CASE WHEN epoch_us(ts) - epoch_us(at_ts) <= 86400000000 THEN prior END AS prior FROM (
            SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS prior, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS at_ts
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) z""",
        "streamed_log": """WITH m AS (SELECT DISTINCT event_id AS i, event_id % 5 AS s, event_id % 4 <> 0 AS known FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 2)
            SELECT outcome, problem, verdict, next_code, note, count(*) AS n, count(*) AS n_messages FROM (
              SELECT CASE WHEN known THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN NOT known THEN 'hs' END AS problem, CASE s WHEN 0 THEN 'correct' WHEN 3 THEN 'unsure' ELSE 'wrong' END AS verdict,
                CASE WHEN s = 1 THEN '02023000' END AS next_code, ['đúng rồi', 'sai, phải là 0202.30.00', 'cảm ơn', 'không chắc', 'nhầm rồi'][s + 1] AS note FROM m) z GROUP BY ALL""",
        "unrooted_nodes": """SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey < 2 THEN 'cycle' ELSE 'parent' END AS problem FROM nation WHERE n_nationkey < 2 OR n_nationkey % 3 = 0
            UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_nationkey < 2 THEN 'cycle' ELSE 'parent' END FROM customer WHERE c_nationkey < 2 OR c_nationkey % 3 = 0""",
    }


def queries():
    """Each query with its callable."""
    return {name: globals()[name] for name in oracle_sql()}
