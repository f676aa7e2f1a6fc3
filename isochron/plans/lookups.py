"""Queries of the flagship lookup: rates by code, day and origin with their wording, duties, notes, and what follows them.

Input tables are told in SQL that Spark and DuckDB read alike (``TABLES``), so that both sides start from the same rows:
customers are codes, order priorities schedules, order dates starts of rates, parts goods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.operators import events, parsers, retrieval, tariff
from isochron.operators.temporal import live, valid_at
from isochron.sources.tables import read_table

DAY, ORIGIN, CODE = "1998-06-17", "CN", "0000.0007"
_HS = "lpad(CAST({0} AS STRING), 8, '0')"
#: Input tables, each a query over the driver's tables, which stand in braces.
TABLES = {
    "rate": f"""SELECT k * 10 + sid AS id, {_HS.format('k')} AS hs_code, sid AS schedule_id, CASE WHEN sid = 5 AND k % 3 = 0 THEN 2 ELSE 1 END AS annex_id,
            CAST(k % 3 + 1 AS INT) AS source_decree_id, CASE (k + sid) % 5 WHEN 0 THEN 'ad_valorem' WHEN 1 THEN 'specific' WHEN 2 THEN 'compound' WHEN 3 THEN 'excluded' ELSE 'trq' END AS rate_type,
            CAST((k % 40) * 0.25 AS DECIMAL(7, 4)) AS rate_percent, CAST(1000 + k AS DECIMAL(14, 2)) AS amount, 'USD' AS amount_currency, 'pc' AS amount_unit,
            f AS effective_from, CAST(lead(f) OVER (PARTITION BY k, sid ORDER BY f) - INTERVAL '1' DAY AS DATE) AS effective_to, CAST(NULL AS STRING) AS conditions,
            CASE WHEN k % 9 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS superseded_at
        FROM (SELECT DISTINCT o_custkey AS k, CAST(substr(o_orderpriority, 1, 1) AS INT) AS sid, CAST(o_orderdate AS DATE) AS f FROM {{orders}}) AS z""",
    "schedule": "SELECT * FROM (VALUES (1, 'NK_uu_dai', 'MFN', CAST(NULL AS STRING), false), (2, 'NK_ngoai_han_ngach', 'Beyond quota', NULL, false), (3, 'NK_uu_dai_98', 'Special', NULL, false), (4, 'FTA_A', 'First', 'E', true), (5, 'FTA_B', 'Second', NULL, true)) AS s(id, code, name, fta_form, requires_co)",
    "annex": "SELECT * FROM (VALUES (1, 'II', 'import'), (2, 'I', 'export')) AS a(id, code, trade_direction)",
    "decree": "SELECT * FROM (VALUES (1, '26/ND'), (2, '115/ND'), (3, '118/ND')) AS d(id, number)",
    "duty": f"""SELECT {_HS.format('c_custkey')} AS hs_code, CASE c_nationkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'KR' ELSE 'JP' END AS origin_country, c_name AS exporter, concat('QD', CAST(c_nationkey AS STRING)) AS decision_number,
            CASE WHEN c_custkey % 2 = 0 THEN 'percent' ELSE 'absolute' END AS duty_kind, CAST(c_custkey % 30 AS DECIMAL(7, 4)) AS rate_percent, CAST(c_custkey AS DECIMAL(14, 2)) AS amount, 'USD' AS amount_currency, 't' AS amount_unit,
            DATE '1997-01-01' AS effective_from, CASE WHEN c_custkey % 5 = 0 THEN DATE '1998-01-01' END AS effective_to, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS superseded_at
        FROM {{customer}}""",
    "goods": f"SELECT {_HS.format('p_partkey')} AS hs_code, p_name AS heading, concat(p_type, ' › ', p_brand, ' › ', p_name) AS path FROM {{part}}",
}


def frame(spark: SparkSession, d: str, name: str) -> DataFrame:
    """An input table of ``TABLES``."""
    used = [t for t in ("orders", "customer", "part") if "{" + t + "}" in TABLES[name]]
    return spark.sql(TABLES[name], **{t: read_table(spark, d, t) for t in used})


def _given(*names: str) -> str:
    plain = {t: t for t in ("orders", "customer", "part")}
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**plain)})" for n in names)


def _facts(spark, d):
    return [frame(spark, d, n) for n in ("rate", "schedule", "annex", "decree")]


def rates_star(spark, d):
    """Live rates of all codes on a day with their schedule, annex, decree and wording."""
    found = tariff.rates_in_force(*_facts(spark, d), DAY)
    return found.select("hs_code", "schedule", "annex", "trade_direction", "decree", "requires_co", "statement", F.col("__direction").cast("bigint").alias("direction"), F.col("effective_from").cast("string").alias("effective_from"))


def _flat(found: DataFrame) -> DataFrame:
    worded = lambda column: F.array_join(F.transform(column, lambda x: x["statement"]), "|")
    return found.select(
        "hs_code", "origin", "day", F.col("goods.heading").alias("heading"), F.col("import.mfn.statement").alias("mfn"), F.col("import.mfn.decree").alias("mfn_decree"), F.col("import.out_of_quota.statement").alias("out_of_quota"),
        worded("import.chapter98").alias("chapter98"), worded("import.preferential").alias("preferential"), F.col("export.statement").alias("export"), worded("anti_dumping").alias("duties"), F.array_join("notes", "|").alias("notes"),
    )


def tariff_answers(spark, d):
    """The nested answer of every code on a day for one origin, its wording laid flat."""
    in_force = tariff.rates_in_force(*_facts(spark, d), DAY)
    return _flat(tariff.answers(in_force, frame(spark, d, "goods"), frame(spark, d, "duty"), ORIGIN, DAY))


def tariff_lookup(spark, d):
    """The answer for one code, looked up by its dotted form and an origin in lower case; without one it would raise."""
    return _flat(tariff.lookup(*_facts(spark, d), frame(spark, d, "goods"), frame(spark, d, "duty"), CODE, DAY, " cn "))


def anti_dumping_duties(spark, d):
    """Live duties of one origin, and of all origins, on a day."""
    duty = frame(spark, d, "duty")
    both = tariff.anti_dumping(duty, DAY, ORIGIN).withColumn("asked", F.lit(ORIGIN)).unionByName(tariff.anti_dumping(duty, DAY).withColumn("asked", F.lit("any")))
    return both.select("asked", "hs_code", "origin_country", "exporter", "statement")


def mfn_now(spark, d):
    """The MFN percent of each code in force today."""
    return tariff.current_mfn(frame(spark, d, "rate"), frame(spark, d, "schedule"), None).select("hs_code", F.col("mfn").cast("double").alias("mfn"))


def live_rates(spark, d):
    """Rates that nothing has replaced, counted by schedule, with those in force today."""
    r = frame(spark, d, "rate").where(live())
    return r.groupBy("schedule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid_at(None)).alias("n_today"))


def tally_percent(spark, d):
    """Declared against loaded rates by schedule, with the share of matches: an order's code against the first rate of its schedule."""
    r = frame(spark, d, "rate").where(live() & valid_at(DAY)).select("hs_code", "schedule_id", F.col("rate_percent").cast("double").alias("loaded"))
    o = read_table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("hs_code"), F.substring("o_orderpriority", 1, 1).cast("int").alias("schedule_id"), ((F.col("o_custkey") % 40) * 0.25 + F.when(F.col("o_orderkey") % 3 == 0, 0.01).otherwise(0.0)).alias("declared"))
    done = tariff.tally(o.join(r, ["hs_code", "schedule_id"], "left"), "schedule_id", F.col("declared"), F.col("loaded"))
    return done.select("schedule_id", "matched", "mismatched", "not_loaded", "percent")


def candidate_lines(spark, d):
    """Search results as lines of a message."""
    goods = frame(spark, d, "goods")
    mfn = tariff.current_mfn(frame(spark, d, "rate"), frame(spark, d, "schedule"), DAY)
    return goods.join(mfn, "hs_code", "left").select("hs_code", tariff.candidate_line(F.col("hs_code"), F.col("mfn"), F.col("path")).alias("line"))


def word_fallback(spark, d):
    """Each nation asks for a phrase; where no good has it, for its words one after the other."""
    asked = read_table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(x) for x in ("small ring", "ring small", "nothing bolt", "none at all", "red")]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("phrase"))
    tries = asked.select("phrase").distinct().select("phrase", F.posexplode(F.concat(F.array("phrase"), F.when(F.col("phrase").contains(" "), F.split("phrase", " ")).otherwise(F.array().cast("array<string>")))).alias("tried", "words"))
    goods = read_table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("named"))
    # Phrases are found by their first word, an equal key, and then held against the words behind it.
    places = goods.select("p_partkey", "named", F.posexplode("named").alias("at", "word"))
    wanted = tries.withColumn("list", F.split("words", " "))
    hits = places.join(wanted, F.col("word") == F.element_at("list", 1)).where(F.slice("named", F.col("at") + 1, F.size("list")) == F.col("list"))
    found = events.first_finding(hits.select("phrase", "tried", "p_partkey").distinct(), "phrase", "tried")
    return asked.join(found, "phrase").select("n_nationkey", "phrase", F.col("tried").cast("bigint").alias("tried"), "p_partkey")


def rehydrated(spark, d):
    """Fused articles with their texts and validity: the article's own goes before its document's."""
    part = read_table(spark, d, "part")
    provision = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("document_id"), F.concat(F.lit("Art "), F.col("p_partkey").cast("string")).alias("citation_label"), F.col("p_type").alias("path"), F.col("p_name").alias("body"), F.when(F.col("p_size") > 25, "own").alias("effectiveness"), F.when(F.col("p_size") % 2 == 0, F.lit("2001-01-01").cast("date")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    document = spark.range(7).select("id", F.concat(F.lit("N"), F.col("id").cast("string")).alias("number"), F.lit("t").alias("title"), F.lit("u").alias("source_url"), F.lit("doc").alias("effectiveness"), F.lit("1999-01-01").cast("date").alias("effective_from"), F.when(F.col("id") == 3, F.lit("2002-02-02").cast("date")).alias("effective_to"))
    fused = part.where(F.col("p_partkey") % 3 == 0).select(F.col("p_partkey").alias("aid"), (F.col("p_partkey") - 1).alias("best_pid"), F.lit(1.0).alias("score"))
    done = retrieval.hydrate(fused, provision, document)
    return done.select("aid", "article_citation", "clause_citation", "clause_body", "document_number", "effectiveness", "effective_from", "effective_to")


def chunk_keys(spark, d):
    """Chunks of parts with the ids of provision, article and document; every eleventh provision is missing."""
    part = read_table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    made = part.select(F.concat(F.lit("p"), "k").alias("provision_key"), F.concat(F.lit("p"), (F.col("p_partkey") - 1).cast("string")).alias("article_key"), F.concat(F.lit("d"), (F.col("p_partkey") % 7).cast("string")).alias("document_number"), F.col("p_name").alias("embed_text"))
    provision = part.where(F.col("p_partkey") % 11 != 0).select((F.col("p_partkey") * 100).alias("id"), F.concat(F.lit("p"), "k").alias("key"))
    document = spark.range(7).select((F.col("id") + 1000).alias("id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("number"))
    return parsers.chunk_rows(made, provision, document).select("provision_id", "article_provision_id", "document_id", F.array_join("tokens", " ").alias("tokens"))


def code_forms(spark, d):
    """Codes, paths and markup through the column functions."""
    part = read_table(spark, d, "part")
    code = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    dotted = text.dotted_code(code)
    path = F.concat_ws(" › ", "p_type", "p_brand", "p_name")
    spaced = F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t\n "), F.col("p_brand"), F.lit(" "))
    marked = F.concat(F.lit("<a & '"), F.col("p_name"), F.lit("\">"))
    named = F.concat(F.lit("- - "), F.col("p_name"), F.lit(":"))
    return part.select(
        "p_partkey", dotted.alias("dotted"), text.bare_code(F.concat(F.lit(" "), dotted)).alias("bare"), text.digits(F.col("p_brand")).alias("digits"), text.upper_or_null(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lit("  "))).alias("upper"),
        text.last_cell(F.concat_ws(" | ", "p_type", "p_name")).alias("last_cell"), text.dash_depth(named).cast("bigint").alias("depth"), text.undashed(named).alias("undashed"), text.path_tail(path).alias("tail"), text.collapse(spaced).alias("collapsed"),
        text.ellipsis(F.col("p_type"), 9).alias("short"), text.escape_html(marked).alias("escaped"), (text.unescape_html(text.escape_html(marked)) == marked).alias("restored"),
        text.first_object(F.concat(F.lit("so: {\"a\": {\"b\": "), F.col("p_size").cast("string"), F.lit("}} end"))).alias("object"),
    )


def vector_literals(spark, d):
    """Vectors as a database's literals and back, and the first eight values for show."""
    v = read_table(spark, d, "embeddings")
    back = text.parse_vector(text.vector_literal(F.col("embedding")))
    return v.select("vec_id", (back == F.col("embedding").cast("array<float>")).alias("same"), F.size(back).cast("bigint").alias("n"), F.size(F.slice("embedding", 1, 8)).cast("bigint").alias("shown"), F.element_at(back, 1).cast("double").alias("first"))


_SHOW = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '\\.$', '')"
_PCT, _MONEY = _SHOW.format("rate_percent") + " || '%'", "CAST(amount AS VARCHAR) || ' ' || amount_currency || '/' || amount_unit"
_STATED = f"""CASE rate_type WHEN 'ad_valorem' THEN {_PCT} WHEN 'specific' THEN {_MONEY} WHEN 'compound' THEN {_PCT} || ' + ' || {_MONEY}
      WHEN 'excluded' THEN '{tariff.EXCLUDED_TEXT}' ELSE 'Trong hạn ngạch ' || {_PCT} || '; ngoài hạn ngạch xem biểu ngoài hạn ngạch' END"""
_ON = f"superseded_at IS NULL AND effective_from <= DATE '{DAY}' AND (effective_to IS NULL OR effective_to >= DATE '{DAY}')"
_STAR = f"""star AS (SELECT r.*, s.code AS schedule, s.fta_form, s.requires_co, a.code AS annex, a.trade_direction, d.number AS decree, {_STATED} AS statement
      FROM rate r JOIN schedule s ON s.id = schedule_id JOIN annex a ON a.id = annex_id JOIN decree d ON d.id = source_decree_id WHERE {_ON})"""
_DUTY = f"SELECT *, 'Chống bán phá giá ' || CASE WHEN duty_kind = 'percent' THEN {_PCT} ELSE {_MONEY} END || ' (cộng thêm thuế NK), xuất xứ ' || origin_country AS statement FROM duty WHERE {_ON}"
_WORDED = "CASE WHEN requires_co THEN statement || ' nếu có C/O' || coalesce(' form ' || fta_form, '') || ' hợp lệ, ngược lại ' || coalesce(mfn || ' (MFN)', 'mức MFN') ELSE statement END"
_ANSWERS = f"""{_STAR}, dump AS ({_DUTY}),
    one AS (SELECT hs_code, max(statement) FILTER (WHERE i AND schedule = '{tariff.MFN}') AS mfn, max(decree) FILTER (WHERE i AND schedule = '{tariff.MFN}') AS mfn_decree, max(rate_type) FILTER (WHERE i AND schedule = '{tariff.MFN}') AS kind,
              max(statement) FILTER (WHERE i AND schedule = '{tariff.OUT_OF_QUOTA}') AS out_of_quota, max(statement) FILTER (WHERE NOT i) AS export FROM (SELECT *, trade_direction = 'import' AS i FROM star) z GROUP BY hs_code),
    pref AS (SELECT hs_code, string_agg({_WORDED}, '|' ORDER BY schedule) AS preferential FROM star JOIN one USING (hs_code) WHERE trade_direction = 'import' AND schedule LIKE 'FTA%' GROUP BY 1),
    spec AS (SELECT hs_code, string_agg({_WORDED}, '|' ORDER BY schedule) AS chapter98 FROM star JOIN one USING (hs_code) WHERE trade_direction = 'import' AND schedule = '{tariff.SPECIAL}' GROUP BY 1),
    dd AS (SELECT hs_code, string_agg(statement, '|' ORDER BY exporter) AS duties FROM dump WHERE origin_country = '{ORIGIN}' GROUP BY 1),
    answer AS (SELECT hs_code, '{ORIGIN}' AS origin, '{DAY}' AS day, heading, mfn, mfn_decree, out_of_quota, coalesce(chapter98, '') AS chapter98, coalesce(preferential, '') AS preferential, export, coalesce(duties, '') AS duties,
      concat_ws('|', CASE WHEN kind = 'trq' THEN '{tariff.NOTE_QUOTA}' END, CASE WHEN kind = 'excluded' THEN '{tariff.NOTE_EXCLUDED}' END, CASE WHEN chapter98 IS NOT NULL THEN '{tariff.NOTE_SPECIAL}' END,
        CASE WHEN preferential IS NOT NULL THEN '{tariff.NOTE_CERTIFICATE}' END, CASE WHEN preferential IS NULL THEN '{tariff.NOTE_NO_PREFERENCE[0]}{ORIGIN}{tariff.NOTE_NO_PREFERENCE[1]}' END) AS notes
      FROM one LEFT JOIN pref USING (hs_code) LEFT JOIN spec USING (hs_code) LEFT JOIN dd USING (hs_code) LEFT JOIN goods USING (hs_code))"""
_FACTS = ("rate", "schedule", "annex", "decree")
_CODE = _HS.format("p_partkey").replace("STRING", "VARCHAR")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries, by name."""
    return {
        "rates_star": f"{_given(*_FACTS)}, {_STAR} SELECT hs_code, schedule, annex, trade_direction, decree, requires_co, statement, CASE trade_direction WHEN 'import' THEN 0 ELSE 1 END AS direction, CAST(effective_from AS VARCHAR) AS effective_from FROM star",
        "tariff_answers": f"{_given(*_FACTS, 'duty', 'goods')}, {_ANSWERS} SELECT * FROM answer",
        "tariff_lookup": f"{_given(*_FACTS, 'duty', 'goods')}, {_ANSWERS} SELECT * FROM answer WHERE hs_code = '{CODE.replace('.', '')}'",
        "anti_dumping_duties": f"{_given('duty')}, dump AS ({_DUTY}) SELECT 'any' AS asked, hs_code, origin_country, exporter, statement FROM dump UNION ALL SELECT '{ORIGIN}', hs_code, origin_country, exporter, statement FROM dump WHERE origin_country = '{ORIGIN}'",
        "mfn_now": f"{_given('rate')} SELECT hs_code, CAST(rate_percent AS DOUBLE) AS mfn FROM rate WHERE schedule_id = 1 AND superseded_at IS NULL AND effective_from <= current_date AND (effective_to IS NULL OR effective_to >= current_date)",
        "live_rates": f"{_given('rate')} SELECT schedule_id, count(*) AS n, count(*) FILTER (WHERE effective_from <= current_date AND coalesce(effective_to >= current_date, true)) AS n_today FROM rate WHERE superseded_at IS NULL GROUP BY 1",
        "tally_percent": f"""{_given('rate')}, c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS schedule_id, o_orderkey, rate_percent IS NOT NULL AS known
              FROM orders o LEFT JOIN (SELECT * FROM rate WHERE {_ON}) r ON r.hs_code = {_HS.format('o_custkey')} AND r.schedule_id = CAST(substr(o_orderpriority, 1, 1) AS INT)),
            t AS (SELECT schedule_id, count(*) FILTER (WHERE known AND o_orderkey % 3 <> 0) AS matched, count(*) FILTER (WHERE known AND o_orderkey % 3 = 0) AS mismatched, count(*) FILTER (WHERE NOT known) AS not_loaded FROM c GROUP BY 1)
            SELECT *, round(100e0 * matched / nullif(matched + mismatched, 0), 1) AS percent FROM t""",
        "candidate_lines": f"""{_given('rate', 'goods')}, m AS (SELECT hs_code, rate_percent FROM rate WHERE schedule_id = 1 AND {_ON})
            SELECT hs_code, '• ' || substr(hs_code, 1, 4) || '.' || substr(hs_code, 5, 2) || '.' || substr(hs_code, 7, 2) || ' · MFN ' || coalesce({_PCT}, '—') || ' · ' || p_brand || ' › ' || heading AS line
            FROM goods JOIN part ON hs_code = {_CODE} LEFT JOIN m USING (hs_code)""",
        "word_fallback": """WITH a AS (SELECT n_nationkey, ['small ring', 'ring small', 'nothing bolt', 'none at all', 'red'][n_nationkey % 5 + 1] AS phrase FROM nation),
            t AS (SELECT phrase, unnest(range(len(w))) AS tried, unnest(w) AS words FROM (SELECT DISTINCT phrase, CASE WHEN phrase LIKE '% %' THEN list_prepend(phrase, string_split(phrase, ' ')) ELSE [phrase] END AS w FROM a) z),
            h AS (SELECT phrase, tried, p_partkey, min(tried) OVER (PARTITION BY phrase) AS best FROM t JOIN part ON contains(' ' || p_name || ' ', ' ' || words || ' '))
            SELECT DISTINCT n_nationkey, phrase, tried, p_partkey FROM a JOIN h USING (phrase) WHERE tried = best""",
        "rehydrated": """SELECT a.p_partkey AS aid, 'Art ' || a.p_partkey AS article_citation, 'Art ' || c.p_partkey AS clause_citation, c.p_name AS clause_body, 'N' || (a.p_partkey % 7) AS document_number,
              CASE WHEN a.p_size > 25 THEN 'own' ELSE 'doc' END AS effectiveness, CASE WHEN a.p_size % 2 = 0 THEN '2001-01-01' ELSE '1999-01-01' END AS effective_from, CASE WHEN a.p_partkey % 7 = 3 THEN '2002-02-02' END AS effective_to
            FROM part a JOIN part c ON c.p_partkey = a.p_partkey - 1 WHERE a.p_partkey % 3 = 0""",
        "chunk_keys": """SELECT CASE WHEN p.p_partkey % 11 <> 0 THEN p.p_partkey * 100 END AS provision_id, CASE WHEN a.p_partkey % 11 <> 0 THEN a.p_partkey * 100 END AS article_provision_id, 1000 + p.p_partkey % 7 AS document_id, lower(p.p_name) AS tokens
            FROM part p LEFT JOIN part a ON a.p_partkey = p.p_partkey - 1""",
        "code_forms": f"""SELECT p_partkey, substr(c, 1, 4) || '.' || substr(c, 5, 2) || '.' || substr(c, 7, 2) AS dotted, c AS bare, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, CASE WHEN p_size > 25 THEN upper(p_name) END AS upper, p_name AS last_cell, 2 AS depth,
              p_name AS undashed, p_brand || ' › ' || p_name AS tail, p_name || ' ' || p_brand AS collapsed, CASE WHEN length(p_type) > 9 THEN substr(p_type, 1, 9) || '…' ELSE p_type END AS short, '&lt;a &amp; &#39;' || p_name || '&quot;&gt;' AS escaped, true AS restored,
              '{{"a": {{"b": ' || p_size || '}}}}' AS object FROM (SELECT *, {_CODE} AS c FROM part) z""",
        "vector_literals": "SELECT vec_id, true AS same, len(embedding) AS n, 8 AS shown, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings",
    }


def queries():
    """Each query with its callable."""
    return {name: globals()[name] for name in oracle_sql()}
