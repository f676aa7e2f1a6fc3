"""Queries of the document readers and parsers, and of the chat that asks about them.

Documents are written from the rows of a table in the forms of the gazette and parsed back, so the SQL tells the rows
that have to come out without parsing anything. Parts are goods, nations documents, customers their articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.operators import events, parsers
from isochron.sources import documents as sources
from isochron.sources.tables import emit_arrays, emit_lines, emit_ndjson, load, read_json_array, read_ndjson, read_table, scratch

MARK = "\x07"


def _document(rows: DataFrame, doc: Column, order: list[str], pieces: list[Column], mark: str = MARK) -> DataFrame:
    """(part, text): the pieces of each row in order, rows one after the other; pieces that are null are left out."""
    row = F.struct(*order, F.concat_ws(mark, *pieces).alias("__piece"))
    made = rows.groupBy(doc.alias("part")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return made.select("part", F.array_join(F.transform("__rows", lambda r: r["__piece"]), mark).alias("text"))


def _part(spark, d):
    p = read_table(spark, d, "part")
    code = F.lpad((F.col("p_partkey") + 1_000_000).cast("string"), 8, "0")
    return p.withColumns({"code": code, "dotted": text.dotted_code(code), "late": F.col("p_size") > 25})


#: Goods of one document, so that the number of documents grows with the table.
_GOODS = 400


def _of_document() -> Column:
    return F.expr(f"p_partkey div {_GOODS}")


def _table_cells(spark, d) -> DataFrame:
    """Converted tariff tables: annex, code, description and a run of rates for each row; runs may be long, or begin late."""
    kind = F.col("p_partkey") % 6
    rates = F.when(kind == 0, "5").when(kind == 1, "7,5").when(kind == 2, "*").when(kind == 3, MARK.join(("5", "4", "3", "2", "1", "0"))).when(kind == 4, MARK.join(str(i) for i in range(30, 0, -1))).otherwise(MARK.join((*["word"] * 11, "8", "", "6")))
    annex = F.when(F.col("late"), "BIỂU THUẾ NHẬP KHẨU").otherwise("BIỂU THUẾ XUẤT KHẨU")
    texts = _document(_part(spark, d), _of_document(), ["late", "p_partkey"], [annex, F.col("dotted"), F.col("p_name"), F.lit(" "), rates])
    return sources.cells(texts).withColumnRenamed("pos", "ord")


def gazette_rows(spark, d):
    """Rows of the base decree: a rate is looked for among the first twelve cells."""
    rows = parsers.tariff_rows(_table_cells(spark, d), ["part"])
    return rows.select("part", "annex", "hs", "hs_dotted", "description", "rate", F.array_join("rates", " ").alias("rates"))


def agreement_rows(spark, d):
    """Rows of an agreement's table: rates may also begin right behind the first twelve cells."""
    rows = parsers.tariff_rows(_table_cells(spark, d), ["part"], late=True)
    return rows.select("part", "hs", "description", F.array_join("rates", " ").alias("rates"), F.size("rates").cast("bigint").alias("n_rates"))


def special_chapter(spark, d):
    """Rows of the special chapter; every second has a code that it corresponds to."""
    p = _part(spark, d).withColumn("special", text.dotted_code(F.concat(F.lit("98"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("dotted"))
    texts = _document(p, _of_document(), ["p_partkey"], [F.col("special"), other, F.col("p_name"), F.col("p_size").cast("string")])
    rows = parsers.special_rows(parsers.tariff_rows(sources.cells(texts).withColumnRenamed("pos", "ord"), ["part"]), ["part"])
    return rows.select("part", "hs", "chapter98", "corresponding", "rate")


def fragmented_codes(spark, d):
    """Codes over three cells between two headings; what stands before and after is none of the table."""
    p = _part(spark, d)
    cut = [F.substring("code", a, n) for a, n in ((1, 4), (5, 2), (7, 2))]
    body = _document(p, _of_document(), ["p_partkey"], [*cut, F.col("p_name"), F.col("p_size").cast("string")])
    texts = body.select("part", F.concat(F.lit(MARK.join(("1111", "22", "33", "x", "4", "Phụ lục IV", ""))), "text", F.lit(MARK.join(("", "Hết", "1234", "56", "78", "9")))).alias("text"))
    cells = sources.cells(texts).withColumnRenamed("pos", "ord")
    inside = parsers.region(cells, ["part"], F.col("cell").startswith("Phụ lục IV"), F.col("cell") == "Hết")
    return parsers.fragmented_codes(inside, ["part"]).select("part", "hs", "rate")


def nomenclature(spark, d):
    """Headings, dashed levels and codes folded to paths."""
    p = _part(spark, d)
    head = F.concat(F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("p_size") + 10).cast("string"), 2, "0"))
    texts = _document(p, _of_document(), ["p_partkey"], [head, F.col("p_type"), F.concat(F.lit("- "), F.col("p_brand"), F.lit(":")), F.col("dotted"), F.concat(F.lit("- - "), F.col("p_name"))])
    paths = parsers.nomenclature_paths(sources.cells(texts).withColumnRenamed("pos", "ord"), ["part"])
    return paths.select("part", "hs", "heading", "description", "path")


def _law(spark, d):
    """(document, short, part, pos, line): each nation an act of one chapter, its customers the articles, in two parts with a preamble."""
    c = read_table(spark, d, "customer").join(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    second = (F.col("c_custkey") % 2).alias("second")
    key = F.col("c_custkey").cast("string")
    pieces = [F.concat(F.lit("Điều "), key, F.lit(". "), F.col("c_name")), F.concat(F.lit("1. First for "), F.col("c_mktsegment")), F.concat(F.lit("a) Point of "), key), F.lit("12 PAGE 3"), F.concat(F.lit("b) Other of "), key), F.concat(F.lit("2. Last of "), F.col("c_name"))]
    body = c.select("n_name", second, "c_custkey", F.concat_ws("\n", *pieces).alias("piece"))
    made = body.groupBy("n_name", "second").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "piece"))), lambda r: r["piece"]), "\n").alias("text"))
    opening = F.when(F.col("second") == 0, F.lit("CÔNG BÁO/Số 1\nWords before\nChương I\nGENERAL\n")).otherwise(F.lit("CÔNG BÁO/Số 2\nmore words before it\nMục 1\nOF DETAILS\n"))
    texts = made.select(F.col("n_name").alias("document"), F.col("n_name").alias("short"), F.col("second").alias("part"), F.concat(opening, "text", F.when(F.col("second") == 1, F.lit("\nNơi nhận: all\nĐiều 999999. Behind")).otherwise(F.lit(""))).alias("text"))
    lines = sources.lines(texts)
    marker = f"{parsers.CHAPTER}|{parsers.SECTION}|{parsers.ARTICLE}"
    return sources.ordered(sources.skip_preambles(lines, marker, ["document", "short"]), ["document", "short"])


def provision_tree(spark, d):
    """Chapters, sections, articles, clauses and points of every act."""
    nodes = parsers.provisions(_law(spark, d))
    return nodes.select("document", "ptype", "key", "parent_key", "number", "heading", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), "path", "citation_label")


def provision_counts(spark, d):
    """Nodes of each kind by act, and how many lines an act has behind its preambles."""
    law = _law(spark, d)
    counts = parsers.structural_counts(parsers.provisions(law))
    return counts.join(law.groupBy("document").agg(F.max("ord").cast("bigint").alias("n_lines")), "document").select("document", "ptype", "n", "n_lines")


def tree_parents(spark, d):
    """Parent ids of a tree of nations and customers by one self join; regions are missing, so nations have none."""
    n = read_table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent_key"))
    c = read_table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("parent_key"))
    return parsers.with_parents(c.unionByName(n)).select("id", "key", "parent_id")


def record_fields(spark, d):
    """Blocks of fields, one for each supplier, a hundred to a text; some lack a field."""
    s = read_table(spark, d, "supplier")
    lines = [F.concat(F.lit("- id: "), F.col("s_suppkey").cast("string")), F.concat(F.lit("  name: '"), F.col("s_name"), F.lit("'")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  nation:  "), F.col("s_nationkey").cast("string"), F.lit(" ")))]
    texts = _document(s, F.expr("s_suppkey div 100"), ["s_suppkey"], lines, "\n")
    return sources.record_blocks(texts, ["name", "nation"])


def _payloads(spark, d):
    p = read_table(spark, d, "pages")
    levels = F.array(*[F.lit(x) for x in ("Chapter", "Article", "Clause", "Point", "Other")])
    node = lambda i: F.concat(F.lit('{"level":"'), F.element_at(levels, ((F.col("page_id") + i) % 5 + 1).cast("int")), F.lit('"}'))
    fields = F.concat(F.lit('x={"title":"'), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit('",'), F.when(F.col("page_id") % 3 == 0, F.lit('"note":"n",')).otherwise(F.lit("")))
    return p.select("page_id", F.concat(fields, F.lit('"tree":['), node(0), F.lit(","), node(1), F.lit("]};")).alias("payload"))


def payload_scrape(spark, d):
    """Fields of payloads inside pages, by name."""
    return sources.payload_fields(_payloads(spark, d), F.col("payload"), ["title", "note"]).select("page_id", "title", "note")


def payload_outline(spark, d):
    """Nodes of each level in all payloads."""
    return sources.payload_levels(_payloads(spark, d), "payload")


def page_glyphs(spark, d):
    """Glyphs without footnotes: an order is a page, its lines glyphs by quantity (size) and price (place)."""
    g = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 3).alias("size"), F.col("l_extendedprice").alias("top"))
    return sources.layout_lines(g, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def normalised_events(spark, d):
    """Raw verdicts as they may be recorded, or what is wrong with them."""
    e, i = read_table(spark, d, "events"), F.col("event_id")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    raw = e.select(
        "event_id", pick("0101.21.00", " 01012100 ", "12", None).alias("hs"), pick(" cn", "", None).alias("origin"), pick("2024-01-05", "soon", "2024-02-30", "2024-03-01", "2024-05-05").alias("day"),
        pick("A", " ").alias("schedule"), pick("correct", "wrong", "unsure", "maybe", "correct", "wrong", "unsure").alias("verdict"), pick(" Lan ", "", "x" * 70, "An", "Bo", "Cu", "Da", "Em", "Gi", "Ha", "Ki").alias("staff"), pick("note", " ", None).alias("note"), F.lit("{}").alias("snapshot"),
    )
    done = events.normalised_events(raw)
    return done.groupBy("hs_code", "origin", F.col("as_of_date").cast("string").alias("as_of_date"), "schedule", "verdict", F.length("staff_name").cast("bigint").alias("staff_chars"), "note", "problem").agg(F.count(F.lit(1)).alias("n"))


def correction_flow(spark, d):
    """Corrections that messages give about the last lookup: a verdict to log and a code to look up next."""
    e, i = read_table(spark, d, "events"), F.col("event_id")
    said = F.when(i % 4 == 0, "sai, phải là 0101.21.00").when(i % 4 == 1, "đúng là 0202 30 00 nhé").when(i % 4 == 2, "cảm ơn").otherwise("nhầm rồi")
    messages = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"), said.alias("message"), F.when(i % 3 == 0, "01012100").when(i % 3 == 1, "02023000").alias("prior"), F.when(i % 5 == 0, "2024-01-01").alias("prior_day"))
    return events.corrections(messages, "prior", "prior_day", "message", "sender", "2024-06-01").groupBy("hs", "day", "verdict", "staff", "note", "next_code").agg(F.count(F.lit(1)).alias("n"))


def _mentioning(spark, d):
    e, i = read_table(spark, d, "events"), F.col("event_id")
    span = lambda uid, at, n: F.struct(F.lit(uid).alias("uid"), F.lit(at).alias("pos"), F.lit(n).alias("len"))
    mentions = F.when(i % 4 == 0, F.array(span("bot", 0, 4))).when(i % 4 == 1, F.array(span("bot", 0, 4), span("an", 5, 3))).when(i % 4 == 2, F.array(span("an", 5, 3)))
    return e.select(
        "event_id", F.when(i % 7 == 0, "bot").otherwise("user").alias("sender"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("thread"), (i % 2 == 0).alias("is_group"),
        F.when(i % 11 == 0, F.lit("@bot")).otherwise(F.concat(F.lit("@bot @an van "), i.cast("string"))).alias("message"), mentions.alias("mentions"), (i % 5 == 0).alias("has_image"),
    )


def message_filter(spark, d):
    """Messages to answer: not the bot's own, of allowed threads, in groups only where it is mentioned."""
    return events.answerable(_mentioning(spark, d), "bot", ["t0", "t1"]).select("event_id", "message")


def mention_strip(spark, d):
    """Messages without their mentions."""
    m = _mentioning(spark, d)
    spans = F.transform(F.coalesce("mentions", F.array().cast(m.schema["mentions"].dataType)), lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len")))
    return m.select("event_id", events.without_mentions(F.col("message"), spans).alias("message"))


def keyword_residue(spark, d):
    """What is left of questions as a good's name, without the words for their origin."""
    p = read_table(spark, d, "part")
    asked = F.concat(F.lit("Thuế nhập khẩu "), "p_name", F.lit(" "), "p_brand", F.element_at(F.array(*[F.lit(x) for x in (" từ Trung Quốc", " china", " từ tàu")]), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit(" 2024-01-01 bao nhiêu?"))
    return p.select("p_partkey", events.keyword_in(asked, F.lit("CN")).alias("named"), events.keyword_in(asked).alias("plain"))


def written_files(spark, d):
    """Rows written as NDJSON, lines and a reloaded table, and read back: counts and sums of each form."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("s_name"))
    folder = scratch(spark)
    emit_ndjson(s, f"{folder}/rows")
    emit_lines(s, "s_suppkey", f"{folder}/lines")
    emit_arrays(s, f"{folder}/array", 400)
    kind = "s_suppkey bigint, s_name string"
    loaded = [load(s, f"{folder}/facts", s, f"{folder}/names") for _ in range(2)]
    told = lambda df, form: df.agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"), F.count("s_name").alias("named"))
    lines = spark.read.text(f"{folder}/lines").select(F.col("value").cast("bigint").alias("s_suppkey"), F.lit(None).cast("string").alias("s_name"))
    out = told(read_ndjson(spark, f"{folder}/rows", kind), "ndjson").unionByName(told(read_json_array(spark, f"{folder}/array", kind), "array")).unionByName(told(lines, "lines"))
    facts, names = spark.read.parquet(f"{folder}/facts"), spark.read.parquet(f"{folder}/names")
    return out.unionByName(told(facts, f"facts {loaded}")).unionByName(told(names, "dimension"))


_LAW = """c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n, c_name, c_mktsegment, n_name AS d, c_custkey % 2 = 1 AS s, bool_or(c_custkey % 2 = 0) OVER w AS e, bool_or(c_custkey % 2 = 1) OVER w AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WINDOW w AS (PARTITION BY n_name)),
    a AS (SELECT *, d || CASE WHEN e THEN ' › Chương I' ELSE '' END || CASE WHEN s THEN ' › Mục 1' ELSE '' END || ' › Điều ' || n AS p, 'Điều ' || n || ' ' || d AS l, d || '::dieu-' || n AS key, CASE WHEN e THEN 'I' ELSE 'None' END AS x FROM c),
    nodes AS (SELECT DISTINCT d AS document, 'chuong' AS ptype, d || '::chuong-I' AS key, NULL AS parent_key, 'I' AS number, 'Chương I. GENERAL' AS heading, '' AS body, d || ' › Chương I' AS path, 'Chương I ' || d AS citation_label FROM a WHERE e
      UNION ALL SELECT DISTINCT d, 'muc', d || '::chuong-' || x || '-muc-1', CASE WHEN e THEN d || '::chuong-I' END, '1', 'Mục 1. OF DETAILS', '', d || CASE WHEN e THEN ' › Chương I' ELSE '' END || ' › Mục 1', 'Mục 1 Chương ' || x || ' ' || d FROM a WHERE s
      UNION ALL SELECT d, 'dieu', key, d || '::chuong-' || x || CASE WHEN s THEN '-muc-1' ELSE '' END, n, 'Điều ' || n || '. ' || c_name, '1. First for ' || c_mktsegment || chr(10) || 'a) Point of ' || n || chr(10) || '12 PAGE 3' || chr(10) || 'b) Other of ' || n || chr(10) || '2. Last of ' || c_name, p, l FROM a
      UNION ALL SELECT d, 'khoan', key || '-khoan-1', key, '1', NULL, 'First for ' || c_mktsegment || chr(10) || 'a) Point of ' || n || chr(10) || '12 PAGE 3' || chr(10) || 'b) Other of ' || n, p || ' › Khoản 1', 'Khoản 1 ' || l FROM a
      UNION ALL SELECT d, 'khoan', key || '-khoan-2', key, '2', NULL, 'Last of ' || c_name, p || ' › Khoản 2', 'Khoản 2 ' || l FROM a
      UNION ALL SELECT d, 'diem', key || '-khoan-1-diem-a', key || '-khoan-1', 'a', NULL, 'Point of ' || n || chr(10) || '12 PAGE 3', p || ' › Khoản 1 › Điểm a', 'Điểm a Khoản 1 ' || l FROM a
      UNION ALL SELECT d, 'diem', key || '-khoan-1-diem-b', key || '-khoan-1', 'b', NULL, 'Other of ' || n, p || ' › Khoản 1 › Điểm b', 'Điểm b Khoản 1 ' || l FROM a)"""
_CODE = "lpad(CAST(p_partkey + 1000000 AS VARCHAR), 8, '0')"
_RATES = "['5', '7,5', '*', '5 4 3 2 1 0', array_to_string(list_reverse(range(1, 31)), ' '), {}][p_partkey % 6 + 1]"
_MENTION = """m AS (SELECT event_id, user_id, event_id % 11 = 0 AS bare, event_id % 4 AS r, 'van ' || event_id AS body FROM events),
    w AS (SELECT *, CASE WHEN bare THEN CASE r WHEN 0 THEN '' WHEN 1 THEN '' ELSE '@bot' END ELSE CASE r WHEN 0 THEN '@an ' || body WHEN 1 THEN body WHEN 2 THEN '@bot ' || body ELSE '@bot @an ' || body END END AS stripped,
            CASE WHEN bare THEN '@bot' ELSE '@bot @an ' || body END AS whole FROM m)"""


def _picked(*values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][event_id % {len(values)} + 1]"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries, by name."""
    return {
        "gazette_rows": f"""SELECT p_partkey // {_GOODS} AS part, CASE WHEN p_size > 25 THEN 'II' ELSE 'I' END AS annex, c AS hs, substr(c, 1, 4) || '.' || substr(c, 5, 2) || '.' || substr(c, 7, 2) AS hs_dotted, p_name AS description,
            ['5', '7,5', '*', '5', '30', NULL][p_partkey % 6 + 1] AS rate, {_RATES.format("''")} AS rates FROM (SELECT *, {_CODE} AS c FROM part) z""",
        "agreement_rows": f"SELECT p_partkey // {_GOODS} AS part, {_CODE} AS hs, p_name AS description, {_RATES.format("'8 6'")} AS rates, [1, 1, 1, 6, 30, 2][p_partkey % 6 + 1] AS n_rates FROM part",
        "special_chapter": f"SELECT p_partkey // {_GOODS} AS part, '98' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS hs, true AS chapter98, CASE WHEN p_partkey % 2 = 0 THEN {_CODE} END AS corresponding, CAST(p_size AS VARCHAR) AS rate FROM part",
        "fragmented_codes": f"SELECT p_partkey // {_GOODS} AS part, {_CODE} AS hs, CAST(p_size AS VARCHAR) AS rate FROM part",
        "nomenclature": f"SELECT p_partkey // {_GOODS} AS part, {_CODE} AS hs, p_type AS heading, p_name AS description, p_type || ' › ' || p_brand || ' › ' || p_name AS path FROM part",
        "provision_tree": f"WITH {_LAW} SELECT document, ptype, key, parent_key, number, heading, md5(body) AS body_md5, path, citation_label FROM nodes",
        "provision_counts": f"WITH {_LAW} SELECT document, ptype, count(*) AS n, max(lines) AS n_lines FROM nodes JOIN (SELECT d AS document, 6 * count(*) + 2 * max(CAST(e AS INT)) + 4 * max(CAST(o AS INT)) AS lines FROM c GROUP BY 1) x USING (document) GROUP BY 1, 2",
        "tree_parents": "SELECT c_custkey + 1000 AS id, 'c' || c_custkey AS key, c_nationkey + 1 AS parent_id FROM customer UNION ALL SELECT n_nationkey + 1, 'n' || n_nationkey, NULL FROM nation",
        "record_fields": "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS nation FROM supplier",
        "payload_scrape": "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS title, CASE WHEN page_id % 3 = 0 THEN 'n' END AS note FROM pages",
        "payload_outline": "SELECT level, count(*) AS n FROM (SELECT ['Chapter', 'Article', 'Clause', 'Point', 'Other'][(page_id + i) % 5 + 1] AS level FROM pages, (VALUES (0), (1)) v(i)) z WHERE level <> 'Other' GROUP BY 1",
        "page_glyphs": """SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_quantity / 3 AS size, l_extendedprice AS top, max(CASE WHEN round(l_quantity / 3) >= 13 THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS bottom FROM lineitem) z
            WHERE size >= 13 OR (size >= 11 AND (bottom IS NULL OR top <= bottom + 2)) GROUP BY 1""",
        "normalised_events": f"""WITH r AS (SELECT {_picked('01012100', '01012100', '12', None)} AS hs_code, {_picked('CN', None, None)} AS origin, {_picked('2024-01-05', None, None, '2024-03-01', '2024-05-05')} AS as_of_date, {_picked('A', None)} AS schedule,
              {_picked('correct', 'wrong', 'unsure', 'maybe', 'correct', 'wrong', 'unsure')} AS verdict, [3, 0, 64, 2, 2, 2, 2, 2, 2, 2, 2][event_id % 11 + 1] AS staff_chars, {_picked('note', None, None)} AS note FROM events)
            SELECT *, count(*) AS n FROM (SELECT *, CASE WHEN hs_code IS NULL OR hs_code = '12' THEN 'hs' WHEN as_of_date IS NULL THEN 'date' WHEN verdict = 'maybe' THEN 'verdict' WHEN staff_chars = 0 THEN 'staff' END AS problem FROM r) z GROUP BY ALL""",
        "correction_flow": f"""WITH r AS (SELECT 'u' || user_id AS staff, event_id % 4 AS k, {_picked('01012100', '02023000', None)} AS hs, {_picked('2024-01-01', None, None, None, None)} AS pd FROM events),
            f AS (SELECT *, CASE k WHEN 0 THEN '01012100' WHEN 1 THEN '02023000' END AS fix FROM r WHERE k <> 2)
            SELECT hs, coalesce(pd, '2024-06-01') AS day, CASE WHEN fix = hs THEN 'correct' WHEN hs IS NOT NULL THEN 'wrong' END AS verdict, staff, CASE k WHEN 0 THEN 'sai, phải là 0101.21.00' WHEN 1 THEN 'đúng là 0202 30 00 nhé' ELSE 'nhầm rồi' END AS note,
              CASE WHEN fix IS DISTINCT FROM hs THEN fix END AS next_code, count(*) AS n FROM f GROUP BY ALL""",
        "message_filter": f"""WITH {_MENTION} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN stripped ELSE whole END AS message FROM w
            WHERE event_id % 7 <> 0 AND user_id % 3 < 2 AND (event_id % 2 = 1 OR r = 0) AND (event_id % 5 = 0 OR CASE WHEN event_id % 2 = 0 THEN stripped ELSE whole END <> '')""",
        "mention_strip": f"WITH {_MENTION} SELECT event_id, stripped AS message FROM w",
        "keyword_residue": "SELECT p_partkey, lower(p_name || ' ' || p_brand) AS named, lower(p_name || ' ' || p_brand) || [' trung quốc', ' china', ' tàu'][p_partkey % 3 + 1] AS plain FROM part",
        "written_files": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS v FROM supplier), t AS (SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS total, count(v) AS named FROM s)
            SELECT form, n, total, CASE WHEN form = 'lines' THEN 0 ELSE named END AS named FROM t, (VALUES ('ndjson'), ('array'), ('lines'), ('facts [True, False]'), ('dimension')) f(form)""",
    }


def queries():
    """Each query with its callable."""
    return {name: globals()[name] for name in oracle_sql()}
