"""Segmented scans against one window over the whole, and the parsers on one document of many segments."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from isochron.operators import parsers, scan, temporal


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_states_equal_windows(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice([None, 1, 2, 5, 9]), rng.choice(["a", None, "b"])) for d in ("x", "y") for i in sorted(rng.sample(range(400), 150))]
    df = spark.createDataFrame(rows, "doc string, ord int, n int, s string")
    w = Window.partitionBy("doc").orderBy("ord")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.count_if(F.col("n") > 1).over(run).alias("c"), F.last("s", ignorenulls=True).over(run).alias("l"), F.max("n").over(run).alias("g"), F.lag("s").over(w).alias("b"), F.lead("n").over(w).alias("a"))
    for size in (1, 7, 1000):
        got = scan.running(df, ["doc"], [scan.count("c", F.col("n") > 1), scan.last("l", F.col("s")), scan.greatest("g", F.col("n")), scan.before("b", F.col("s")), scan.after("a", F.col("n"))], size=size)
        assert rows_of(got) == rows_of(want)
        tied = scan.carried(df.withColumn("day", F.expr("ord div 3")), ["doc"], "day", [F.col("ord")], F.col("s"), "l", size)
        assert rows_of(tied.select("doc", "ord", "l")) == rows_of(want.select("doc", "ord", "l"))


def test_one_long_document_of_lines(spark):
    """A million lines of one act in segments, of which no task sorts more than a few; every node and its order come out."""
    n = 125_000
    body = F.array(F.concat(F.lit("Điều "), (F.col("id") + 1).cast("string"), F.lit(". Tên")), F.lit("mở đầu"), F.lit("1. Khoản một"), F.lit("a) Điểm a"), F.lit("tiếp"), F.lit("b) Điểm b"), F.lit("2. Khoản hai"), F.lit("cuối"))
    prose = spark.range(n).select(F.lit("d").alias("document"), F.lit("s").alias("short"), F.posexplode(body).alias("pos", "line"), "id").select("document", "short", (F.col("id") * 8 + F.col("pos") + 3).alias("ord"), "line")
    head = spark.createDataFrame([("d", "s", 1, "Chương I"), ("d", "s", 2, "CHUNG")], "document string, short string, ord bigint, line string")
    nodes = parsers.provisions(prose.unionByName(head))
    assert {r["ptype"]: r["n"] for r in parsers.structural_counts(nodes).collect()} == {"chuong": 1, "dieu": n, "khoan": 2 * n, "diem": 2 * n}
    some = {r["key"]: r for r in nodes.where(F.col("number").isin("70001") | (F.col("order_index") == 0) | F.col("key").contains("dieu-70001-")).collect()}
    assert some["d::chuong-I"]["order_index"] == 0 and some["d::dieu-70001"]["order_index"] == 1 + 70_000 * 5
    assert some["d::dieu-70001-khoan-1"]["body"] == "Khoản một\na) Điểm a\ntiếp\nb) Điểm b" and some["d::dieu-70001-khoan-1-diem-a"]["body"] == "Điểm a\ntiếp"
    assert some["d::dieu-70001-khoan-2"]["parent_key"] == "d::dieu-70001" and some["d::dieu-70001"]["path"] == "s › Chương I › Điều 70001"
    assert nodes.agg(F.max("order_index")).first()[0] == 5 * n


def plain_nodes(lines):
    """(ptype, key, parent_key, body) of one act 'd', line by line."""
    is_a = lambda pattern, line: re.search(pattern.replace("(?iu)", ""), line, re.I if "(?iu)" in pattern else 0)
    found, above, started = {}, None, False
    chapter = section = article = clause = point = None
    seen = set()
    for line in lines:
        mark = is_a(parsers.CHAPTER, line) or is_a(parsers.SECTION, line)
        titled, above = above and not mark, mark
        opens = None if titled or mark else is_a(parsers.ARTICLE, line)
        started = started or bool(mark or opens)
        if not started or titled:
            continue
        if not (mark or opens) and is_a(parsers.TERMINATOR, line):
            break
        if mark:
            article = clause = point = None
            if is_a(parsers.CHAPTER, line):
                chapter, section = mark[1].upper(), None
            else:
                section = mark[1]
            continue
        if opens:
            article, clause, point = None if opens[1] in seen else f"d::dieu-{opens[1]}", None, None
            seen.add(opens[1])
            if article:
                of_chapter = chapter and f"d::chuong-{chapter}"
                of_section = section and f"d::chuong-{chapter}-muc-{section}"
                if of_chapter:
                    found.setdefault(of_chapter, ("chuong", None, []))
                if of_section:
                    found.setdefault(of_section, ("muc", of_chapter, []))
                found[article] = ("dieu", of_section or of_chapter, [])
            continue
        if not article:
            continue
        found[article][2].append(line)
        if m := is_a(parsers.CLAUSE, line):
            clause, point = f"{article}-khoan-{m[1]}#{len(found)}", None
            found[clause] = ("khoan", article, [m[2].strip()])
        elif clause and (m := is_a(parsers.POINT, line)):
            found[clause][2].append(line)
            point = f"{clause}-diem-{m[1]}#{len(found)}"
            found[point] = ("diem", clause.partition("#")[0], [m[2].strip()])
        else:
            for node in (clause, point):
                if node:
                    found[node][2].append(line)
    return sorted((kind, re.sub("#[0-9]+", "", key), str(up), "\n".join(body).strip() if kind in ("dieu", "khoan", "diem") else "") for key, (kind, up, body) in found.items())


def test_segments_don_t_change_a_document(spark):
    rng = random.Random(8)
    kinds = ["1. Khoản", "2. Khoản", "3. Khoản", "a) Điểm", "đ) Điểm", "b) Điểm", "lời văn", "dòng"]
    lines = [rng.choice([*kinds, *kinds, f"Điều {rng.randint(1, 60)}. Tên", f"Điều {rng.randint(1, 60)}. Tên", rng.choice(["Chương II", "Mục 3", "chương V"])]) for i in range(299)] + ["lời", "Nơi nhận: x", "Điều 99. Sau"]
    prose = spark.createDataFrame([("d", "s", i, x) for i, x in enumerate(lines)], "document string, short string, ord int, line string")
    whole = rows_of(parsers.provisions(prose))
    got = parsers.provisions(prose).collect()
    assert sorted((r["ptype"], r["key"], str(r["parent_key"]), r["body"] or "") for r in got) == plain_nodes(lines)
    for size in (1, 5, 64):
        assert rows_of(parsers.provisions(prose, size=size)) == whole


def test_one_long_table_of_cells(spark):
    n = 200_000
    cell = F.array(F.date_format(F.lit("2020-01-01"), "yyyy").substr(1, 0), F.concat(F.lpad((F.col("id") % 9000 + 1000).cast("string"), 4, "0"), F.lit(".10.20")), F.lit("Tên"), F.lit("5"), F.lit("4"))
    cells = spark.range(n).select(F.lit("d").alias("doc"), F.posexplode(cell).alias("pos", "cell"), "id").select("doc", (F.col("id") * 5 + F.col("pos")).alias("ord"), "cell")
    got = parsers.tariff_rows(cells, ["doc"]).groupBy("description", F.array_join("rates", " ").alias("rates"), "annex").count().collect()
    assert [tuple(r) for r in got] == [("Tên", "5 4", None, n)]


def table(spark, cells):
    return spark.createDataFrame([("d", i, c) for i, c in enumerate(cells)], "doc string, ord int, cell string")


def rates_of(spark, cells, **more):
    return [(r.hs, r.description, r.rates) for r in parsers.tariff_rows(table(spark, cells), ["doc"], size=4, **more).orderBy("row_no").collect()]


def test_all_rates_of_a_row(spark):
    many = [str(i) for i in range(30)]
    assert rates_of(spark, ["0101.21.00", "Ngựa", *many, "x", "7"]) == [("01012100", "Ngựa", many)]
    late = ["0101.21.00", *[f"w{i}" for i in range(12)], "5", "4"]
    assert rates_of(spark, late) == [("01012100", "w0", [])] and rates_of(spark, late, late=True) == [("01012100", "w0", ["5", "4"])]
    assert rates_of(spark, ["0101.21.00", *[f"w{i}" for i in range(11)], "5"]) == [("01012100", "w0", ["5"])]
    assert rates_of(spark, ["0101.21.00", "x", *["w"] * 12, "5"], late=True) == [("01012100", "x", [])]
    assert rates_of(spark, ["0101.21.00", "5", "", "4", "", "", "3"]) == [("01012100", "", ["5", "4"])]


def test_trees_of_any_depth_and_size(spark):
    chain = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(130)]
    lost = [("a", "b", "x"), ("b", "a", "y"), ("c", "a", "z"), ("self", "self", "s"), ("o", "missing", "o"), ("p", "o", "p")]
    nodes = spark.createDataFrame(chain + lost, "key string, parent_key string, name string")
    got = {r["key"]: (r["path"], r["depth"]) for r in parsers.walk(nodes).collect()}
    assert got == {str(i): (" › ".join(f"n{k}" for k in range(i + 1)), i) for i in range(130)}
    assert {tuple(r) for r in parsers.unrooted(nodes).collect()} == {("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("self", "cycle"), ("o", "parent"), ("p", "parent")}
    wide = spark.range(1_200_000).select("id", F.when(F.col("id") > 0, F.expr("(id - 1) div 100")).alias("parent"), F.lit("n").alias("name"))
    assert parsers.walk(wide, "id", "parent").groupBy("depth").count().count() == 5
    assert parsers.walk(wide, "id", "parent").count() == 1_200_000


def test_asof_joins_of_a_hot_key(spark):
    """Half of all rows have one key; both forms give the plain join's rows."""
    events = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("int").alias("k"), "id", F.date_add(F.lit("2020-01-01"), (F.col("id") * 7 % 900).cast("int")).alias("day"))
    starts = spark.range(1200).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("int").alias("k"), F.date_add(F.lit("2020-01-10"), (F.col("id") * 3 % 850).cast("int")).alias("f")).distinct()
    order = Window.partitionBy("k").orderBy("f")
    # Each rate ends before the next one; some end earlier and leave gaps, the last stays open.
    rates = starts.withColumn("t", F.date_sub(F.lead("f").over(order), 1)).withColumn("t", F.when(F.dayofmonth("f") % 5 == 0, F.col("f")).otherwise(F.col("t"))).withColumn("pct", F.hash("k", "f"))
    want = rows_of(temporal.asof_join(events, rates, ["k"], "day", "f", "t").select("k", "id", "day", "f", "t", "pct"))
    assert len(want) > 1000
    for size in (1, 50, 4096):
        assert rows_of(temporal.asof_disjoint(events, rates, ["k"], "day", "f", "t", size).select("k", "id", "day", "f", "t", "pct")) == want
    overlapping = rates.withColumn("t", F.date_add("t", 40))
    want = rows_of(temporal.asof_join(events, overlapping, ["k"], "day", "f", "t").select("k", "id", "day", "f", "t", "pct"))
    for span in (1, 30, 5000):
        assert rows_of(temporal.asof_spread(events, overlapping, ["k"], "day", "f", "t", span).select("k", "id", "day", "f", "t", "pct")) == want


def test_cycles_gather_no_names(spark, monkeypatch):
    """No row of a round grows with the number of nodes that hang on a cycle."""
    widest = []

    def told(df, plain=parsers.written):
        out = plain(df)
        widest.append(out.agg(F.max(F.length(F.coalesce("path", F.lit(""))))).first()[0])
        return out

    monkeypatch.setattr(parsers, "written", told)
    nodes = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("key"), F.lit("a").alias("parent_key"), F.lit("c").alias("name")).unionByName(spark.createDataFrame([("a", "b", "x"), ("b", "a", "y"), ("r", None, "r"), ("s", "r", "s")], "key string, parent_key string, name string"))
    assert parsers.unrooted(nodes).where("problem = 'cycle'").count() == 1002
    assert {tuple(r) for r in parsers.walk(nodes).collect()} == {("r", "r", 0), ("s", "r › s", 1)}
    assert max(x or 0 for x in widest) <= 5
