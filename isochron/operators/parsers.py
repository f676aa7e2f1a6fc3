"""Document-to-table operators: tariff rows, nomenclature paths, provision trees and chunks from ordered cells and lines.

Each document is one ordered sequence of any length: its state runs from segment to segment (``scan``), never through one
window over the document. Nothing leaves Spark's expressions; the nomenclature's stack is folded heading by heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions.text import dash_depth, undashed, word_list
from isochron.operators import scan
from isochron.sources.tables import written

#: Forms of cells and of structural lines.
HS8, RATE = r"^\d{4}\.\d{2}\.\d{2}$", r"^(\d{1,3}(,\d+)?|\*)$"
CHAPTER, SECTION = r"(?iu)^Chương\s+([IVXLCDM]+)\b", r"^Mục\s+(\d+)\b"
ARTICLE, CLAUSE, POINT = r"^Điều\s+(\d+)\.?\d*\s*(.+)$", r"^(\d+)\.\d*\s+(.+)$", r"^([a-zđ])\)\s+(.*)$"
TERMINATOR = r"^(TM\.|KT\.|Nơi nhận|THỦ TƯỚNG\b|BỘ TRƯỞNG\b|CHỦ TỊCH\b|Phụ lục\b|PHỤ LỤC\b)"
ANNEXES = (("I", "BIỂU THUẾ XUẤT KHẨU", False), ("II", "BIỂU THUẾ NHẬP KHẨU", False), ("III", "Phụ lục III", True), ("IV", "Phụ lục IV", True))
CRUMB = " › "


def forward_marker(rows: DataFrame, doc: list[str], value: Column, name: str, order: str = "ord") -> DataFrame:
    """The greatest marker ordinal so far: markers only go forward, so a lesser one later changes nothing."""
    return scan.running(rows, doc, [scan.greatest(name, value)], order)


def carry(rows: DataFrame, doc: list[str], value: Column, name: str, order: str = "ord") -> DataFrame:
    """The last marker so far; rows before the first have null."""
    return scan.running(rows, doc, [scan.last(name, value)], order)


def annex_ordinal(cell: Column) -> Column:
    """1 to 4 for a cell that opens an annex; the case of the heading matters."""
    out = F.lit(None).cast("int")
    for i, (_, words, start) in reversed(list(enumerate(ANNEXES, 1))):
        out = F.when(cell.startswith(words) if start else cell.contains(words), i).otherwise(out)
    return out


def region(rows: DataFrame, doc: list[str], start: Column, stop: Column | None = None, order: str = "ord") -> DataFrame:
    """Rows from the first ``start`` to before the next ``stop``."""
    first = rows.where(start).groupBy(*doc).agg(F.min(order).alias("__a"))
    out = rows.join(first, doc).where(F.col(order) >= F.col("__a"))
    if stop is not None:
        end = out.where(stop & (F.col(order) > F.col("__a"))).groupBy(*doc).agg(F.min(order).alias("__b"))
        out = out.join(end, doc, "left").where(F.col("__b").isNull() | (F.col(order) < F.col("__b"))).drop("__b")
    return out.drop("__a")


def tariff_rows(cells: DataFrame, doc: list[str], reach: int = 12, late: bool = False, size: int = scan.SEGMENT) -> DataFrame:
    """(doc, row_no, annex, hs, hs_dotted, description, rates, rate): each code cell with what follows it up to the next one.

    The description is the first cell with text, where it is no rate. ``rates`` are the first run of rate cells, all of
    them, which begins among the ``reach`` cells with text behind the code, or with ``late`` right after them: base
    decrees are read the first way, the tables of agreements the second. The run ends at another cell with text or at
    two blanks; ``rate`` is its first. ``row_no`` is the code's place. Cells before the first code belong to none.

    Documents may have any length: their state goes from segment to segment (``scan``), and a row's cells are summed up
    without being gathered, but for its rates.
    """
    code, solid = F.col("cell").rlike(HS8), F.col("cell") != ""
    text = scan.running(cells, doc, [scan.greatest("__annex", annex_ordinal(F.col("cell"))), scan.last("row_no", F.when(code, F.col("ord"))), scan.count("__solid", solid)], size=size)
    text = written(text.where(solid & F.col("row_no").isNotNull()).select(*doc, "ord", "cell", "row_no", "__annex", "__solid"))
    row = [*doc, "row_no"]
    heads = text.where(F.col("ord") == F.col("row_no")).select(*row, F.col("__annex").alias("__annex_no"), F.col("cell").alias("hs_dotted"), F.col("__solid").alias("__from"))
    behind = text.where(F.col("ord") > F.col("row_no")).select(*row, "ord", "cell", "__solid", F.col("cell").rlike(RATE).alias("__rate"))
    behind = behind.join(heads.select(*row, "__from"), row).withColumn("__place", F.col("__solid") - F.col("__from"))
    starts = behind.groupBy(*row).agg(F.min(F.when(F.col("__rate") & (F.col("__place") <= reach + int(late)), F.col("ord"))).alias("__at"), F.max(F.when((F.col("__place") == 1) & ~F.col("__rate"), F.col("cell"))).alias("__described"))
    after = behind.join(starts.where(F.col("__at").isNotNull()).select(*row, "__at"), row).where(F.col("ord") >= F.col("__at"))
    stops = after.where(~F.col("__rate")).groupBy(*row).agg(F.min("ord").alias("__stop"))
    run = after.join(stops, row, "left").where(F.col("__stop").isNull() | (F.col("ord") < F.col("__stop")))
    # Each blank between two cells moves a place on by one more than the count of cells with text.
    gaps = F.array_sort(F.collect_list(F.struct("ord", "cell", (F.col("ord") - F.col("__solid")).alias("blanks"))))
    found = run.groupBy(*row).agg(gaps.alias("__run"))
    broken = F.array_position(F.transform("__run", lambda x, i: (i > 0) & (x["blanks"] - F.try_element_at("__run", i.cast("int"))["blanks"] > 1)), True)
    whole = F.transform(F.when(broken > 0, F.slice("__run", F.lit(1), (broken - 1).cast("int"))).otherwise(F.col("__run")), lambda x: x["cell"])
    found = found.select(*row, whole.alias("rates"))
    names = F.create_map(*[F.lit(x) for i, (n, _, _) in enumerate(ANNEXES, 1) for x in (i, n)])
    out = heads.join(starts, row, "left").join(found, row, "left").withColumn("rates", F.coalesce("rates", F.array().cast("array<string>")))
    return out.select(*doc, "row_no", F.try_element_at(names, F.col("__annex_no")).alias("annex"), F.replace("hs_dotted", F.lit("."), F.lit("")).alias("hs"), "hs_dotted", F.coalesce("__described", F.lit("")).alias("description"), "rates", F.try_element_at("rates", F.lit(1)).alias("rate"))


def special_rows(rows: DataFrame, doc: list[str]) -> DataFrame:
    """Rows of the special chapter: a code that begins with 98, perhaps followed by one other code it corresponds to.

    That code's row holds what follows, so its description and rate pass to the special row and it is no row of its own.
    """
    chapter = F.col("hs").startswith("98")
    step = scan.running(written(rows), doc, [scan.after("__next", F.col("hs")), scan.after("__next_rate", F.col("rate")), scan.before("__before", F.col("hs")), scan.before("__before_rate", F.col("rate"))], "row_no")
    takes = chapter & F.col("rate").isNull() & F.col("__next").isNotNull() & ~F.col("__next").startswith("98")
    taken = ~chapter & F.coalesce(F.col("__before").startswith("98") & F.col("__before_rate").isNull(), F.lit(False))
    out = step.where(~taken).withColumns({"chapter98": chapter, "corresponding": F.when(takes, F.col("__next")), "rate": F.when(takes, F.col("__next_rate")).otherwise(F.col("rate"))})
    return out.drop("__next", "__next_rate", "__before", "__before_rate")


def fragmented_codes(cells: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, hs, rate): codes written over three cells of 4, 2 and 2 digits, and the first short number before the next code.

    ``ord`` counts a document's cells without a gap; ``row_no`` is the place of a code's third cell.
    """
    pair, four = F.col("cell").rlike(r"^\d{2}$"), F.col("cell").rlike(r"^\d{4}$")
    step = written(scan.running(cells, doc, [scan.last("__four", F.when(four, F.struct("ord", "cell"))), scan.before("__above", F.col("cell"))]))
    # The third cell tells that a code is one; its place names the row.
    ends = pair & F.coalesce(F.col("__above").rlike(r"^\d{2}$") & (F.col("__four.ord") == F.col("ord") - 2), F.lit(False))
    step = scan.running(step.withColumn("__ends", ends), doc, [scan.last("row_no", F.when(F.col("__ends"), F.col("ord")))]).where(F.col("row_no").isNotNull())
    head = F.max(F.when(F.col("__ends"), F.concat("__four.cell", "__above", "cell")))
    behind = ~F.col("__ends") & (F.col("cell").rlike(r"^\d{1,3}$") | four)
    rate = F.min(F.when(behind, F.struct("ord", F.when(~four, F.col("cell")).alias("rate"))))
    return step.groupBy(*doc, "row_no").agg(head.alias("hs"), rate.alias("r")).select(*doc, "hs", F.col("r.rate").alias("rate"), "row_no")


def nomenclature_paths(cells: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, hs, heading, description, path): each code's text under its heading and the dashed levels above it.

    Levels form a stack: an entry of depth d drops all of depth d or more. A heading empties it, so a heading and what
    follows fold on their own, one group for each; the first path of a code counts.
    """
    solid = cells.where(F.col("cell") != "")
    kind = F.when(F.col("cell").rlike(r"^\d{2}\.?\d{2}$"), "head").when(F.col("cell").rlike(HS8), "code").when(F.col("cell").rlike(r"^\d{4}\.\d{2}$"), "level").when(F.col("cell").startswith("-"), "dash")
    step = scan.running(solid.withColumn("kind", kind), doc, [scan.after("__text", F.col("cell")), scan.before("__named", F.col("kind").isin("head", "code", "level"))])
    # A cell that names the code before it is that code's text, not an entry.
    step = step.where(F.col("kind").isNotNull() & ~(F.coalesce("__named", F.lit(False)) & (F.col("kind") == "dash")))
    raw = F.when(F.col("kind") == "dash", F.col("cell")).otherwise(F.col("__text"))
    step = step.withColumns({"depth": F.when(F.col("kind") == "dash", dash_depth(raw)).otherwise(F.greatest(dash_depth(raw), F.lit(1))), "title": undashed(raw)})
    step = scan.running(step, doc, [scan.last("__head", F.when(F.col("kind") == "head", F.struct("ord", "title")))]).withColumns({"__group": F.col("__head.ord"), "__heading": F.col("__head.title")})
    entries = F.array_sort(F.collect_list(F.struct("ord", "kind", "depth", "title", "cell")))
    grouped = step.where(F.col("kind") != "head").groupBy(*doc, "__group").agg(F.first("__heading").alias("heading"), entries.alias("__e"))
    empty = F.array().cast("array<struct<depth: int, title: string>>")
    state = F.struct(empty.alias("stack"), F.array().cast("array<struct<ord: int, cell: string, title: string, crumbs: array<string>>>").alias("out"))

    def push(s, e):
        kept = F.filter(s["stack"], lambda x: x["depth"] < e["depth"])
        crumbs = F.transform(kept, lambda x: x["title"])
        row = F.struct(e["ord"].cast("int").alias("ord"), e["cell"].alias("cell"), e["title"].alias("title"), crumbs.alias("crumbs"))
        added = F.concat(kept, F.array(F.struct(e["depth"].alias("depth"), e["title"].alias("title"))))
        code = e["kind"] == "code"
        return F.struct(F.when(code, kept).otherwise(added).alias("stack"), F.when(code, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    folded = grouped.select(*doc, "heading", F.explode(F.aggregate("__e", state, push)["out"]).alias("r"))
    crumbs = F.filter(F.concat(F.array(F.coalesce("heading", F.lit(""))), F.col("r.crumbs"), F.array("r.title")), lambda x: x != "")
    rows = folded.select(*doc, F.replace(F.col("r.cell"), F.lit("."), F.lit("")).alias("hs"), F.coalesce("heading", F.lit("")).alias("heading"), F.col("r.title").alias("description"), F.array_join(crumbs, CRUMB).alias("path"), F.col("r.ord").alias("ord"))
    names = ["ord", "heading", "description", "path"]
    return rows.groupBy(*doc, "hs").agg(F.min(F.struct(*names)).alias("f")).select(*doc, "hs", *[F.col(f"f.{n}").alias(n) for n in names[1:]])


def _marked(prose: DataFrame, doc: list[str], size: int) -> DataFrame:
    """Lines from the first chapter, section or article to before the signature, with ``kind`` (chapter, section, title,
    article or null), and the lines above and below their marks; read from a table that is written once."""
    line, at = F.col("line"), F.col("ord")
    mark = F.when(line.rlike(CHAPTER), "chapter").when(line.rlike(SECTION), "section")
    rows = scan.running(prose.withColumn("__mark", mark), doc, [scan.before("__above", F.col("__mark")), scan.after("__below", line)], size=size)
    titled = F.col("__above").isNotNull() & F.col("__mark").isNull()
    rows = rows.withColumn("kind", F.when(titled, "title").when(F.col("__mark").isNotNull(), F.col("__mark")).when(line.rlike(ARTICLE), "article"))
    rows = rows.withColumns({"__structural": F.coalesce(F.col("kind").isin("chapter", "section", "article"), F.lit(False)), "__signed": F.col("kind").isNull() & line.rlike(TERMINATOR), "__below": F.when(F.col("__mark").isNotNull(), F.col("__below"))})
    rows = written(rows.drop("__mark", "__above"))
    begun = rows.join(rows.where("__structural").groupBy(*doc).agg(F.min(at).alias("__start")), doc).where(at >= F.col("__start"))
    ends = begun.where("__signed").groupBy(*doc).agg(F.min(at).alias("__end"))
    return begun.join(ends, doc, "left").where(F.col("__end").isNull() | (at < F.col("__end"))).drop("__signed", "__start", "__end")


def structured_lines(prose: DataFrame, doc: list[str], size: int = scan.SEGMENT) -> DataFrame:
    """Lines of a document with their chapter, section, article, clause and point, up to the signature.

    ``kind`` is chapter, section, title, article, clause, point or text. The line after a chapter or section mark is its
    title. A new chapter ends the section, an article ends clause and point. ``block``, ``clause_at`` and ``point_at``
    are the places of the marks that a line lies under: of the last chapter, section or article, of its clause and of
    its point. They tell what a line belongs to, so one scan over the last mark of each kind is all the state there is.
    """
    return _structured(_marked(prose, doc, size), doc, size)


def _structured(rows: DataFrame, doc: list[str], size: int) -> DataFrame:
    line, at = F.col("line"), F.col("ord")
    title = F.coalesce("__below", F.lit("")).alias("title")
    of = lambda kind, *parts: F.when(F.col("kind") == kind, F.struct(at.alias("at"), *parts))
    plain = F.col("kind").isNull()
    rows = scan.running(rows, doc, [
        scan.last("__block", F.when(F.col("__structural"), F.struct(at.alias("at"), F.when(F.col("kind") == "article", F.regexp_extract("line", ARTICLE, 1)).alias("article")))),
        scan.last("__chapter", of("chapter", F.upper(F.regexp_extract("line", CHAPTER, 1)).alias("number"), title)),
        scan.last("__section", of("section", F.regexp_extract("line", SECTION, 1).alias("number"), title)),
        scan.last("__clause", F.when(plain & line.rlike(CLAUSE), F.struct(at.alias("at"), F.regexp_extract("line", CLAUSE, 1).alias("number")))),
        scan.last("__point", F.when(plain & line.rlike(POINT), at)),
    ], size=size)
    block = F.col("__block.at")
    in_section = F.col("__section.at") > F.coalesce(F.col("__chapter.at"), F.lit(-1))
    in_clause = F.col("__block.article").isNotNull() & (F.col("__clause.at") > block)
    in_point = in_clause & (F.col("__point") > F.col("__clause.at"))
    rows = rows.withColumns({
        "chapter": F.col("__chapter.number"), "chapter_title": F.col("__chapter.title"), "section": F.when(in_section, F.col("__section.number")), "section_title": F.when(in_section, F.col("__section.title")),
        "article": F.col("__block.article"), "block": block, "clause": F.when(in_clause, F.col("__clause.number")), "clause_at": F.when(in_clause, F.col("__clause.at")), "point_at": F.when(in_point, F.col("__point")),
    })
    kind = F.when(F.col("clause_at") == at, "clause").when(F.col("point_at") == at, "point").otherwise(F.coalesce("kind", F.lit("text")))
    return rows.withColumn("kind", kind).drop("__below", "__structural", "__block", "__chapter", "__section", "__clause", "__point")


def provisions(prose: DataFrame, doc: str = "document", short: str = "short", size: int = scan.SEGMENT) -> DataFrame:
    """Rows (document, key, parent_key, ptype, number, order_index, heading, body, path, citation_label) of provision trees.

    ``prose`` has document, short, ord and line. Five kinds of node, each from its own lines; an article number counts
    where it comes first, as consolidated texts repeat numbers at their end. Bodies keep the lines' order; a clause's body
    keeps its points. A document may have any length; what a task holds of it is a node's own text.
    """
    d, s, line = F.col(doc), F.col(short), F.col("line")
    is_article, is_clause, is_point = (F.col("kind") == k for k in ("article", "clause", "point"))
    marked = _marked(prose.select(doc, short, "ord", "line"), [doc], size)
    first = marked.where(is_article).groupBy(doc, F.regexp_extract("line", ARTICLE, 1).alias("article")).agg(F.min("ord").alias("__first"))
    rows = _structured(marked, [doc], size).where(F.col("article").isNotNull())
    kept = rows.join(first, [doc, "article"]).where(F.col("block") == F.col("__first"))

    # A line belongs to one node of each level that it lies in, so one grouping makes the nodes of all five kinds.
    none = F.lit(None)
    at_level = lambda level, test, text, number, *places: F.when(test, F.struct(F.lit(level).alias("level"), text.cast("string").alias("text"), number.cast("string").alias("number"), *[(F.col(c) if c in places else none.cast(kept.schema[c].dataType)).alias(f"in_{c}") for c in ("chapter", "section", "article", "block", "clause_at", "point_at")]))
    inner = ("chapter", "section", "article", "block")
    nodes = F.array(
        at_level(0, is_article & F.col("chapter").isNotNull(), none, F.col("chapter"), "chapter"),
        at_level(1, is_article & F.col("section").isNotNull(), none, F.col("section"), "chapter", "section"),
        at_level(2, F.lit(True), F.when(~is_article, line), F.when(is_article, F.col("article")), *inner),
        at_level(3, F.col("clause_at").isNotNull(), F.when(is_clause, F.trim(F.regexp_extract("line", CLAUSE, 2))).otherwise(line), F.when(is_clause, F.col("clause")), *inner, "clause_at"),
        at_level(4, F.col("point_at").isNotNull(), F.when(is_point, F.trim(F.regexp_extract("line", POINT, 2))).otherwise(line), F.when(is_point, F.regexp_extract("line", POINT, 1)), *inner, "clause_at", "point_at"),
    )
    held = kept.select(doc, short, "ord", "line", "kind", "clause", "chapter_title", "section_title", F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("n"))
    held = held.select("*", "n.*").drop("n")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text"))))
    made = held.groupBy(doc, short, "level", "in_chapter", "in_section", "in_article", "in_block", "in_clause_at", "in_point_at").agg(
        F.min("ord").alias("at"), F.min("number").alias("number"), F.min("clause").alias("clause"), F.min(F.when(F.col("kind") == "article", F.col("line"))).alias("article_line"),
        F.min_by("chapter_title", "ord").alias("chapter_title"), F.min_by("section_title", "ord").alias("section_title"), F.trim(F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).alias("body"),
    )

    level, n = F.col("level"), F.col("number")
    of = lambda *values: F.element_at(F.array(*values), level + 1)
    word = lambda name, value: F.concat(F.lit(f"{name} "), value)
    chapter, section, article = word("Chương", F.col("in_chapter")), word("Mục", F.col("in_section")), word("Điều", F.col("in_article"))
    khoan, diem = word("Khoản", F.col("clause")), word("Điểm", n)
    chapter_key = F.concat(d, F.lit("::chuong-"), F.col("in_chapter"))
    section_key = F.concat(d, F.lit("::chuong-"), F.coalesce("in_chapter", F.lit("None")), F.lit("-muc-"), F.col("in_section"))
    article_key = F.concat(d, F.lit("::dieu-"), F.col("in_article"))
    clause_key = F.concat(article_key, F.lit("-khoan-"), F.col("clause"))
    article_label = F.concat_ws(" ", article, s)
    nothing = none.cast("string")
    out = made.select(
        d.alias("document"), of(*[F.lit(x) for x in ("chuong", "muc", "dieu", "khoan", "diem")]).alias("ptype"),
        of(chapter_key, section_key, article_key, clause_key, F.concat(clause_key, F.lit("-diem-"), n)).alias("key"),
        of(nothing, chapter_key, F.coalesce(section_key, chapter_key), article_key, clause_key).alias("parent_key"), n.alias("number"),
        of(F.concat(chapter, F.lit(". "), F.col("chapter_title")), F.concat(section, F.lit(". "), F.col("section_title")), F.col("article_line"), nothing, nothing).alias("heading"),
        F.when(level >= 2, F.col("body")).alias("body"),
        F.concat_ws(CRUMB, s, chapter, F.when(level >= 1, section), F.when(level >= 2, article), F.when(level >= 3, khoan), F.when(level == 4, diem)).alias("path"),
        of(F.concat_ws(" ", chapter, s), F.concat_ws(" ", section, word("Chương", F.coalesce("in_chapter", F.lit("None"))), s), article_label, F.concat_ws(" ", khoan, article_label), F.concat_ws(" ", diem, khoan, article_label)).alias("citation_label"),
        "at", level.alias("__level"),
    )
    # Five levels at most open at one place, so that place and level are one order.
    placed = written(out.withColumn("__at", F.col("at") * 8 + F.col("__level")).drop("at", "__level"))
    return scan.running(placed, ["document"], [scan.count("order_index", F.lit(True))], "__at", size).withColumn("order_index", (F.col("order_index") - 1).cast("int")).drop("__at")


def chunks(nodes: DataFrame, documents: DataFrame, summary_cap: int = 200, embed_cap: int = 1600) -> DataFrame:
    """A row for each clause with text, or for the whole of an article without clauses, under its article's heading.

    ``documents`` has number, summary, effective_from, effective_to and effectiveness (null: in force).
    """
    articles = nodes.where(F.col("ptype") == "dieu").select(F.col("document").alias("__doc"), F.col("key").alias("article_key"), F.trim(F.coalesce("heading", F.lit(""))).alias("__heading"), F.col("body").alias("__body"))
    clauses = nodes.where(F.col("ptype") == "khoan").select(F.col("parent_key").alias("__parent"), F.col("key").alias("__key"), F.col("body").alias("__clause"), F.col("order_index").alias("__order"))
    units = articles.join(clauses, F.col("article_key") == F.col("__parent"), "left")
    text = F.trim(F.coalesce(F.when(F.col("__key").isNotNull(), F.coalesce("__clause", F.lit(""))).otherwise(F.col("__body")), F.lit("")))
    named = documents.select(F.col("number").alias("__doc"), F.nullif(F.substring(F.trim(F.coalesce("summary", F.lit(""))), 1, summary_cap), F.lit("")).alias("sac_prefix"), "effective_from", "effective_to", F.coalesce("effectiveness", F.lit("con_hieu_luc")).alias("effectiveness"))
    rows = units.withColumn("__text", text).where(F.col("__text") != "").join(named, "__doc")
    body = F.concat_ws("\n", F.nullif(F.col("__heading"), F.lit("")), F.col("__text"))
    rows = rows.withColumn("body", body).withColumn("embed_text", F.substring(F.concat_ws("\n", "sac_prefix", "body"), 1, embed_cap))
    return rows.select(F.col("__doc").alias("document_number"), F.coalesce("__key", "article_key").alias("provision_key"), "article_key", "sac_prefix", "body", "embed_text", "effective_from", "effective_to", "effectiveness")


def with_parents(nodes: DataFrame, key: str = "key", parent_key: str = "parent_key", row_id: str = "id") -> DataFrame:
    """Parent ids of a tree by one left self join, whatever the order of rows; a missing parent is null."""
    parents = nodes.select(F.col(key).alias("__k"), F.col(row_id).alias("parent_id"))
    return nodes.join(parents, F.col(parent_key) == F.col("__k"), "left").drop("__k")


def chunk_rows(made: DataFrame, provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the ids of their provision, article and document instead of natural keys, and tokens for word search.

    ``provisions`` has id and key, ``documents`` id and number. A key without a row stays null, to be told by a check.
    """
    key = lambda df, natural, name: df.select(F.col(natural).alias(f"__{name}"), F.col("id").alias(name))
    out = made
    for df, natural, column, name in ((provisions, "key", "provision_key", "provision_id"), (provisions, "key", "article_key", "article_provision_id"), (documents, "number", "document_number", "document_id")):
        out = out.join(key(df, natural, name), F.col(column) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out.withColumn("tokens", word_list(F.col("embed_text"))).drop("provision_key", "article_key", "document_number")


def walk(nodes: DataFrame, key: str = "key", parent_key: str = "parent_key", name: str = "name") -> DataFrame:
    """(key, path, depth) of every node that a root reaches, to any depth and in a tree of any size. Roots have no parent.

    Pointers double: each node holds an ancestor and the names from below it down to itself, and in each round takes over
    its ancestor's ancestor and names, so a tree of depth d needs log2(d) rounds. A round is a written table, and it ends
    when no pointer moves. Nodes below a missing parent or on a cycle have no root and are left out (``unrooted`` tells
    them) before names are gathered, as those on a cycle would gather them without end. Keys are unique and not null.
    """
    loose = unrooted(nodes, key, parent_key).select(F.col("key").alias("__loose"))
    rooted = nodes.join(loose, F.col(key) == F.col("__loose"), "left_anti")
    return _doubled(rooted, key, parent_key, F.coalesce(F.col(name).cast("string"), F.lit(""))).where(F.col("up").isNull()).select("key", "path", "depth")


def unrooted(nodes: DataFrame, key: str = "key", parent_key: str = "parent_key") -> DataFrame:
    """(key, problem): nodes that no root reaches, as a ``parent`` is missing above them or they hang on a ``cycle``."""
    left = _doubled(nodes, key, parent_key).where(F.col("up").isNotNull())
    return left.select("key", F.when(F.col("ends"), "parent").otherwise("cycle").alias("problem"))


def _doubled(nodes: DataFrame, key: str, parent_key: str, name: Column | None = None) -> DataFrame:
    """(key, up, path, depth, ends): ``up`` is null where the root was reached, else the last ancestor found; ``ends`` where that one is missing.

    Depths double with each round as long as pointers move, so a depth beyond the number of nodes tells a cycle. Without
    a ``name`` there is no path. Ancestors are never broadcast: a written table is much smaller than its rows in memory.
    """
    now = written(nodes.select(F.col(key).alias("key"), F.col(parent_key).alias("up"), (F.lit(None).cast("string") if name is None else name).alias("path"), F.col(parent_key).isNotNull().cast("bigint").alias("depth"), F.lit(False).alias("ends")))
    most = now.count()
    while not now.where(F.col("up").isNotNull() & ~F.col("ends") & (F.col("depth") <= most)).isEmpty():
        above = now.select(F.col("key").alias("__key"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("depth").alias("__depth"), F.col("ends").alias("__ends"))
        moved = now.where(F.col("up").isNotNull() & ~F.col("ends")).join(above.hint("merge"), F.col("up") == F.col("__key"), "left")
        found = F.col("__key").isNotNull()
        stepped = moved.select(
            "key", F.when(found, F.col("__up")).otherwise(F.col("up")).alias("up"), F.when(found & (F.col("depth") <= most), F.concat("__path", F.lit(CRUMB), "path")).otherwise(F.col("path")).alias("path"),
            (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), (~found | F.col("__ends")).alias("ends"),
        )
        now = written(now.where(F.col("up").isNull() | F.col("ends")).unionByName(stepped))
    return now.withColumn("depth", F.col("depth").cast("int"))


def structural_counts(nodes: DataFrame) -> DataFrame:
    """(document, ptype, n): nodes of each kind, to be held against the expected numbers."""
    return nodes.groupBy("document", "ptype").agg(F.count(F.lit(1)).alias("n"))
