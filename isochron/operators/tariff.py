"""Point-in-time tariff answers: rates in force with their wording, notes, anti-dumping duties and searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.operators.temporal import asof_spread, live, valid_at
from isochron.sources.tables import TRADE_DIRECTIONS, ordinal

#: Codes of the schedules that are not preferential.
MFN, OUT_OF_QUOTA, SPECIAL = "NK_uu_dai", "NK_ngoai_han_ngach", "NK_uu_dai_98"
#: Wording of answers, in the language of the data.
EXCLUDED_TEXT = "Loại trừ khỏi biểu (không phải 0%)"
NOTE_QUOTA = "Hàng thuộc hạn ngạch thuế quan (TRQ): thuế suất phụ thuộc trạng thái hạn ngạch của nhà nhập khẩu; mức ngoài hạn ngạch nằm ở biểu riêng."
NOTE_EXCLUDED = "Dòng được đánh dấu loại trừ (*): KHÔNG phải 0% — hàng bị loại khỏi biểu này."
NOTE_SPECIAL = "Có mức thuế NK ưu đãi riêng tại Chương 98 (Mục II) áp dụng có điều kiện cho hàng đủ tiêu chí; đây là lựa chọn thay thế cho mức MFN Mục I, không phải mức mặc định."
NOTE_CERTIFICATE = "Mức ưu đãi FTA chỉ áp dụng khi có C/O hợp lệ đúng form; nếu không, áp mức MFN. Không có con số 0% vô điều kiện."
NOTE_NO_PREFERENCE = ("Chưa có biểu FTA nào được nạp khớp với xuất xứ ", " cho mã này; chỉ trả về MFN. (Các biểu FTA nạp ở bước sau.)")

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


class RateNotFound(LookupError):
    """No rate for the code on that day: a heading, a special line, or outside the data. Never a made-up number."""


def check_query(hs: str, day: str, origin: str | None) -> tuple[str, str, str | None]:
    """Normalised (code, day, origin), or ValueError."""
    code = (hs or "").replace(".", "").strip()
    if not re.fullmatch(r"\d{8}", code):
        raise ValueError("hs must be 8 digits")
    if not _DAY.fullmatch(day or ""):
        raise ValueError("date must be YYYY-MM-DD")
    return code, day, (origin or "").strip().upper() or None


def _money() -> Column:
    return F.concat(F.col("amount").cast("string"), F.lit(" "), F.col("amount_currency"), F.lit("/"), F.col("amount_unit"))


def rate_statement() -> Column:
    """A rate in words, by its type."""
    percent = F.concat(text.show_percent(F.col("rate_percent")), F.lit("%"))
    kind = F.col("rate_type")
    return (
        F.when(kind == "ad_valorem", percent)
        .when(kind == "specific", _money())
        .when(kind == "compound", F.concat(percent, F.lit(" + "), _money()))
        .when(kind == "excluded", F.lit(EXCLUDED_TEXT))
        .when(kind == "trq", F.concat(F.lit("Trong hạn ngạch "), percent, F.lit("; ngoài hạn ngạch xem biểu ngoài hạn ngạch")))
        .otherwise(F.lit(""))
    )


def preferential_statement(statement: Column, requires: Column, form: Column, mfn: Column) -> Column:
    """A preference holds with its certificate, else the MFN rate; one that needs none stands alone."""
    fallback = F.coalesce(F.concat(mfn, F.lit(" (MFN)")), F.lit("mức MFN"))
    named = F.coalesce(F.concat(F.lit(" form "), form), F.lit(""))
    return F.when(requires, F.concat(statement, F.lit(" nếu có C/O"), named, F.lit(" hợp lệ, ngược lại "), fallback)).otherwise(statement)


def duty_statement() -> Column:
    """An anti-dumping duty in words."""
    size = F.when(F.col("duty_kind") == "percent", F.concat(text.show_percent(F.col("rate_percent")), F.lit("%"))).otherwise(_money())
    return F.concat(F.lit("Chống bán phá giá "), size, F.lit(" (cộng thêm thuế NK), xuất xứ "), F.col("origin_country"))


def rates_in_force(rates: DataFrame, schedules: DataFrame, annexes: DataFrame, decrees: DataFrame, day: str) -> DataFrame:
    """Live rates on a day with their schedule, annex and decree: one pass over the facts, dimensions by key.

    Join sides small enough by the session's own threshold are broadcast by Spark; nothing here forces it.
    """
    facts = rates.where(live() & valid_at(day))
    s = schedules.select(F.col("id").alias("__s"), F.col("code").alias("schedule"), F.col("name").alias("schedule_name"), "fta_form", "requires_co")
    a = annexes.select(F.col("id").alias("__a"), F.col("code").alias("annex"), "trade_direction")
    d = decrees.select(F.col("id").alias("__d"), F.col("number").alias("decree"))
    joined = facts.join(s, F.col("schedule_id") == F.col("__s")).join(a, F.col("annex_id") == F.col("__a")).join(d, F.col("source_decree_id") == F.col("__d"))
    return joined.drop("__s", "__a", "__d").withColumn("statement", rate_statement()).withColumn("__direction", ordinal("trade_direction", TRADE_DIRECTIONS))


def anti_dumping(duties: DataFrame, day: str, origin: str | None = None) -> DataFrame:
    """Live duties on a day, of one origin if given, with their wording."""
    found = duties.where(live() & valid_at(day))
    if origin:
        found = found.where(F.col("origin_country") == origin)
    return found.withColumn("statement", duty_statement())


def _view(extra: list[Column] | None = None) -> Column:
    return F.struct(F.col("schedule"), F.col("schedule_name"), F.col("rate_type").alias("type"), F.col("rate_percent").alias("percent"), "amount", F.col("amount_currency").alias("currency"), F.col("amount_unit").alias("unit"), "decree", F.col("effective_from").cast("string").alias("effective_from"), F.col("effective_to").cast("string").alias("effective_to"), "statement", "fta_form", "requires_co", "conditions", *(extra or []))


def answers(in_force: DataFrame, goods: DataFrame, duties: DataFrame, origin: str | None, day: str) -> DataFrame:
    """One nested row for each code: import (mfn, preferential, out of quota, special), export, duties and notes.

    All codes are answered in one grouping; a lookup of one code filters ``in_force`` first.
    """
    importing = F.col("trade_direction") == "import"
    view = _view()
    is_pref = importing & ~F.col("schedule").isin(MFN, OUT_OF_QUOTA, SPECIAL)
    one = lambda test: F.min(F.when(test, F.struct(F.col("schedule").alias("__k"), F.col("id").alias("__i"), view.alias("v"))))["v"]
    many = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(F.col("schedule").alias("__k"), F.col("id").alias("__i"), view.alias("v"))))), lambda x: x["v"])
    flat = in_force.select("hs_code", "trade_direction", "id", "schedule", "schedule_name", "rate_type", "rate_percent", "amount", "amount_currency", "amount_unit", "decree", "effective_from", "effective_to", "statement", "fta_form", "requires_co", "conditions")
    grouped = flat.groupBy("hs_code").agg(
        one(importing & (F.col("schedule") == MFN)).alias("mfn"),
        one(importing & (F.col("schedule") == OUT_OF_QUOTA)).alias("out_of_quota"),
        many(importing & (F.col("schedule") == SPECIAL)).alias("chapter98"),
        many(is_pref).alias("preferential"),
        one(F.col("trade_direction") == "export").alias("export"),
    )
    worded = lambda column: F.transform(column, lambda p: p.withField("statement", preferential_statement(p["statement"], p["requires_co"], p["fta_form"], F.col("mfn.statement"))))
    grouped = grouped.withColumn("preferential", worded(F.col("preferential"))).withColumn("chapter98", worded(F.col("chapter98")))
    notes = F.array_compact(F.array(
        F.when(F.col("mfn.type") == "trq", F.lit(NOTE_QUOTA)),
        F.when(F.col("mfn.type") == "excluded", F.lit(NOTE_EXCLUDED)),
        F.when(F.size("chapter98") > 0, F.lit(NOTE_SPECIAL)),
        F.when(F.exists("preferential", lambda p: p["requires_co"]), F.lit(NOTE_CERTIFICATE)),
        F.when(F.lit(origin is not None) & (F.size("preferential") == 0), F.lit(f"{NOTE_NO_PREFERENCE[0]}{origin}{NOTE_NO_PREFERENCE[1]}")),
    ))
    duty = F.struct("origin_country", "exporter", "decision_number", F.col("duty_kind").alias("type"), F.col("rate_percent").alias("percent"), "amount", F.col("effective_from").cast("string").alias("effective_from"), F.col("effective_to").cast("string").alias("effective_to"), "statement")
    stacked = anti_dumping(duties, day, origin).groupBy("hs_code").agg(F.array_sort(F.collect_list(duty)).alias("anti_dumping"))
    named = goods.select("hs_code", F.struct("heading", "path").alias("goods"))
    joined = grouped.withColumn("notes", notes).join(named, "hs_code", "left").join(stacked, "hs_code", "left")
    imports = F.struct("mfn", "preferential", "out_of_quota", "chapter98").alias("import")
    return joined.select("hs_code", F.lit(origin).alias("origin"), F.lit(day).alias("day"), "goods", imports, "export", F.coalesce("anti_dumping", F.array()).alias("anti_dumping"), "notes")


def lookup(rates: DataFrame, schedules: DataFrame, annexes: DataFrame, decrees: DataFrame, goods: DataFrame, duties: DataFrame, hs: str, day: str, origin: str | None = None) -> DataFrame:
    """The answer for one code on one day; RateNotFound if nothing is in force. It runs here and once, as its one row tells."""
    code, day, origin = check_query(hs, day, origin)
    only = lambda df: df.where(F.col("hs_code") == code)
    found = answers(rates_in_force(only(rates), schedules, annexes, decrees, day), only(goods), only(duties), origin, day)
    rows = found.collect()
    if not rows:
        raise RateNotFound(f"no rate for {code} on {day}")
    return found.sparkSession.createDataFrame(rows, found.schema)


def current_mfn(rates: DataFrame, schedules: DataFrame, day: str) -> DataFrame:
    """(hs_code, mfn): the one MFN percent in force, the least id where data are dirty."""
    mfn = schedules.where(F.col("code") == MFN).select(F.col("id").alias("__s"))
    found = rates.where(live() & valid_at(day)).join(mfn, F.col("schedule_id") == F.col("__s"))
    return found.groupBy("hs_code").agg(F.min(F.struct("id", "rate_percent"))["rate_percent"].alias("mfn"))


def search_prefix(goods: DataFrame, mfn: DataFrame, prefix: str, limit: int = 25) -> DataFrame:
    """Codes that start with 4 to 8 digits, by code, with their MFN rate."""
    plain = re.sub(r"\D", "", prefix or "")
    if not 4 <= len(plain) <= 8:
        raise ValueError("a prefix has 4 to 8 digits")
    top = goods.where(F.col("hs_code").startswith(plain)).orderBy("hs_code").limit(limit)
    return top.join(mfn, "hs_code", "left").orderBy("hs_code")


def search_words(goods: DataFrame, mfn: DataFrame, words: str, limit: int = 25) -> DataFrame:
    """Codes whose path has the words whole: heading matches first, by their place, then by code."""
    plain = (words or "").strip()
    if len(plain) < 2:
        raise ValueError("a search has at least 2 characters")
    heading = F.coalesce(text.whole_word(F.col("heading"), plain), F.lit(False))
    ranked = goods.where(text.whole_word(F.col("path"), plain)).withColumns({"__class": F.when(heading, 0).otherwise(1), "__place": F.when(heading, text.position(F.col("heading"), plain)).otherwise(9999)})
    top = ranked.orderBy("__class", "__place", "hs_code").limit(limit)
    return top.join(mfn, "hs_code", "left").orderBy("__class", "__place", "hs_code").drop("__class", "__place")


def search(goods: DataFrame, mfn: DataFrame, words: str, prefix: str | None = None, limit: int = 25) -> DataFrame:
    """By prefix where it has 4 to 8 digits, else by words."""
    return search_prefix(goods, mfn, prefix, limit) if 4 <= len(re.sub(r"\D", "", prefix or "")) <= 8 else search_words(goods, mfn, words, limit)


def tally(cases: DataFrame, key: str, declared: Column, loaded: Column, tolerance: float = 0.001) -> DataFrame:
    """(key, matched, mismatched, not_loaded, percent): cases by how the declared value meets the loaded one.

    ``percent`` is the share of matches among cases that can be compared, to one decimal; null where none can be.
    """
    known = loaded.isNotNull()
    near = F.coalesce(F.abs(loaded - declared) < tolerance, F.lit(False))
    counted = cases.groupBy(key).agg(F.count_if(known & near).alias("matched"), F.count_if(known & ~near).alias("mismatched"), F.count_if(~known).alias("not_loaded"))
    return counted.withColumn("percent", F.round(100.0 * F.col("matched") / F.nullif(F.col("matched") + F.col("mismatched"), F.lit(0)), 1))


def candidate_line(code: Column, mfn: Column, path: Column, gap: str = " · ") -> Column:
    """A search result as one line: dotted code, MFN rate or a dash, and the last two crumbs of its path."""
    rate = F.coalesce(F.concat(text.show_percent(mfn), F.lit("%")), F.lit("—"))
    return F.concat(F.lit("• "), text.dotted_code(code), F.lit(f"{gap}MFN "), F.when(mfn.isNull(), F.lit("—")).otherwise(rate), F.lit(gap), text.path_tail(path))


def typed_rows(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """Loader rows with a rate, typed: a star is excluded, a code with an out-of-quota rate is a quota line."""
    codes = quota.select(F.col("hs").alias("__hs")).distinct().withColumn("__quota", F.lit(True))
    joined = rows.where(F.col("rate").isNotNull()).join(codes, F.col("hs") == F.col("__hs"), "left").drop("__hs")
    kind = F.when(F.col("rate") == "*", "excluded").when(F.col("__quota"), "trq").otherwise("ad_valorem")
    return joined.withColumn("rate_type", kind).withColumn("rate_percent", text.parse_percent(F.col("rate"))).drop("__quota")


def first_rows(rows: DataFrame, key: str, order: str, prefer: str | None = None) -> DataFrame:
    """The first row of each key by position; with ``prefer``, the first where that column is set, if any is."""
    names = [c for c in rows.columns if c != key]
    rank = F.struct(*([F.col(prefer).isNull().alias("__none")] if prefer else []), F.col(order).alias("__order"), F.struct(*names).alias("__row"))
    return rows.groupBy(key).agg(F.min(rank)["__row"].alias("__row")).select(key, "__row.*")


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests (hs, day, origin) with the normalised ``code``, ``as_of`` and ``from_origin``, and ``problem``: what
    ``check_query`` would refuse, hs before date, and days that no calendar has; null where it may be looked up."""
    code = text.bare_code(F.col("hs"))
    formed = F.coalesce(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    problem = F.when(~F.coalesce(code.rlike(r"^\d{8}$"), F.lit(False)), "hs").when(~formed | F.col("day").try_cast("date").isNull(), "date")
    return requests.withColumns({"code": code, "as_of": F.when(formed, F.col("day").try_cast("date")), "from_origin": text.upper_or_null(F.col("origin")), "problem": problem})


def request_outcomes(requests: DataFrame, rates: DataFrame, request_id: str) -> DataFrame:
    """Each request with ``outcome``: its problem, ``not_found`` where no live rate is in force for its code and day (an
    answer is never made up), or ``found`` with the number of rates."""
    checked = checked_requests(requests)
    asked = checked.where(F.col("problem").isNull()).select(request_id, F.col("code").alias("hs_code"), "as_of")
    in_force = asof_spread(asked, rates.where(live()).select("hs_code", "effective_from", "effective_to"), ["hs_code"], "as_of", "effective_from", "effective_to")
    counts = in_force.groupBy(request_id).agg(F.count(F.lit(1)).alias("n_rates"))
    told = checked.join(counts, request_id, "left")
    return told.withColumn("outcome", F.coalesce("problem", F.when(F.col("n_rates") > 0, "found"), F.lit("not_found"))).withColumn("n_rates", F.coalesce("n_rates", F.lit(0)).cast("bigint"))


def ordered_rates(in_force: DataFrame) -> DataFrame:
    """Rates in force with ``place`` among their code's: import before export, as the enum is declared, then by schedule."""
    return in_force.withColumn("place", F.row_number().over(Window.partitionBy("hs_code").orderBy("__direction", "schedule", "id")))


def candidate_messages(candidates: DataFrame, keyword: str, place: str, origin: str | None = None, first: int = 8) -> DataFrame:
    """(keyword, n, message): the chat's answer to a search, a line for each of the first candidates and how many are left.

    ``candidates`` has the keyword, hs_code, mfn, path and their place. Only the first rows of a keyword are put together.
    """
    order = Window.partitionBy(keyword).orderBy(place, "hs_code")
    told = candidates.select(keyword, "hs_code", candidate_line(F.col("hs_code"), F.col("mfn"), F.col("path"), "  ·  ").alias("line"), F.row_number().over(order).alias("rn"))
    counts = candidates.groupBy(keyword).agg(F.count(F.lit(1)).alias("n"))
    shown = told.where(F.col("rn") <= first).groupBy(keyword).agg(F.array_sort(F.collect_list(F.struct("rn", "hs_code", "line"))).alias("rows"))
    both = shown.join(counts, keyword)
    head = F.concat(F.lit('🔎 "'), F.col(keyword).cast("string"), F.lit('"' + (f" · xuất xứ {origin}" if origin else "") + " — "), F.col("n").cast("string"), F.lit(" mã phù hợp. Nhắn MÃ" + ("" if origin else " kèm xuất xứ") + " để xem thuế đầy đủ:"))
    more = F.when(F.col("n") > first, F.concat(F.lit("…và "), (F.col("n") - first).cast("string"), F.lit(" mã nữa — gõ cụ thể hơn để thu hẹp.")))
    example = F.concat(F.lit('Ví dụ: "'), text.dotted_code(F.col("rows")[0]["hs_code"]), F.lit(f' {origin or "TQ"}".'))
    return both.select(keyword, "n", F.concat_ws("\n", head, F.transform("rows", lambda r: r["line"]), more, example).alias("message"))


def quoted(citations: DataFrame, answer: str, place: str, first: int = 3, cap: int = 480) -> DataFrame:
    """(answer, quotes): the first citations of an answer as quoted lines, white space collapsed and long texts cut.

    ``citations`` has label, body, effectiveness, effective_from and effective_to beside the answer and the place.
    """
    cut = text.ellipsis(text.collapse(F.coalesce("body", F.lit(""))), cap)
    stale = F.when(F.col("effectiveness") != "con_hieu_luc", F.concat(F.lit(" ⚠️ "), "effectiveness"))
    since = F.when(F.col("effective_from").isNotNull(), F.concat(F.lit(" · hiệu lực từ "), F.col("effective_from").cast("string"), F.coalesce(F.concat(F.lit("→"), F.col("effective_to").cast("string")), F.lit(""))))
    line = F.concat(F.lit("📖 "), "label", F.coalesce(stale, F.lit("")), F.coalesce(since, F.lit("")), F.lit("\n“"), cut, F.lit("”"))
    ranked = citations.withColumn("rn", F.row_number().over(Window.partitionBy(answer).orderBy(place))).where(F.col("rn") <= first)
    return ranked.groupBy(answer).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda r: r["line"]), "\n").alias("quotes"))
