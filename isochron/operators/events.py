"""The verdict log: normalised events, summaries, the last lookup of each person with expiry, and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochron.functions import text
from isochron.sources.tables import VERDICTS

#: Whole messages that confirm, reject or doubt an answer.
PHRASES = {
    "correct": ("đúng", "dung", "chuẩn", "chuan", "chính xác", "chinh xac", "đúng rồi", "dung roi", "chuẩn rồi", "ok", "oke", "okie", "okay", "đúng vậy", "chuẩn luôn", "chính xác rồi"),
    "wrong": ("sai", "sai rồi", "sai roi", "không đúng", "ko đúng", "khong dung", "ko dung", "không chính xác", "sai bét", "sai rồi nhé"),
    "unsure": ("không chắc", "ko chắc", "khong chac", "chưa chắc", "chua chac", "không rõ", "khong ro", "chưa rõ", "chưa chắc chắn"),
}
#: Words that announce a correction.
CORRECTION_CUES = (
    "sai", "không phải", "ko phải", "khong phai", "phải là", "phai la", "đúng là", "dung la", "mã đúng", "ma dung", "hs đúng", "hs dung",
    "không đúng", "khong dung", "chỉnh lại", "chinh lai", "sửa lại", "sua lai", "nhầm", "nham", "không chính xác", "khong chinh xac",
)
#: Country codes that count as an origin where they stand alone in capitals.
ORIGIN_CODES = {"TQ": "CN", "CN": "CN", "JP": "JP", "KR": "KR", "AU": "AU", "NZ": "NZ", "TH": "TH", "MY": "MY", "SG": "SG", "ID": "ID", "PH": "PH", "DE": "DE", "EU": "EU", "GB": "GB", "UK": "GB", "US": "US", "VN": "VN"}
#: Unambiguous country names, in the order in which they are tried.
ORIGIN_NAMES = (
    ("trung quốc", "CN"), ("trung quoc", "CN"), ("china", "CN"), ("nhật bản", "JP"), ("nhật", "JP"), ("japan", "JP"), ("hàn quốc", "KR"), ("korea", "KR"),
    ("australia", "AU"), ("new zealand", "NZ"), ("thái lan", "TH"), ("thailand", "TH"), ("malaysia", "MY"), ("mã lai", "MY"), ("singapore", "SG"),
    ("indonesia", "ID"), ("philippines", "PH"), ("germany", "DE"), ("châu âu", "EU"), ("ấn độ", "IN"), ("india", "IN"), ("anh quốc", "GB"),
)
#: Words for an origin that a product's name is freed of once the origin is known, ambiguous ones too.
ORIGIN_WORDS = {
    "CN": ("trung quoc", "trung quốc", "tq", "tàu", "china", "cn"), "JP": ("nhat", "nhật", "nhật bản", "japan", "jp"), "KR": ("han", "hàn", "hàn quốc", "korea", "kr"),
    "AU": ("uc", "úc", "australia", "au"), "NZ": ("new zealand", "nz"), "TH": ("thai", "thái", "thái lan", "thailand", "th"), "MY": ("malaysia", "mã lai", "my"),
    "SG": ("singapore", "sg"), "ID": ("indonesia", "id"), "PH": ("phi", "philippines", "ph"), "DE": ("duc", "đức", "germany", "de"), "EU": ("châu âu", "eu"),
    "GB": ("anh", "gb"), "IN": ("ấn", "ấn độ", "india", "in"),
}
#: Words that are no part of a product's name.
FILLERS = ("nhập khẩu", "thuế suất", "hôm nay", "xuất xứ", "bao nhiêu", "là gì", "từ ", "nhập ", "thuế", "cái ", "con ", "chiếc ", "ngày", "giá", "mã hs", " hs ")
EXPIRY_SECONDS = 30 * 60


def normalised_events(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdict events ready to append, from hs, origin, day, schedule, verdict, staff, note, snapshot; ``problem`` names
    what is wrong with a row that can't be recorded. Columns of ``keep`` stay as they are."""
    code, staff = text.bare_code(F.col("hs")), F.trim("staff")
    problem = (
        F.when(~F.coalesce(code.rlike(r"^\d{8}$"), F.lit(False)), "hs")
        .when(F.col("day").try_cast("date").isNull(), "date")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(F.coalesce(staff, F.lit("")) == "", "staff")
    )
    return raw.select(
        *keep, code.alias("hs_code"), text.upper_or_null(F.col("origin")).alias("origin"), F.col("day").try_cast("date").alias("as_of_date"),
        F.nullif(F.trim("schedule"), F.lit("")).alias("schedule"), "verdict", F.substring(staff, 1, 64).alias("staff_name"),
        F.nullif(F.substring(F.trim("note"), 1, 1000), F.lit("")).alias("note"), F.col("snapshot").alias("response_snapshot"), problem.alias("problem"),
    )


def verdict_summary(log: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """Counts of each verdict by key, 0 where there is none."""
    return log.groupBy(*keys).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS])


def recent(log: DataFrame, keys: list[str], order: list[Column], k: int = 8) -> DataFrame:
    """The newest k events of each key, numbered."""
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def last_lookup(log: DataFrame, key: str, time: str, event_id: str, lookup: Column, seconds: int = EXPIRY_SECONDS) -> DataFrame:
    """Each event with ``prior``: the newest earlier lookup of its key, null if none or older than ``seconds``.

    By event time; the live form goes by the clock of its stream (see ``isochron.streaming.lookups``).
    """
    before = Window.partitionBy(key).orderBy(time, event_id).rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(lookup.isNotNull(), F.struct(lookup.alias("value"), F.col(time).alias("at")))
    seen = log.withColumn("__prior", F.last(marked, ignorenulls=True).over(before))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__prior.at").cast("timestamp"))
    return seen.withColumn("prior", F.when(gap <= seconds * 1_000_000, F.col("__prior.value"))).drop("__prior")


def _clean_message(message: Column) -> Column:
    return F.trim(F.rtrim(text.composed(F.lower(message), short=True), F.lit(".!,?… \t\n\x0b\f\r")))


def verdict_of(message: Column) -> Column:
    """The verdict of a message that is nothing but one of the phrases, else null."""
    # One lookup, so that the message is cleaned once; a chain of conditions cleans it for each.
    phrases = F.create_map(*[F.lit(x) for verdict, words in PHRASES.items() for w in words for x in (w, verdict)])
    return F.try_element_at(phrases, _clean_message(message))


def is_correction(message: Column) -> Column:
    """Whether a correcting word stands in a message as a whole word."""
    return text.composed(F.lower(message), short=True).rlike(r"(?u)(?<!\p{L})(" + "|".join(CORRECTION_CUES) + r")(?!\p{L})")


def code_in(message: Column) -> Column:
    """The first tariff code written 4-2-2 with dots, blanks or nothing between."""
    pattern = r"\d{4}[.\s]?\d{2}[.\s]?\d{2}"
    return F.when(message.rlike(pattern), F.regexp_replace(F.regexp_extract(message, pattern, 0), r"[.\s]", ""))


def origin_in(message: Column) -> Column:
    """The country a message names for sure: a capital code on its own, or an unambiguous name as whole words."""
    out, plain = F.lit(None).cast("string"), text.composed(F.lower(message))
    for name, code in reversed(ORIGIN_NAMES):
        out = F.when(plain.rlike(rf"(?u)(?<![\p{{L}}\d]){name}(?![\p{{L}}\d])"), code).otherwise(out)
    found = F.regexp_extract(message, "(?<![A-Za-z0-9])(" + "|".join(ORIGIN_CODES) + ")(?![A-Za-z0-9])", 1)
    codes = F.create_map(*[F.lit(x) for pair in ORIGIN_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.nullif(found, F.lit(""))), out)


def keyword_in(message: Column, origin: Column | None = None) -> Column:
    """What is left of a message as a product's name: without dates, fillers, punctuation and the names of ``origin``.

    Names go as whole words only, so that one inside another word stays. They go one after the other in their listed
    order, so of a longer name whose first word is listed before it the rest stays, as in "nhật bản".
    """
    dateless = left = F.regexp_replace(text.composed(F.lower(message)), r"\d{4}-\d{2}-\d{2}", " ")
    if origin is not None:
        for code, names in ORIGIN_WORDS.items():
            freed = dateless
            for name in names:
                freed = F.regexp_replace(freed, rf"(?u)(?<![\p{{L}}\d]){name}(?![\p{{L}}\d])", " ")
            left = F.when(origin == code, freed).otherwise(left)
    for filler in FILLERS:
        left = F.replace(left, F.lit(filler), F.lit(" "))
    return text.collapse(F.regexp_replace(left, "[?.,!:]", " "))


def corrections(messages: DataFrame, prior_code: str, prior_day: str, message: str, sender: str, today: str) -> DataFrame:
    """Log events that correcting messages give: the code at issue wrong, or, named again, correct; and the new code to look up."""
    fix = code_in(F.col(message))
    verdict = F.when(fix == F.col(prior_code), "correct").when(F.col(prior_code).isNotNull(), "wrong")
    found = messages.where(is_correction(F.col(message)))
    return found.select(F.col(prior_code).alias("hs"), F.coalesce(F.col(prior_day), F.lit(today)).alias("day"), verdict.alias("verdict"), F.col(sender).alias("staff"), F.substring(message, 1, 1000).alias("note"), F.when(fix.isNotNull() & ~fix.eqNullSafe(F.col(prior_code)), fix).alias("next_code"))


def answerable(messages: DataFrame, me: str, allowed: list[str] | None = None) -> DataFrame:
    """Messages to answer, from (sender, thread, is_group, message, mentions array of (uid, pos, len), has_image).

    Own messages go, and those of other threads where ``allowed`` names some. In groups only messages that mention ``me``
    count, and their mentions are cut out. What then has neither text nor image goes.
    """
    found = messages.where(F.col("sender") != me)
    if allowed:
        found = found.where(F.col("thread").isin(*allowed))
    mentions = F.coalesce("mentions", F.array().cast(messages.schema["mentions"].dataType))
    found = found.where(~F.col("is_group") | F.exists(mentions, lambda m: m["uid"] == me))
    spans = F.transform(mentions, lambda m: F.struct(m["pos"].alias("pos"), m["len"].alias("len")))
    left = F.when(F.col("is_group"), without_mentions(F.col("message"), spans)).otherwise(F.col("message"))
    return found.withColumn("message", F.coalesce(left, F.lit(""))).where(F.col("has_image") | (F.trim("message") != ""))


def first_finding(lists: DataFrame, keyword: str, tried: str) -> DataFrame:
    """Of several tries for a keyword (the phrase, then its words in order) the rows of the first that found any."""
    best = lists.groupBy(keyword).agg(F.min(tried).alias("__best"))
    return lists.join(best.withColumnRenamed(keyword, "__keyword"), (F.col(keyword) == F.col("__keyword")) & (F.col(tried) == F.col("__best"))).drop("__keyword", "__best")


def without_mentions(message: Column, mentions: Column) -> Column:
    """Cut the spans (pos, len) of mentions out of a message, the last first; spans outside the text are left alone."""
    order = F.reverse(F.array_sort(F.filter(mentions, lambda m: (m["pos"] >= 0) & (m["pos"] + m["len"] <= F.length(message)))))
    cut = F.aggregate(order, message, lambda s, m: F.concat(F.substring(s, F.lit(1), m["pos"].cast("int")), F.substring(s, (m["pos"] + m["len"] + 1).cast("int"), F.length(s))))
    return text.collapse(cut)


def merged_candidates(lists: DataFrame, key: str, source: str, place: str) -> DataFrame:
    """Candidates of several ordered lists, each key once, where it comes first."""
    first = lists.groupBy(key).agg(F.min(F.struct(source, place)).alias("__first"))
    return first.select(key, F.col(f"__first.{source}").alias(source), F.col(f"__first.{place}").alias(place)).orderBy(source, place)
