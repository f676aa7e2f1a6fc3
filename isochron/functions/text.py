"""Column functions for codes, words, percents and dates in text."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words left out of keyword queries.
STOP_WORDS = (
    "của", "và", "các", "có", "là", "được", "cho", "trong", "khi", "nào", "gì", "thì",
    "một", "những", "về", "theo", "đối", "với", "hay", "hoặc", "này", "đó", "tại", "ra",
    "từ", "đến", "bao", "nhiêu", "như", "thế", "bị", "sẽ", "đã",
)


def bare_code(code: Column) -> Column:
    """Dots and blanks off a tariff code."""
    return F.trim(F.replace(code, F.lit("."), F.lit("")))


def dotted_code(code: Column) -> Column:
    """Eight digits as 4.2.2."""
    return F.regexp_replace(code, r"^(\d{4})(\d{2})(\d{2})$", "$1.$2.$3")


def digits(text: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(text, r"\D", "")


def upper_or_null(text: Column) -> Column:
    """Trimmed upper case; blank is null."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def parse_percent(text: Column) -> Column:
    """A percent with a decimal comma or point, and perhaps a percent sign; anything else is null."""
    plain = F.trim(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit("%"), F.lit("")))
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain).try_cast("decimal(7,4)")


def show_percent(value: Column) -> Column:
    """A decimal without trailing zeros; null is 0."""
    text = value.cast("string")
    return F.coalesce(F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text), F.lit("0"))


@F.udf(T.StringType(), useArrow=False)
def _composed(text):
    """Unicode NFC; Spark has no such function. Texts go to Python by the hundred, as an Arrow batch holds ten thousand of
    them whatever their length."""
    return None if text is None else unicodedata.normalize("NFC", text)


@F.arrow_udf(T.StringType())
def _composed_messages(texts: pa.Array) -> pa.Array:
    """The same for short texts, a whole Arrow batch at once; most hold nulls only. Arrow's own NFC leaves marks apart."""
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], texts.type)


def composed(text: Column, short: bool = False) -> Column:
    """Unicode NFC: letters and their marks, as phones and some converters write them apart, put together. Only texts with
    such marks go through Python; ``short`` ones, as messages are, by the Arrow batch and not row by row."""
    apart = text.rlike(r"\p{M}")
    return F.coalesce((_composed_messages if short else _composed)(F.when(apart, text)), text)


def search_terms(text: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 2) -> Column:
    """Distinct lower-case words of letters and digits, in order, without short ones and stop words."""
    found = word_list(text)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop)) if stop else F.filter(found, lambda w: F.length(w) >= least))


def word_list(text: Column) -> Column:
    """All lower-case words of letters and digits, in order and with repeats, composed; diacritics stay, also those that no
    composed letter has."""
    return F.array_remove(F.split(F.regexp_replace(composed(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{M}\p{N}\s]", " "), r"\s+"), "")


def query_terms(text: str, stop: tuple[str, ...] = STOP_WORDS, least: int = 2) -> list[str]:
    """``search_terms`` of one query."""
    plain = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in unicodedata.normalize("NFC", text.lower()))
    return list(dict.fromkeys(w for w in plain.split() if len(w) >= least and w not in stop))


def whole_word(text: Column, words: str) -> Column:
    """Whether ``words`` stand in the text between word edges, whatever the case; Unicode letters and digits are words."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(words)}(?![\p{{L}}\p{{N}}_])")


def position(text: Column, words: str) -> Column:
    """First place of ``words`` in the text, from 1, ignoring case; 0 if nowhere."""
    return F.locate(words.lower(), F.lower(text))


def as_of_date(text: Column) -> Column:
    """The date that a question names: ISO, day-month-year in words, with slashes, or a year (its last day); else null."""
    pad = lambda n: F.lpad(n, 2, "0")
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    iso = r"\b(\d{4}-\d{2}-\d{2})\b"
    spoken = r"(?iu)\bng[àa]y\s+(\d{1,2})\s+th[áa]ng\s+(\d{1,2})\s+n[ăa]m\s+(\d{4})\b"
    slashed = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    year = r"(?iu)\bn[ăa]m\s+(\d{4})\b"
    join = lambda p: F.when(part(p, 3).isNotNull(), F.concat_ws("-", part(p, 3), pad(part(p, 2)), pad(part(p, 1))))
    return F.coalesce(part(iso, 1), join(spoken), join(slashed), F.concat(part(year, 1), F.lit("-12-31")))


def vector_literal(vector: Column) -> Column:
    """A vector as the bracketed list that a database takes; null stays null."""
    return F.when(vector.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")))


def parse_vector(literal: Column) -> Column:
    """The inverse; anything but a bracketed list of numbers is null."""
    return F.when(literal.rlike(r"^\[[-+0-9.eE, ]*\]$"), F.from_json(literal, "array<float>"))


def collapse(text: Column) -> Column:
    """White space runs to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ellipsis(text: Column, n: int) -> Column:
    """At most n characters, and an ellipsis where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def path_tail(path: Column, n: int = 2, mark: str = " › ") -> Column:
    """The last n crumbs of a path."""
    crumbs = F.split(path, re.escape(mark))
    return F.concat_ws(mark, F.slice(crumbs, F.greatest(F.size(crumbs) - (n - 1), F.lit(1)), F.lit(n)))


def last_cell(text: Column, mark: str = "|") -> Column:
    """The last cell of a row written with separators, trimmed."""
    return F.trim(F.element_at(F.split(text, re.escape(mark)), -1))


def dash_depth(text: Column) -> Column:
    """Leading dashes of a nomenclature line."""
    return F.length(F.regexp_replace(F.regexp_extract(text, r"^((?:-\s*)*)", 1), r"\s", ""))


def undashed(text: Column) -> Column:
    """A nomenclature line without its dashes and closing colon."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"^(?:-\s*)*", "")), r":+$", ""))


def unescape_html(text: Column) -> Column:
    """The five entities of markup back to characters, the ampersand last."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def escape_html(text: Column) -> Column:
    """The inverse, the ampersand first."""
    for entity, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def first_object(text: Column) -> Column:
    """From the first brace to the last one, as JSON; null without braces."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
