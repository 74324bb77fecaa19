"""Column functions for the text fields of official files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words the official files use.
YES_WORDS = ["Y", "YES", "1", "TRUE", "해당", "예"]
NO_WORDS = ["N", "NO", "0", "FALSE", "미해당", "아니오"]
COMMON_WORDS = ["보통주", "common", "common stock"]
PREFERRED_WORDS = ["우선주", "preferred", "preferred stock"]


def clean(col: Column) -> Column:
    """Trimmed text, empty when missing."""
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def blank_to_null(col: Column) -> Column:
    return F.nullif(clean(col), F.lit(""))


def pad_code(col: Column) -> Column:
    """Six-character code: a trailing ``.0`` is dropped, zeroes are added, nothing is cut off."""
    raw = clean(col)
    text = F.when(raw.endswith(".0"), F.regexp_replace(raw, r"^([0-9]+)\.0$", "$1")).otherwise(raw)
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def pad_code_or_blank(col: Column) -> Column:
    """As :func:`pad_code`, but a missing code stays empty."""
    return F.when(clean(col) == "", F.lit("")).otherwise(pad_code(col))


def market_name(col: Column) -> Column:
    """Upper-case market with the sub-markets of the two exchanges folded in."""
    text = F.upper(clean(col))
    return F.when(text.startswith("KOSPI"), "KOSPI").when(text.startswith("KOSDAQ"), "KOSDAQ").otherwise(text)


def number(col: Column) -> Column:
    """Finite double from text with thousands commas; anything else becomes null."""
    value = F.translate(clean(col), ",", "").try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


#: Decimals of an amount; 28 digits are left before the point.
AMOUNT_SCALE = 10


def amount(col: Column) -> Column:
    """Exact decimal from text with thousands commas; anything else becomes null.

    So does an amount with more decimals than ``AMOUNT_SCALE``, trailing zeroes aside: it is refused rather than rounded, for two
    different amounts must never become one.
    """
    text = F.translate(clean(col), ",", "")
    decimals = F.length(F.regexp_extract(text, r"\.(\d*?)0*([eE].*)?$", 1))
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    # Casting empty text would raise and catch an error for each row.
    return F.when((text != "") & (decimals - power <= AMOUNT_SCALE), text.try_cast(f"decimal(38,{AMOUNT_SCALE})"))


def parse_date(col: Column) -> Column:
    """Date from ``yyyyMMdd``, ``yyyy-MM-dd`` or ``yyyy/MM/dd``; anything else becomes null.

    The digits are put in ISO order and cast: trying formats one after another is slow on rows that need the last.
    """
    digits = F.regexp_extract(clean(col), r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})$", 1)
    plain = F.translate(digits, "-/", "")
    iso = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    return iso.try_cast("date")


def flag(col: Column) -> Column:
    """True / false for the yes and no words, null for anything else."""
    text = F.upper(clean(col))
    return F.when(text.isin(YES_WORDS), True).when(text.isin(NO_WORDS), False)


def security_kind(col: Column, *, funds: bool = False) -> Column:
    """common / preferred / spac / reit / unknown; with ``funds`` also etf and etn."""
    text = F.lower(clean(col))
    kind = (
        F.when(text.isin(COMMON_WORDS), "common")
        .when(text.isin(PREFERRED_WORDS), "preferred")
        .when(text.contains("스팩") | (text == "spac"), "spac")
        .when(text.contains("리츠") | (text == "reit"), "reit")
    )
    if funds:
        kind = kind.when(text == "etf", "etf").when(text == "etn", "etn")
    return kind.otherwise("unknown")


def finite(col: Column) -> Column:
    """Not null, not NaN and not infinite."""
    value = col.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def has_offset(col: Column) -> Column:
    """ISO timestamp text that names its offset from UTC."""
    return clean(col).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")


def offset_timestamp(col: Column) -> Column:
    """Instant of an ISO text with an offset, null when the offset is missing."""
    return F.when(has_offset(col), F.replace(clean(col), F.lit("T"), F.lit(" ")).try_cast("timestamp"))


def clock_text(col: Column) -> Column:
    """24-hour ``HH:MM``."""
    return clean(col).rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
