"""Column functions of the cleansing layer; all but one stay inside the JVM."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks of restricted text, applied in this order, and their tokens.
MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "[IP]"),
    (r"(?i)\b(password|passwd|pwd|secret|api[_-]?key|token)(\s*[=:]\s*['\"]?)[^\s'\"<&]{4,}", "$1$2[SECRET]"),
    (r"(?i)\b(jdbc:[a-z0-9]+://|mongodb(?:\+srv)?://|postgres(?:ql)?://|mysql://)[^\s'\"<]+", "$1[CONNECTION]"),
)
MASK_TOKEN = r"\[(?:EMAIL|IP|SECRET|CONNECTION)\]"
# Upper bounds and names of the reputation bands.
BANDS = ((100, "under 100"), (1000, "100 to 999"), (10000, "1,000 to 9,999"))
LAST_BAND, NO_BAND = "10,000 or more", "unknown"


def decoded(text: Column) -> Column:
    """Character references decoded, in Arrow batches; texts without an ampersand never leave the JVM's result."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)

    return F.pandas_udf(run, "string")(text)


def masked(text: Column) -> Column:
    for pattern, token in MASKS:
        text = F.regexp_replace(text, pattern, token)
    return text


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("int")


def slug(text: Column) -> Column:
    """``Needs details!`` -> ``needs_details``; null stays null."""
    return F.trim(F.lower(F.regexp_replace(F.trim(text), "[^A-Za-z0-9]+", "_")), F.lit("_"))


def pseudonym(identifier: Column, salt: str) -> Column:
    """Salted SHA-256 of an id; null stays null."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), identifier.cast("string")), 256)


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the values of ``columns``; two rows hash alike iff their JSON without nulls is alike."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def fingerprint_part(columns: Sequence[str]) -> Column:
    """Part of an order-independent table checksum; its sum over rows is the checksum."""
    return F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("decimal(38,0)")


def utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("bigint"))


def hours_between(start: Column, end: Column) -> Column:
    """Hours at second precision; null if either side is."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(3600.0)


def date_key(at: Column) -> Column:
    """yyyyMMdd as an integer."""
    return (F.year(at) * 10000 + F.month(at) * 100 + F.dayofmonth(at)).cast("int")


def month_of(at: Column) -> Column:
    return F.trunc(at, "month")


def band(value: Column) -> Column:
    chain = F.when(value.isNull(), NO_BAND)
    for bound, name in BANDS:
        chain = chain.when(value < bound, name)
    return chain.otherwise(LAST_BAND)


def safe_column_name(name: str) -> str:
    """A column name out of any JSON key."""
    return re.sub(r"[^\w]", "_", name).strip("_").lower() or "unnamed_column"

