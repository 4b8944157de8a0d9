"""Typed reads, parameter keys and redaction as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"

# fixed values: what is redacted in persisted messages, and how much of them is kept
REDACTIONS = (
    r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|bearer|authorization|client[_-]?secret)\s*[:=]\s*\S+",
    r"(?i)\b(?:mysql|mysqli|pgsql|postgres(?:ql)?|sqlsrv|oci|sqlite|jdbc):[^\s]+",
)
REDACTED = "[REDACTED]"
KEPT_CHARACTERS = 4000
TRUNCATED = "…[truncated]"


def is_numeric(text: Column) -> Column:
    """A decimal number with optional sign, fraction, exponent and blanks around it; no NaN, infinity or hex."""
    return F.coalesce(text.rlike(NUMERIC), F.lit(False))


def read_double(text: Column, strict: bool = False) -> Column:
    """The number, else null, or an error if strict."""
    other = F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(is_numeric(text), F.trim(F.regexp_replace(text, r"[\t\n\r\x0B\f]", " ")).try_cast("double")).otherwise(other)


def read_long(text: Column, strict: bool = False) -> Column:
    """The number cut to an integer. Plain digits don't pass through a double."""
    whole = F.trim(text).try_cast("bigint")
    number = read_double(text, strict)
    cut = F.when(F.abs(number) < 2.0**63, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$") & whole.isNotNull(), whole).otherwise(cut)


def read_boolean(text: Column) -> Column:
    """true, 1, yes and on in any case are true; all else, null too, is false."""
    return F.coalesce(F.lower(text).isin("true", "1", "yes", "on"), F.lit(False))


def read_date(text: Column, pattern: str = "yyyy-MM-dd", strict: bool = False) -> Column:
    """The date by pattern, without a time of day; else null, or an error if strict."""
    day = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    return F.when(day.isNotNull() | text.isNull(), day).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")) if strict else day


def job_key(names: Sequence[str]) -> Column:
    """SHA-256 of the sorted name=value pairs of a row's columns, joined by commas; a null is ''."""
    pairs = F.array(*(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names))
    return F.sha2(F.array_join(F.sort_array(pairs), ","), 256)


def job_key_of(pairs: Column) -> Column:
    """The same from an array of name=value texts, as an aggregate may collect it."""
    return F.sha2(F.array_join(F.sort_array(pairs), ","), 256)


def redact(text: Column) -> Column:
    """Secrets and connection strings replaced, the rest cut at KEPT_CHARACTERS; null stays null."""
    # every pattern needs one of these characters
    given, needed = text, text.contains(":") | text.contains("=")
    for pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, REDACTED)
    text = F.when(needed, text).otherwise(given)
    return F.when(F.char_length(text) > KEPT_CHARACTERS, F.concat(F.substring(text, 1, KEPT_CHARACTERS), F.lit(TRUNCATED))).otherwise(text)
