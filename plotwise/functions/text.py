"""Text cleaning as column expressions: placeholders, money, identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for a missing value: fixed values.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "tbd", "unknown", "(unknown)", "not available", "not applicable", "#n/a", "?", ".")


def missing(c: Column) -> Column:
    """Null, or NaN for floating numbers."""
    return c.isNull() | (c.cast("string") == "NaN")


def without_placeholders(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS, *extra), F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean(c: Column) -> Column:
    """Trimmed text; empty for null and for the text ``nan``."""
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "nan"), "").otherwise(F.trim(c))


def sentinel_to_null(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin("(unknown)", "unknown", ""), F.trim(c))


def date_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def web_url(c: Column) -> Column:
    """The URL if its scheme is http or https."""
    return F.when(F.lower(c).rlike(r"^https?://"), c)


def number(c: Column) -> Column:
    return c.try_cast("double")


def money(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[$,]", "").try_cast("double")


def money_text(c: Column) -> Column:
    """Whole amounts without decimals, others as they are."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def dashed(c: Column, width: int = 9) -> Column:
    """Groups of three digits, padded on the left; longer ones stay as they are."""
    d = F.when(F.length(digits(c)) < width, F.lpad(digits(c), width, "0")).otherwise(digits(c))
    return F.when(F.length(d) == width, F.concat_ws("-", *(F.substring(d, k, 3) for k in range(1, width, 3)))).otherwise(d)


def padded(c: Column, width: int = 8) -> Column:
    """Zeros on the left; unlike ``lpad`` it cuts nothing off."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def holds_all(text: Column, query: str) -> Column:
    """Every blank-separated term of the query occurs in the text."""
    found = F.lit(True)
    for term in query.lower().split():
        found = found & F.contains(F.lower(text), F.lit(term))
    return found


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def escaped_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def escaped_html(c: Column) -> Column:
    """Text for markup; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def thousands(c: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(c, 0)


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are one but for case, blanks and signs."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return key(a) == key(b)
