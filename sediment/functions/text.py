"""Text rules as column expressions; white space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import PLACEHOLDERS, REFERENCE_ONLY


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def tidy(text: Column) -> Column:
    """One line-end style, single blanks inside lines, trimmed lines, at most one empty line in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+", " ")
    t = F.regexp_replace(t, r"(?m)^ +| +$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def meaningful(text: Column) -> Column:
    return F.coalesce(~F.lower(strip(text)).isin(*PLACEHOLDERS), F.lit(False))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def byte_count(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def is_reference_only(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" ."))).isin(*REFERENCE_ONLY)


def header(section: Column) -> Column:
    return F.concat(F.upper(F.translate(section, "_", " ")), F.lit("\n"))


def pointer(index: Column, field: Column) -> Column:
    """RFC 6901 pointer to a field of a hit."""
    escaped = F.replace(F.replace(field, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(F.lit("/hits/hits/"), index.cast("string"), F.lit("/_source/"), escaped)


def uuid_of(sha: Column) -> Column:
    return F.regexp_replace(F.substring(sha, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9]+\z"), F.lit(False))


def broken_quote(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)(?<!\w)quot\w|\wquot(?!\w)"), F.lit(False))


def iso_date(text: Column) -> Column:
    """A date from a calendar day or from a week and its day (Monday, if none is named), with hyphens or without."""
    digits = F.regexp_replace(text, "[-W]", "")
    year, week = F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 2).try_cast("int")
    weekday = F.coalesce(F.substring(digits, 7, 1).try_cast("int"), F.lit(1))
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), 7 * (week - 1))  # January 4 lies in week 1
    by_week = F.when((week > 0) & (F.weekofyear(monday) == week), F.date_add(monday, weekday - 1))
    found = F.when(text.rlike(r"\A\d{4}(-?)\d{2}\1\d{2}\z"), F.try_to_date(digits, "yyyyMMdd")).when(text.rlike(r"\A\d{4}(-W\d{2}(-[1-7])?|W\d{2}[1-7]?)\z"), by_week)
    return F.when((year > 0) & (F.year(found) < 10000), found)


def display_date(text: Column) -> Column:
    """A date from an ISO timestamp, or from month, day and year words of the usual date print."""
    words = F.split(strip(text), r"(?U)\s+")
    spelled = F.concat_ws(" ", F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(2)), F.try_element_at(words, F.lit(3)))
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}([ T]|\z)"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).otherwise(F.try_to_date(spelled, "yyyy MMM d"))
