"""Small column builders used by every operator."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_null(c: Column) -> Column:
    """'' and any-case 'nan' are missing values."""
    text = F.trim(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def clean_permit(c: Column) -> Column:
    return F.upper(clean_null(c))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any literal term occurs in the text: one alternation, scanned once."""
    return text.rlike("|".join(re.escape(t) for t in terms))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the literal terms occur at least once."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])


def ends_with_any(text: Column, terms: Iterable[str]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(t) for t in terms) + ")$")


def words(c: Column) -> Column:
    """Whitespace-separated non-empty words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sorted_join(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(c), sep)


def join_present(parts: list[Column], sep: str) -> Column:
    """Join the non-null parts in order."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), sep)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def jaccard_or_half(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0.5 when either is empty or missing."""
    known = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(known, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.5)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def registry_date(c: Column) -> Column:
    """M/D/YYYY text to a date, NULL when it is not one."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")


def iso_to_registry_text(c: Column) -> Column:
    """YYYY-MM-DD text to M/D/YYYY, anything else unchanged."""
    parsed = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.date_format(parsed, "M/d/yyyy"), c)
