"""Dates known in part: year, month or day; as text, never cast to a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phyllary.functions.text import text


def _padded(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """yyyy, yyyy-mm or yyyy-mm-dd, as far as the parts go without a gap; "" without a year."""
    y, m, d = (F.trim(text(c)) for c in (year, month, day))
    return F.when(y == "", "").when(m == "", y).when(d == "", F.concat_ws("-", y, _padded(m))).otherwise(F.concat_ws("-", y, _padded(m), _padded(d)))


def epoch_date(millis: Column) -> Column:
    """The UTC day of milliseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int")).cast("string")


def date_from_any(primary: Column, year: Column, month: Column, day: Column) -> Column:
    """The primary text unless it is blank or a whole number of six digits or more; then the parts' date; then that number as
    milliseconds since 1970."""
    parts, p = date_from_parts(year, month, day), F.trim(text(primary))
    number = p.rlike(r"^-?\d{6,}$")
    return F.when((p != "") & ~number, p).when(parts != "", parts).otherwise(F.when(number, F.coalesce(epoch_date(p.try_cast("long")), p)).otherwise(""))
