"""Timestamps in mixed formats and zones, made one unambiguous form (problem 2)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta
from functools import lru_cache
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.dates import EPOCH, SHARED_ZONES, read_date, zone_intervals
from phyllary.functions.vectorised import vectorised

#: Years with intervals of their own; local times outside them take the nearest of these years.
FIRST_YEAR, LAST_YEAR = 1900, 2100


@vectorised("struct<normal:string,local_s:long,zone:string>")
def _readings(text: pd.Series, order: pd.Series) -> pd.DataFrame:
    memo: dict = {}
    rows = []
    for key in zip(text, order, strict=True):
        r = memo.get(key)
        if r is None:
            r = memo[key] = read_date(*key)
        rows.append(r)
    out = pd.DataFrame(rows, columns=["normal", "local_s", "zone"])
    out["local_s"] = out["local_s"].astype("Int64")
    return out


@lru_cache(1024)
def _zone_years(zone: str) -> tuple:
    """(zone, year, intervals): for each year the offset intervals that touch it or the days beside it, in local seconds."""
    spans = [(a + off, b + off, off) for a, b, off in zone_intervals(zone, FIRST_YEAR, LAST_YEAR)]
    rows = []
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        a = int((EPOCH.replace(year=year) - EPOCH + timedelta(days=-2)).total_seconds()) if year > FIRST_YEAR else -(1 << 60)
        b = int((EPOCH.replace(year=year + 1) - EPOCH + timedelta(days=2)).total_seconds()) if year < LAST_YEAR else 1 << 60
        rows.append((zone, year, [(s, e, off) for s, e, off in spans if s < b and e > a]))
    return tuple(rows)


def zone_year_table(spark: SparkSession, zones: Iterable[str]) -> DataFrame:
    """The offset intervals of the zones exploded by year: zone, year, intervals. Bounded by the zone database: 201 rows a zone."""
    known = available_timezones()
    rows = [r for z in sorted(set(zones) & known) for r in _zone_years(z)]
    return spark.createDataFrame(rows, "zone string, year int, intervals array<struct<s:long,e:long,off:int>>")


def local_to_utc(local_s: Column, intervals: Column) -> tuple[Column, Column]:
    """(UTC seconds, status): one interval that holds the local time gives the offset (unique), two an ambiguous time whose earlier
    instant is taken, none a nonexistent time that takes the offset before the change."""
    hits = F.filter(intervals, lambda i: (i["s"] <= local_s) & (local_s < i["e"]))
    before = F.filter(intervals, lambda i: i["e"] <= local_s)
    # intervals are in order of time: the last that has ended is the one before the change
    off = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda i: i["off"]))).otherwise(F.get(before, F.size(before) - 1)["off"])
    status = F.when(F.size(hits) == 1, "unique").when(F.size(hits) > 1, "ambiguous").otherwise("nonexistent")
    return local_s - off, status


def _day_of(seconds: Column) -> Column:
    """The day of the seconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def normalise_times(df: DataFrame, text: str, order: str | None = None, zone: str | None = None) -> DataFrame:
    """df with normal_text (null if no possible date can be read) and time_status (date, instant, assumed, unique, ambiguous, nonexistent,
    no_zone, none). assumed is an instant whose zone is an abbreviation that other zones share: it has its usual offset.

    order and zone name columns with the date order and IANA zone of each row's source; null zones leave local times unread (no_zone).
    Null, blank and very long texts give null; repeated rows stay rows; columns of df are kept, also such as are named like the new ones
    (those are replaced). An empty df gives an empty result.
    """
    spark = df.sparkSession
    named = df.select(F.regexp_extract(F.col(text), r"(?<![A-Za-z_])([A-Z][A-Za-z_]++/[A-Za-z0-9_/+-]++)", 1).alias("z")).where("z <> ''").distinct()
    if zone:
        named = named.union(df.select(F.col(zone)).where(F.col(zone).isNotNull()).distinct()).distinct()
    known = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "z string")
    # at most as many names as the zone database has
    zones = [r[0] for r in named.join(F.broadcast(known), "z", "left_semi").collect()]
    table = F.broadcast(zone_year_table(spark, zones))
    read = df.withColumn("__r", _readings(F.col(text), F.col(order) if order else F.lit(None).cast("string")))
    own = F.col(zone) if zone else F.lit(None).cast("string")
    read = read.withColumn("__z", F.when(F.col("__r.zone") == "", own).otherwise(F.col("__r.zone")))
    year = F.least(F.greatest(F.year(_day_of(F.col("__r.local_s"))), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR))
    joined = read.withColumn("__y", year).join(table.select(F.col("zone").alias("__tz"), F.col("year").alias("__ty"), F.col("intervals").alias("__iv")), (F.col("__z") == F.col("__tz")) & (F.col("__y") == F.col("__ty")), "left")
    utc, status = local_to_utc(F.col("__r.local_s"), F.col("__iv"))
    rest = F.pmod(utc, F.lit(86400))
    solved = F.concat(_day_of(utc).cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60))
    normal = F.coalesce(F.col("__r.normal"), F.when(F.col("__iv").isNotNull(), solved))
    shared = rf"\d\s*(?i:[ap]\.?m\.?\s*)?(?:{'|'.join(SHARED_ZONES)})\s*$"
    how = (
        F.when(F.col("__r.normal").isNotNull(), F.when(F.col("__r.normal").endswith("Z"), F.when(F.col(text).rlike(shared), "assumed").otherwise("instant")).otherwise("date"))
        .when(F.col("__r.local_s").isNull(), "none")
        .when(F.col("__iv").isNull(), "no_zone")
        .otherwise(status)
    )
    return joined.withColumn("normal_text", normal).withColumn("time_status", how).drop("__r", "__z", "__y", "__tz", "__ty", "__iv")
