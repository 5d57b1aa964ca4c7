"""Records of one specimen merged: field by field, the first filled one in the order of the records' priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.text import text, type_token
from phyllary.operators.identity import event_key, identity_key, with_codes
from phyllary.schema import RECORD_FIELDS

#: Fields that stay those of the record with the highest priority.
BASE_ONLY = ["source", "source_record_id", "source_record_url", "download_url", "local_image_path", "image_sha256", "download_status", "notes"]
#: Fields that the merge itself writes.
WRITTEN = ["physical_specimen_key", "collection_event_key", "merged_from_sources", "merged_record_count"]


def priority(order: str) -> Column:
    """A record's rank in its group, greatest first: names a type, has an image, has coordinates, length of its main texts; then the
    earlier one."""
    return F.struct(
        (type_token("type_status") != "").alias("a"),
        (text("image_url") != "").alias("b"),
        ((text("decimal_latitude") != "") & (text("decimal_longitude") != "")).alias("c"),
        (F.length(text("locality")) + F.length(text("recorded_by")) + F.length(text("event_date"))).alias("d"),
        (-F.col(order)).alias("e"),
    )


def ordered_values(df: DataFrame, key: list[str], value: str, order: str, name: str) -> DataFrame:
    """key, name: the distinct filled values of each key in the order of their first appearance (an array). A value is reduced to its
    first appearance before the key's are brought together, so the array has no more entries than there are values."""
    firsts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*key, value).agg(F.min(order).alias("__o"))
    ordered = F.array_sort(F.collect_list(F.struct("__o", value)))
    return firsts.groupBy(*key).agg(F.transform(ordered, lambda s: s[value]).alias(name))


def merged_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each physical specimen: first_seq and the record fields.

    records: order (distinct, not null) and the record fields as text without nulls. One shuffle on the key with partial aggregation
    before it: every field is a maximum by priority, so no group is ever held in a task, whatever its size. The sources of a group
    are pre-aggregated to their first appearance. An empty df gives an empty result.
    """
    keyed = with_codes(records).withColumn("__key", identity_key()).withColumn("__p", priority(order))
    aggs = []
    for f in RECORD_FIELDS:
        if f in WRITTEN:
            continue
        best = f"max_by({f}, __p)" if f in BASE_ONLY else f"coalesce(max_by({f}, __p) FILTER (WHERE {f} <> ''), '')"
        aggs.append(F.expr(best).alias(f))
    sources = keyed.groupBy("__key", "source").agg(F.min(order).alias("__o"), F.count("*").alias("__n")).groupBy("__key").agg(
        F.array_sort(F.collect_list(F.when(F.col("source") != "", F.struct("__o", "source")))).alias("__s"), F.sum("__n").cast("string").alias("merged_record_count")
    )
    out = keyed.groupBy("__key").agg(F.min(order).alias("first_seq"), *aggs).join(sources, "__key")
    out = out.withColumn("collection_event_key", event_key()).withColumn("merged_from_sources", F.array_join(F.transform("__s", lambda s: s["source"]), "; "))
    return out.withColumn("physical_specimen_key", F.col("__key")).select("first_seq", *RECORD_FIELDS)


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """key, first (the smallest order), copies: one row for each key, blank and null keys left out."""
    return df.select(key.alias("key"), F.col(order).alias("__o")).where("key is not null and key <> ''").groupBy("key").agg(F.min("__o").alias("first"), F.count("*").alias("copies"))


def duplicate_gatherings(records: DataFrame) -> DataFrame:
    """collection_event_key, specimens: gatherings that more than one record belongs to."""
    keys = records.select(event_key().alias("collection_event_key")).where("collection_event_key <> ''")
    return keys.groupBy("collection_event_key").agg(F.count("*").alias("specimens")).where("specimens > 1")
