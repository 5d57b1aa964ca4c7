"""Run reports: totals in one pass, as a table and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.text import text, type_token
from phyllary.operators.merge import duplicate_gatherings


def counts(states: tuple[str, ...]) -> list[Column]:
    """Counts of records: located, pictured, types, and by state of their image."""
    status = text("download_status")
    return [
        F.count_if((text("decimal_latitude") != "") & (text("decimal_longitude") != "")).alias("located"),
        F.count_if(text("image_url") != "").alias("pictured"),
        F.count_if(type_token("type_status") != "").alias("types"),
        *[F.count_if(status == s).alias(s) for s in states],
    ]


def totals(found: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: records found and kept, merged, located, pictured, type specimens, gatherings with duplicates, images by state."""
    kept = merged.agg(F.count("*").alias("kept"), *counts(("downloaded", "already_downloaded", "rejected_or_failed", "skipped_by_option")))
    out = found.agg(F.count("*").alias("found")).crossJoin(kept).crossJoin(duplicate_gatherings(merged).agg(F.count("*").alias("duplicate_gatherings")))
    return out.withColumn("merged", F.greatest(F.lit(0), F.col("found") - F.col("kept")))


def source_totals(records: DataFrame, states: tuple[str, ...] = ("downloaded", "failed")) -> DataFrame:
    """The counts of each source and, as source (all), of all records, in one pass."""
    out = records.rollup("source").agg(F.grouping("source").alias("__g"), F.count("*").alias("records"), *counts(states))
    return out.withColumn("source", F.when(F.col("__g") == 1, "(all)").otherwise(F.col("source"))).drop("__g")


def report_text(title: str, row, errors: list[str] = ()) -> str:
    """The totals as lines of text."""
    names = {"found": "Records found", "kept": "Records after merging", "merged": "Duplicate records merged", "duplicate_gatherings": "Duplicate gatherings grouped", "located": "Records with coordinates", "pictured": "Records linked to images", "types": "Type specimens"}
    lines = [title, "", *[f"{label}: {row[k]}" for k, label in names.items()], f"Errors: {len(errors)}", *errors]
    return "\n".join(lines) + "\n"


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested structs kept, written in parallel."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
