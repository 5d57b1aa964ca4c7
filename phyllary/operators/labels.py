"""Label texts: coordinates read out of them, and candidates made of these."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.coordinates import elevation_range, is_wgs84
from phyllary.functions.label_coordinates import read_coordinates
from phyllary.functions.text import first_filled, text
from phyllary.session import arrow_function

COORDINATE = "array<struct<latitude:double,longitude:double,source_text:string,notation:string,datum:string,uncertainty_m:int,precision_kind:string>>"


def parsed_coordinates(c: Column) -> Column:
    """The coordinates in a text, as an array of structs; empty without any. Texts without a digit never leave the JVM."""

    def read(texts: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for t in texts:
            if t not in memo:
                memo[t] = read_coordinates(t)
            out.append(memo[t])
        return pd.Series(out, dtype=object)

    return F.coalesce(F.when(text(c).rlike(r"\d"), arrow_function(read, COORDINATE)(c)), F.array().cast(COORDINATE))


def is_precise(c: Column) -> Column:
    """Whether a read coordinate is exact enough to be taken as it is."""
    places = F.regexp_extract(c["precision_kind"], r"^decimal_(\d+)dp$", 1).try_cast("int")
    kind = c["precision_kind"]
    return is_wgs84(c["datum"]) & ((kind == "dms_seconds") | F.coalesce(places >= 4, F.lit(False)) | ((kind == "dms_minutes") & (c["uncertainty_m"] > 0) & (c["uncertainty_m"] <= 500)))


def label_candidates(labels: DataFrame, *keep: str) -> DataFrame:
    """One candidate for each coordinate in a label's text: the columns to keep and candidate columns, numbers as text."""
    rows = labels.withColumn("__c", F.explode(parsed_coordinates(F.col("label_transcription"))))
    c = F.col("__c")
    low, high = elevation_range(first_filled("elevation_text", "label_transcription"))
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.8f", v), "0+$", ""), r"\.$", "")
    precise = is_precise(c)
    return rows.select(
        *keep,
        F.when(precise, F.format_string("%.6f", c["latitude"])).otherwise(plain(c["latitude"])).alias("candidate_latitude"),
        F.when(precise, F.format_string("%.6f", c["longitude"])).otherwise(plain(c["longitude"])).alias("candidate_longitude"),
        first_filled(c["datum"], F.lit("WGS84")).alias("candidate_geodetic_datum"),
        c["uncertainty_m"].cast("string").alias("candidate_uncertainty_meters"),
        F.coalesce(F.bround((low + high) / 2.0).cast("int").cast("string"), F.lit("")).alias("candidate_elevation_meters"),
        F.lit("verbatim_coordinate").alias("candidate_type"),
        F.lit("specimen_label").alias("evidence_layers"),
        F.concat(F.lit("explicit coordinate found in label text: "), c["source_text"], F.lit("; source_precision="), c["precision_kind"]).alias("evidence"),
        F.when(c["datum"].isin("", "WGS84"), "0.80").otherwise("0.70").alias("score"),
        F.concat(F.lit("label:"), c["notation"]).alias("candidate_source"),
    )
