"""Darwin Core tables: projection, readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.text import first_filled, first_present, joined, text
from phyllary.operators.identity import specimen_code, with_codes
from phyllary.schema import CANDIDATE_FIELDS, EXPORT_FIELDS, GEOREFERENCE_FIELDS, camel

#: Record fields that are exported as they are.
PLAIN = {
    "basisOfRecord": "basis_of_record", "institutionCode": "institution_code", "collectionCode": "collection_code", "scientificName": "scientific_name", "recordedBy": "recorded_by", "recordNumber": "record_number",
    "eventID": "collection_event_key", "eventDate": "event_date", "country": "country", "stateProvince": "state_province", "locality": "locality", "verbatimLocality": "verbatim_locality", "decimalLatitude": "decimal_latitude",
    "decimalLongitude": "decimal_longitude", "verbatimElevation": "elevation", "identifiedBy": "identified_by", "typeStatus": "type_status", "references": "source_record_url", "license": "image_license", "rightsHolder": "rights_holder",
}


def darwin_core(records: DataFrame, accepted_name: Column | str, *keep: str) -> DataFrame:
    """The export's 26 columns of records, and the columns to keep."""
    records = with_codes(records).withColumn("__code", specimen_code())
    sc, raw = F.col("__code"), F.trim(text("catalog_number"))
    remote = [F.when(text(c).rlike("^https?://"), text(c)).otherwise("") for c in ("download_url", "image_url")]
    made = {
        "occurrenceID": first_filled("occurrence_id", "source_record_url", "source_record_id"),
        "catalogNumber": sc,
        "otherCatalogNumbers": F.when((raw != "") & (raw != sc), raw).otherwise(""),
        "datasetName": first_filled("merged_from_sources", "source"),
        "acceptedNameUsage": text(accepted_name),
        "associatedMedia": joined(F.array(text("local_image_path"), *remote), " | "),
    }
    return records.select(*keep, *[made.get(c, text(PLAIN[c]) if c in PLAIN else None).alias(c) for c in EXPORT_FIELDS])


def write_delimited(df: DataFrame, path: str, separator: str) -> None:
    """A CSV (",") or TSV (tab) folder with a header, quotes doubled, empty text unquoted; written in parallel, a file per task."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def write_darwin_core(df: DataFrame, folder: str) -> None:
    """The same rows as dwc.csv and dwc.tsv."""
    write_delimited(df, f"{folder}/dwc.csv", ",")
    write_delimited(df, f"{folder}/dwc.tsv", "\t")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file or folder (by its name) with a header: all columns text, null as "", byte-order mark dropped."""
    separator = "\t" if path.lower().rstrip("/").endswith((".tsv", ".tab")) else ","
    df = spark.read.option("sep", separator).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def curated_columns(columns: list[str]) -> list[str]:
    """The input's columns in their order, and the georeference columns it lacks behind them."""
    return [*columns, *[c for c in GEOREFERENCE_FIELDS if c not in columns]]


def candidate_audit(candidates: DataFrame, *keep: str) -> DataFrame:
    """The candidates' 35 columns under their export names."""
    return candidates.select(*keep, *[text(c).alias(camel(c)) for c in CANDIDATE_FIELDS])


def sidecar(labels: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row by order for each key: the side table of labels. The key is the first of the key columns that is filled."""
    keyed = labels.withColumn("__key", first_present(*keys)).where("__key <> ''")
    # a minimum of a row's fields behind its order: partial aggregation before the shuffle
    first = keyed.groupBy("__key").agg(F.min_by(F.struct(*[F.col(c) for c in labels.columns]), F.col(order)).alias("__r"))
    return first.select(F.col("__key").alias("sidecar_key"), "__r.*")
