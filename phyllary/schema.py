"""Column names of the tables served, in their fixed order, and the schemas made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A specimen record: all text, "" for what is missing.
RECORD_FIELDS = """source query_name source_record_id source_record_url occurrence_id institution_code collection_code catalog_number
scientific_name recorded_by record_number event_date country state_province locality verbatim_locality decimal_latitude decimal_longitude
elevation identified_by type_status basis_of_record coordinate_status image_url original_image_url download_url image_license
rights_holder local_image_path image_sha256 accessed_at physical_specimen_key collection_event_key merged_from_sources
merged_record_count download_status notes""".split()

#: The Darwin Core export, in the order of its columns.
EXPORT_FIELDS = """occurrenceID basisOfRecord institutionCode collectionCode catalogNumber otherCatalogNumbers datasetName scientificName
acceptedNameUsage recordedBy recordNumber eventID eventDate country stateProvince locality verbatimLocality decimalLatitude
decimalLongitude verbatimElevation identifiedBy typeStatus associatedMedia references license rightsHolder""".split()

#: Columns that curation adds to a Darwin Core table where they are missing.
GEOREFERENCE_FIELDS = """coordinateUncertaintyInMeters geodeticDatum georeferencedBy georeferencedDate georeferenceProtocol
georeferenceSources georeferenceRemarks minimumElevationInMeters maximumElevationInMeters""".split()

#: A coordinate candidate in the audit table: attribute -> column.
CANDIDATE_FIELDS = """catalog_number image_path image_width image_height image_file_size_bytes image_quality_status image_quality_remarks
detected_languages label_source label_status label_transcription locality_text event_date_text collector_text elevation_text
habitat_prior candidate_rank candidate_latitude candidate_longitude candidate_geodetic_datum candidate_uncertainty_meters
candidate_elevation_meters candidate_type modern_place_name historical_place_name match_language source_urls evidence_layers evidence
score selected decision verification_status candidate_source remarks""".split()

RECORD = T.StructType([T.StructField(f, T.StringType(), False) for f in RECORD_FIELDS])


def camel(name: str) -> str:
    """snake_case as camelCase."""
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def as_records(df: DataFrame, *keep: str) -> DataFrame:
    """df with all record fields as text without nulls (missing ones empty), and the columns to keep."""
    have = set(df.columns)
    return df.select(*keep, *[(F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("")).alias(f) for f in RECORD_FIELDS])
