"""Darwin Core archives: ZIP files with tab-separated tables of occurrences and media."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.images import best_image
from phyllary.functions.text import first_filled, name_matches, text
from phyllary.session import in_batches
from phyllary.sources.common import SPECIMEN, finish

ROW = "archive string, file string, row_no long, row map<string,string>"


def archive_rows(files: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the named tables in ZIP files (path, content): archive, file, row_no, row (map of text). Files that are no ZIP, and
    tables that one lacks, have no rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in names:
                    if name not in z.namelist():
                        continue
                    with z.open(name) as f:
                        held: list = []
                        for i, row in enumerate(csv.DictReader(io.TextIOWrapper(f, encoding="utf-8-sig", newline=""), delimiter="\t")):
                            held.append((path, name, i, {k: v or "" for k, v in row.items() if k is not None}))
                            if len(held) == 5000:
                                yield pd.DataFrame(held, columns=["archive", "file", "row_no", "row"])
                                held = []
                        if held:
                            yield pd.DataFrame(held, columns=["archive", "file", "row_no", "row"])

    return in_batches(files.select("path", "content"), read, ROW)


def read_archives(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """archive_rows of the ZIP files under a path."""
    return archive_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), names)


def _v(*keys: str, row: str = "row") -> Column:
    return first_filled(*[F.trim(text(F.try_element_at(row, F.lit(k)))) for k in keys])


def under_keys(core: DataFrame, media: DataFrame, row: list[str], keys: Column, aggregates: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """What belongs to a row of core under any of its keys: the row's columns, k (place of the key) and the aggregates of the media under
    it. Media (mid, and the columns within) are aggregated for each mid before the join, so that it has one row for each key of a row."""
    per = media.groupBy(*within, "mid").agg(*[c.alias(n) for n, c in aggregates.items()])
    return core.select(*row, F.posexplode(F.array_distinct(F.filter(keys, lambda k: k != ""))).alias("k", "mid")).join(per, [*within, "mid"])


def dwca(rows: DataFrame, source: str, query_name: str, record_url: str = "", institution: str = "", image_license: str = "", rights_holder: str = "", occurrence: str = "occurrence.txt", multimedia: str = "multimedia.txt", exact: bool = True) -> DataFrame:
    """Records of an archive's occurrences for a query, each with the best of its images.

    Media belong to an occurrence under its id, and under its occurrenceID where that differs. record_url may hold {id},
    {occurrenceID} and {catalogNumber}.
    """
    core = rows.where(F.col("file") == occurrence).withColumn("id", _v("id", "occurrenceID")).withColumn("oid", first_filled(_v("occurrenceID"), "id")).withColumn("query_name", F.lit(query_name)).withColumn("source", F.lit(source))
    if exact:
        core = core.where(name_matches("query_name", _v("scientificName")))
    media = rows.where(F.col("file") == multimedia).select("archive", F.col("row_no").alias("m_no"), _v("id", "coreid", "occurrenceID").alias("mid"), best_image(F.array(_v("identifier", "associatedMedia", "accessURI", "references"))).alias("m_url"), _v("license").alias("m_license"), _v("rightsHolder").alias("m_rights")).where("mid <> ''")
    held = under_keys(core, media, ["archive", "row_no"], F.array("id", "oid"), {"ms": F.collect_list(F.struct("m_no", "m_url", "m_license", "m_rights"))}, ("archive",))
    each = held.select("archive", "row_no", F.transform("ms", lambda m: F.struct(F.col("k"), m["m_no"].alias("m_no"), m["m_url"].alias("m_url"), m["m_license"].alias("m_license"), m["m_rights"].alias("m_rights"))).alias("ms"))
    per = each.groupBy("archive", "row_no").agg(F.array_sort(F.flatten(F.collect_list("ms"))).alias("media"))
    r = core.join(per, ["archive", "row_no"], "left")
    held = F.coalesce("media", F.array().cast("array<struct<k:int,m_no:long,m_url:string,m_license:string,m_rights:string>>"))
    r = r.withColumn("media", held).withColumn("image", best_image(F.concat(F.array(_v("associatedMedia")), F.transform("media", lambda m: m["m_url"]))))
    r = r.withColumn("m", F.coalesce(F.get(F.filter("media", lambda m: m["m_url"] == F.col("image")), 0), F.get("media", 0)))
    inst = first_filled(_v("institutionCode"), F.lit(institution))
    catalog = first_filled(_v("catalogNumber"), "oid", "id")
    url = F.lit(record_url)
    for k, c in (("id", F.col("id")), ("occurrenceID", F.col("oid")), ("catalogNumber", catalog)):
        url = F.replace(url, F.lit("{" + k + "}"), F.url_encode(c))
    made = {
        "source_record_id": first_filled("id", catalog), "source_record_url": url, "occurrence_id": F.col("oid"), "institution_code": inst, "collection_code": first_filled(_v("collectionCode"), inst), "catalog_number": catalog, "scientific_name": _v("scientificName"),
        "recorded_by": _v("recordedBy"), "record_number": _v("recordNumber"), "event_date": _v("eventDate"), "country": _v("country"), "state_province": _v("stateProvince", "island"), "locality": _v("locality"), "verbatim_locality": _v("verbatimLocality", "locality"),
        "decimal_latitude": _v("decimalLatitude"), "decimal_longitude": _v("decimalLongitude"), "elevation": _v("verbatimElevation", "minimumElevationInMeters"), "identified_by": _v("identifiedBy"), "type_status": _v("type", "typeStatus"),
        "basis_of_record": first_filled(_v("basisOfRecord"), F.lit(SPECIMEN)), "image_url": F.col("image"), "image_license": first_filled("m.m_license", F.lit(image_license)), "rights_holder": first_filled("m.m_rights", F.lit(rights_holder)),
        "notes": F.concat(F.lit("metadata_from_dwca; archive="), F.col("archive")),
    }
    return finish(r.withColumn("page_no", F.lit(0)).withColumn("item_no", F.col("row_no")), made)
