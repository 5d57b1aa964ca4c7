"""The two long runs: collecting records of a name from sources, and georeferencing a table of them; and both in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.coordinates import original_status, uncertainty_m
from phyllary.functions.text import first_filled, text
from phyllary.operators.candidates import best_by_tier, label_conflicts, union_candidates, with_rank
from phyllary.operators.export import curated_columns, darwin_core, write_darwin_core
from phyllary.operators.gazetteer import match_places
from phyllary.operators.labels import label_candidates
from phyllary.operators.merge import merged_records
from phyllary.operators.report import report_text, totals
from phyllary.session import durable


def collect(sources: list[DataFrame]) -> DataFrame:
    """Records of several adapters (page_no, item_no and the record fields) in the order of the list, merged to physical specimens.

    seq orders them all: the place of the source in the list, the page and the item, packed into one number. What the adapters read is
    written once before it is merged, so that pages are taken apart once and the plan of the merge stays small.
    """
    tagged = [s.withColumn("seq", F.lit(i).cast("long") * 10**15 + F.col("page_no").cast("long") * 10**7 + F.col("item_no").cast("long")) for i, s in enumerate(sources)]
    return merged_records(durable(reduce(DataFrame.unionByName, tagged).drop("page_no", "item_no")))


def georeference(rows: DataFrame, key: str, places: DataFrame | None = None, evidence: DataFrame | None = None, robust: bool = False, review_km: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(rows with the chosen coordinates, all candidates with rank) of a Darwin Core table.

    Candidates are the precise or coarse original coordinates, those read out of the label text (column label_transcription, else the
    locality texts), evidence (a table of candidate columns with the key, such as the answers of a language model or of route
    refinement), and gazetteer places. A precise original is kept; else the best tier's candidate is taken; without one a coarse
    original is kept unless robust. The distance to conflicting label coordinates is reported in conflict_km.
    """
    have = set(rows.columns)
    label = text("label_transcription") if "label_transcription" in have else F.concat_ws("\n", *[text(c) for c in ("locality", "verbatimLocality", "verbatimCoordinates", "verbatimElevation") if c in have])
    work = rows.withColumn("label_transcription", label).withColumn("elevation_text", text("verbatimElevation") if "verbatimElevation" in have else F.lit(""))
    status = original_status(F.col("decimalLatitude"), F.col("decimalLongitude"))
    # every producer of candidates reads it
    work = durable(work.withColumn("__status", status))
    own = work.where(F.col("__status").isin("precise", "coarse")).select(
        key, text("decimalLatitude").alias("candidate_latitude"), text("decimalLongitude").alias("candidate_longitude"), F.lit("WGS84").alias("candidate_geodetic_datum"), uncertainty_m(F.col("decimalLatitude"), F.col("decimalLongitude")).cast("string").alias("candidate_uncertainty_meters"),
        F.lit("original_coordinate").alias("candidate_type"), F.when(F.col("__status") == "precise", "0.90").otherwise("0.45").alias("score"), F.lit("original_dwc").alias("candidate_source"),
    )
    parts = [own, label_candidates(work, key)]
    if evidence is not None:
        parts.append(evidence)
    if places is not None:
        hay = F.concat_ws(" ", *[text(c) for c in ("country", "stateProvince", "county", "municipality", "locality", "verbatimLocality") if c in have], F.col("label_transcription"))
        found = match_places(work.select(key, text("country").alias("country"), text("stateProvince").alias("state"), hay.alias("hay")), places, F.col("hay"), F.col("country"), F.col("state"))
        listed = found.join(F.broadcast(places.drop("country", "state_province")), "place_id").select(
            key, F.col("latitude").alias("candidate_latitude"), F.col("longitude").alias("candidate_longitude"), F.lit("WGS84").alias("candidate_geodetic_datum"), first_filled("uncertainty_meters", F.lit("10000")).alias("candidate_uncertainty_meters"),
            F.lit("place_centroid").alias("candidate_type"), F.col("place_name").alias("modern_place_name"), F.format_string("%.2f", "match_score").alias("score"), F.concat(F.lit("gazetteer:"), F.col("source")).alias("candidate_source"), F.col("match_rank").alias("part_rank"),
        )
        parts.append(listed)
    everything = union_candidates(*parts)
    for c in ("source_urls", "evidence_layers", "evidence", "modern_place_name", "historical_place_name", "part_rank", "candidate_elevation_meters"):
        if c not in everything.columns:
            everything = everything.withColumn(c, F.lit(None).cast("string"))
    ranked = durable(with_rank(everything, key, "union_part", "part_rank", "candidate_latitude", "candidate_longitude"))
    best = label_conflicts(best_by_tier(ranked, key, "candidate_rank", robust), ranked, key, review_km)
    chosen = best.select(key, F.col("candidate_latitude").alias("__lat"), F.col("candidate_longitude").alias("__lon"), F.col("candidate_uncertainty_meters").alias("__unc"), F.col("candidate_geodetic_datum").alias("__dat"), F.col("candidate_source").alias("__src"), "conflict_km")
    out = work.join(chosen, key, "left")
    keep = F.col("__status") == "precise"
    usable = F.col("__src").isNotNull() & ~(F.lit(robust) & (F.col("__src") == "original_dwc"))
    for column, new, old in (("decimalLatitude", "__lat", text("decimalLatitude")), ("decimalLongitude", "__lon", text("decimalLongitude")), ("coordinateUncertaintyInMeters", "__unc", uncertainty_m(F.col("decimalLatitude"), F.col("decimalLongitude")).cast("string")), ("geodeticDatum", "__dat", F.lit("WGS84"))):
        out = out.withColumn(f"__new_{column}", F.when(keep, old).when(usable, F.col(new)).otherwise(""))
    out = out.withColumn("__from", F.when(keep, "original_dwc").when(usable, F.col("__src")).otherwise(""))
    made = {c: F.col(f"__new_{c}") for c in ("decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters", "geodeticDatum")} | {"georeferenceSources": F.col("__from")}
    final = out.select(*[made.get(c, F.col(c) if c in have else F.lit("")).alias(c) for c in curated_columns(rows.columns)], "conflict_km")
    return final, ranked


def run(spark: SparkSession, sources: list[DataFrame], accepted_name: str, folder: str, places: DataFrame | None = None) -> str:
    """Collect, merge, export as Darwin Core, georeference; gives the report's text. All tables are written below the folder."""
    found = sum(s.count() for s in sources)
    merged = durable(collect(sources))
    exported = darwin_core(merged, F.lit(accepted_name), "first_seq")
    write_darwin_core(exported.drop("first_seq"), folder)
    curated, candidates = georeference(exported, "first_seq", places)
    curated.write.mode("overwrite").parquet(f"{folder}/curated")
    candidates.write.mode("overwrite").parquet(f"{folder}/candidates")
    row = totals(spark.range(found).toDF("n"), merged).first()
    return report_text(accepted_name, row)
