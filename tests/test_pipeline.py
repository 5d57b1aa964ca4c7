from __future__ import annotations

import json

from pyspark.sql import functions as F

from phyllary.operators.gazetteer import match_places, read_places
from phyllary.operators.merge import merged_records
from phyllary.plans.pipeline import georeference, run
from phyllary.schema import RECORD_FIELDS, as_records
from phyllary.session import table
from phyllary.sources import json_pages
from phyllary.sources.common import PAGE
from phyllary.streaming.ingest import arrivals_by_source, keep_merged, keyed, read_arrivals, sink, without_redeliveries

DWC = "id string, country string, stateProvince string, locality string, verbatimLocality string, decimalLatitude string, decimalLongitude string, verbatimElevation string, label_transcription string"
ROWS = [
    ("A", "Taiwan", "", "Alishan", "", "23.5102", "120.8051", "", ""), ("B", "Japan", "", "Amami", "", "28.0", "129.3", "", "lat: 28.0100, long: 129.2600 Alt. 101m"), ("C", "Japan", "Nagano", "Kawakami-mura", "", "", "", "", ""),
    ("D", "China", "", "", "", "", "", "", ""), ("E", "Japan", "", "", "", "28.0", "129.3", "", ""), ("F", None, None, None, None, None, None, None, None),
]


def _places(spark):
    rows = [(1, "Kawakami-mura", "Kawakami | 川上村", "35.9754", "138.5790", "5000", "Japan", "Nagano", "en", "local"), (2, "Kawakami-mura", "", "1", "1", "", "China", "", "en", ""), (3, "", "", "1", "1", "", "", "", "", ""), (4, "Bad", "", "x", "1", "", "", "", "", "")]
    return read_places(spark.createDataFrame(rows, "place_id long, placeName string, aliases string, latitude string, lon string, uncertaintyMeters string, country string, state string, language string, source string"))


def test_georeference(spark):
    df = spark.createDataFrame(ROWS, DWC)
    for robust, want in ((False, {"A": "23.5102", "B": "28.010000", "C": "35.9754", "D": "", "E": "28.0", "F": ""}), (True, {"A": "23.5102", "B": "28.010000", "C": "35.9754", "D": "", "E": "", "F": ""})):
        out, candidates = georeference(df, "id", _places(spark), robust=robust)
        assert {r.id: r.decimalLatitude for r in out.collect()} == want
    assert out.columns[:9] == df.columns and "geodeticDatum" in out.columns and candidates.where("id = 'B'").count() == 2
    assert georeference(df.limit(0), "id", _places(spark))[0].count() == 0


def test_evidence_goes_before_labels(spark):
    ev = spark.createDataFrame([("B", "28.5", "129.5", "WGS84", "300", "refined_georeference", "0.8", "llm:m", "https://a.example")], "id string, candidate_latitude string, candidate_longitude string, candidate_geodetic_datum string, candidate_uncertainty_meters string, candidate_type string, score string, candidate_source string, source_urls string")
    out, _ = georeference(spark.createDataFrame(ROWS, DWC), "id", None, ev)
    b = out.where("id = 'B'").first()
    assert b.decimalLatitude == "28.5" and b.georeferenceSources == "llm:m" and b.conflict_km > 50


def test_gazetteer_matches(spark):
    df = spark.createDataFrame([("x", "In KAWAKAMI-MURA, Nagano", "japan", ""), ("y", "川上村", "Japan", "Nagano"), ("z", None, None, None), ("w", "Kawakami-mura", "Peru", "")], "id string, hay string, c string, s string").withColumn("place_id", F.lit("old"))
    got = {(r.id, r.place_id, round(r.match_score, 3), r.match_rank) for r in match_places(df, _places(spark), F.col("hay"), F.col("c"), F.col("s")).collect()}
    assert got == {("x", 1, 0.875, 1), ("y", 1, 0.625, 1)}


def test_collect_and_export(spark, tmp_path):
    body = {"results": [{"key": i % 3, "occurrenceID": f"o{i % 3}", "scientificName": "Pteris vittata", "institutionCode": "K", "catalogNumber": f"K{i % 3}"} for i in range(6)]}
    pages = spark.createDataFrame([("gbif", "Pteris vittata", 0, "u", json.dumps(body))], PAGE)
    report = run(spark, [json_pages.gbif(pages), json_pages.gbif(pages)], "Pteris vittata", str(tmp_path), _places(spark))
    assert "Records found: 12" in report and "Records after merging: 3" in report and spark.read.parquet(f"{tmp_path}/curated").count() == 3


def test_streams_agree_with_batches(spark, sf, tmp_path):
    records = table(spark, sf, "specimen_records")
    full = as_records(records, "seq", "ingested_at")
    source = tmp_path / "in"
    for i in range(3):
        full.where(F.col("seq") % 3 == i).coalesce(1).write.parquet(str(source / f"part{i}"))
    arrivals = read_arrivals(spark, f"{source}/*", full.schema, 1)
    keep_merged(arrivals, f"{tmp_path}/store", f"{tmp_path}/c1").awaitTermination()
    last = sorted((tmp_path / "store" / "merged").iterdir(), key=lambda p: int(p.name.split("=")[1]))[-1]
    columns = ["first_seq", *RECORD_FIELDS]
    assert sorted(map(tuple, spark.read.parquet(str(last)).select(columns).collect())) == sorted(map(tuple, merged_records(full.drop("ingested_at")).select(columns).collect()))
    sink(without_redeliveries(arrivals, late="400 days"), f"{tmp_path}/once", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/once").count() == keyed(full).dropDuplicates(["physical_key", "source", "source_record_id"]).count()
    sink(arrivals_by_source(arrivals, late="1 minute"), f"{tmp_path}/counts", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/counts").count() > 0
