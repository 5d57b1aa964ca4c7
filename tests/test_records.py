from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phyllary.functions import coordinates as C
from phyllary.functions import text as X
from phyllary.functions.label_coordinates import read_coordinates
from phyllary.functions.place_names import name_similarity
from phyllary.operators.environment import habitat_summary, nearest_feature, parse_habitats, route_scores
from phyllary.operators.export import darwin_core, read_delimited, write_darwin_core
from phyllary.operators.identity import identity_key, image_basename, numbered_names, specimen_code, with_codes
from phyllary.operators.labels import is_precise, label_candidates, parsed_coordinates
from phyllary.operators.ranks import numbered
from phyllary.operators.merge import duplicate_gatherings, merged_records
from phyllary.schema import EXPORT_FIELDS, RECORD_FIELDS, as_records


def records(spark, *rows):
    data = [{f: "" for f in RECORD_FIELDS} | {"seq": i} | r for i, r in enumerate(rows)]
    return as_records(spark.createDataFrame(data, "seq long, " + ", ".join(f"{f} string" for f in RECORD_FIELDS)), "seq")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_merge_by_occurrence_id(spark):
    same = {"source": "gbif", "occurrence_id": "x"}
    df = records(spark, same, same, same, {"source": "cvh", "source_record_url": "https://a.example/1"})
    assert merged_records(df).count() == 2


def test_merge_by_institution_alias(spark):
    df = records(spark, {"source": "gbif", "institution_code": "MNHN", "catalog_number": "P01187634"}, {"source": "p", "institution_code": "P", "catalog_number": "P01187634", "locality": "x"})
    (m,) = merged_records(df).collect()
    assert (m.merged_record_count, m.merged_from_sources, m.locality, m.source) == ("2", "gbif; p", "x", "p")


def test_same_image_and_duplicate_gathering(spark):
    assert merged_records(records(spark, {"image_url": "HTTPS://A.example//b.jpg#x"}, {"image_url": "https://a.example/b.jpg"})).count() == 1
    event = {"recorded_by": "A. Bee", "record_number": "7", "event_date": "1990-01-01", "country": "X", "locality": "Y"}
    df = records(spark, event | {"institution_code": "K", "catalog_number": "K0001"}, event | {"institution_code": "P", "catalog_number": "P0001"})
    assert merged_records(df).count() == 2 and duplicate_gatherings(df).first().specimens == 2


def test_order_of_rows_does_not_matter(spark):
    rows = [{"source": f"s{i % 3}", "institution_code": "K", "catalog_number": str(i % 7), "locality": "loc" * (i % 4), "image_url": "u" * (i % 2)} for i in range(60)]
    df = records(spark, *rows)
    assert {tuple(r) for r in merged_records(df).collect()} == {tuple(r) for r in merged_records(df.repartition(7, "locality")).collect()}
    assert merged_records(df.limit(0)).count() == 0


def test_codes_and_names(spark):
    df = with_codes(records(spark, {"institution_code": "TNS", "catalog_number": "TNS-VS-255550", "type_status": "Holotype", "scientific_name": "Haplopteris mediosora"}, {"institution_code": "RBGE", "collection_code": "E", "catalog_number": "E01539315"}))
    got = [r.c for r in df.select(specimen_code().alias("c"), "seq").orderBy("seq").collect()]
    assert got == ["TNSVS255550", "E01539315"]
    assert df.where("seq = 0").select(image_basename("scientific_name").alias("n")).first().n == "TNSVS255550_Haplopteris_mediosora_holotype"
    assert len(df.select(identity_key().alias("k")).first().k) == 64
    twice = df.unionByName(df.withColumn("seq", F.col("seq") + 10))
    assert sorted(r.file_name for r in numbered_names(twice, F.col("__holder"), "seq").collect()) == ["E", "E_2", "TNS", "TNS_2"]


def test_hot_groups_are_numbered_alike(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('g', id % 50) end as g", "(id * 7919) % 3000 as o", "'x' as n")
    one, many = numbered(df, ["g"], ["o"], "n"), numbered(df, ["g"], ["o"], "n", hot_rows=100)
    assert sorted(map(tuple, one.select("id", "n").collect())) == sorted(map(tuple, many.select("id", "n").collect())) and numbered(df.limit(0), ["g"], ["o"], "n").count() == 0


def test_darwin_core_round_trip(spark, tmp_path):
    df = records(spark, {"catalog_number": 'K "1", x', "institution_code": "K", "locality": "a\tb", "image_url": "https://a.example/1.jpg", "local_image_path": "images/1.jpg", "source": "gbif"})
    rows = darwin_core(df, F.lit("Pteris vittata"))
    assert rows.columns == EXPORT_FIELDS and rows.first().associatedMedia == "images/1.jpg | https://a.example/1.jpg"
    write_darwin_core(rows, str(tmp_path))
    assert [tuple(r) for r in read_delimited(spark, f"{tmp_path}/dwc.csv").collect()] == [tuple(r) for r in read_delimited(spark, f"{tmp_path}/dwc.tsv").collect()] == [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize(
    ("text", "lat", "lon", "datum", "m", "kind"),
    [
        ("TWD 67: N 23° 27′ E 120° 55′ Alt. 3050 m", 23.45, 120.9166667, "TWD67", 2000, "dms_minutes"), ("N 23°31′ E 120°48′\n2290 m", 23.5166667, 120.8, "", 2000, "dms_minutes"), ("N 23°31′22″ E 120°48′30″", 23.5227778, 120.8083333, "", 30, "dms_seconds"),
        ("23°31′22″N 120°48′30″E", 23.5227778, 120.8083333, "", 30, "dms_seconds"), ("lat: 28.01, long: 129.26", 28.01, 129.26, "", 1110, "decimal_2dp"),
    ],
)
def test_label_coordinates(text, lat, lon, datum, m, kind):
    (c,) = read_coordinates(text)
    assert (round(c[0], 7), round(c[1], 7), c[4], c[5], c[6]) == (lat, lon, datum, m, kind)


def test_label_candidates(spark):
    df = spark.createDataFrame([(1, "lat: 28.0100, long: 129.2600 Alt. 101m", ""), (2, "no figures", ""), (3, None, "")], "label_seq long, label_transcription string, elevation_text string")
    (c,) = label_candidates(df, "label_seq").collect()
    assert (c.label_seq, c.candidate_latitude, c.candidate_longitude, c.candidate_elevation_meters, c.score, c.candidate_source) == (1, "28.010000", "129.260000", "101", "0.80", "label:decimal")
    assert df.select(F.size(parsed_coordinates(F.col("label_transcription"))).alias("n")).agg(F.sum("n")).first()[0] == 1
    assert df.where("label_seq = 1").select(F.exists(parsed_coordinates(F.col("label_transcription")), is_precise).alias("p")).first().p


def test_scalar_rules(spark):
    lit = F.lit
    assert one(spark, C.original_status(lit("23.5102"), lit("120.8051"))) == "precise" and one(spark, C.original_status(lit("23.6"), lit("120.95"))) == "coarse"
    assert one(spark, C.original_status(lit("0"), lit("0.0000"))) == "zero_placeholder" and one(spark, C.original_status(lit("91"), lit("0"))) == "invalid" and one(spark, C.original_status(lit(None), lit("x"))) == "missing"
    low, high = C.elevation_range(lit("6000-6500 feet"))
    assert (one(spark, low), one(spark, high)) == (1829, 1981) and one(spark, C.elevation_range(lit("Alt. 6500 ft"))[0]) == 1981 and one(spark, C.rounded_elevation(lit(2285.0))) == 2290
    assert one(spark, X.script_languages(lit("TAIWAN: Formosa: Mt. Arisan 阿里山"))) == ["zh", "en/la"] and one(spark, X.script_languages(lit(None))) == ["und"]
    assert one(spark, X.redacted(lit("https://a.example/?b=1&Token=abc&c=2"))) == "https://a.example/?b=1&Token=REDACTED&c=2"
    assert one(spark, X.name_matches(lit("Pteris vittata"), lit("Neopteris vittata L."))) is True
    assert one(spark, X.human_bytes(lit(1536))) == "1.5 KB" and one(spark, X.appended_note(lit("a"), lit("b"))) == "a; b" and one(spark, X.safe_token(lit(" ?? "))) == "unknown"
    assert one(spark, X.broad_locality(lit("Taiwan"), lit("Taiwan"), lit(""))).startswith("Locality is too broad") and one(spark, X.broad_locality(lit("Mt. X, Alishan"), lit("Taiwan"), lit(""))) == ""


def test_habitats():
    known, own = parse_habitats("subalpine forest, river, ultramafic")
    assert known == ["subalpine forest", "river", "ultramafic"] and own == [] and habitat_summary(known)[2:] == (600, 0, True)
    assert parse_habitats("mossy cloud forest")[1] == ["mossy cloud forest"] and parse_habitats("mossy cloud forest")[0][0] == "cloud forest"
    assert parse_habitats(None) == ([], [])


def test_names_compared():
    assert name_similarity("Alishan Trail", "near Alishan station") == 1.0 and name_similarity("阿里山步道", "嘉義 阿里") > 0 and name_similarity("", "x") == 0.0
    assert abs(name_similarity("Red River Road", "Blue River") - 1 / 3) < 1e-9


def test_features_and_routes(spark):
    points = spark.createDataFrame([("p", "c", 0.5, 0.5), ("q", "c", 5.0, 5.0), ("r", "none", 0.0, 0.0)], "id string, ctx string, latitude double, longitude double")
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    features = spark.createDataFrame([("c", 2, ["forest", "river"], square), ("c", 1, ["forest"], [(0.5, 0.6)]), ("c", 3, ["desert"], [(0.5, 0.5)])], "ctx string, feature_id int, classes array<string>, geometry array<struct<lat:double,lon:double>>")
    got = {r.id: (round(r.distance_m), r.feature_id, r["class"]) for r in nearest_feature(points, features, "id", "ctx", F.array(F.lit("river"), F.lit("forest"))).collect()}
    assert got["p"] == (0, 2, "forest") and got["q"][1] == 2 and "r" not in got
    rows = [("a", 100.0, 2000.0, 1.0, 1.0, None, False, 2285.0, 2290.0), ("b", 100.0, 2000.0, 1.0, 1.0, None, False, 3285.0, 2290.0), ("c", 100.0, 2000.0, 0.1, 1.0, None, False, 500.0, None), ("d", 100.0, 2000.0, 1.0, 1.0, 0.9, True, 2285.0, 2290.0)]
    scored = {r.id: r.point_score for r in route_scores(spark.createDataFrame(rows, "id string, distance_m double, radius_m double, name_score double, class_score double, habitat double, hard boolean, elevation double, target double")).collect()}
    assert scored["a"] > 0.9 and scored["b"] is None and scored["c"] is None and scored["d"] is None
