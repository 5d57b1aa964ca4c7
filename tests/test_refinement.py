from __future__ import annotations

import json

from pyspark.sql import functions as F

from phyllary.operators import refinement as R
from phyllary.operators import responses as A


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_json_in_answers(spark):
    lit = F.lit
    assert one(spark, A.json_object(lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, A.json_object(lit('Sure: {"a": {"b": 2}} done'))) == '{"a": {"b": 2}}'
    assert one(spark, A.json_object(lit("no object"))) is None and one(spark, A.json_object(lit("{bad}"))) is None and one(spark, A.json_object(lit(None))) is None
    assert one(spark, A.message_text(lit('{"output": [{"content": [{"text": "a"}, {"x": 1}]}, {"content": [{"text": "b"}]}]}'))) == "a\nb" and one(spark, A.message_text(lit('{"output_text": "t"}'))) == "t"
    assert one(spark, A.compact_json(lit('{"a": "", "b": {"c": null, "d": [1, ""]}, "e": []}'))) == '{"b": {"d": [1]}}'
    assert one(spark, A.is_rate_limit(lit("HTTP 429"))) and one(spark, A.is_model_missing(lit("Model x does not exist"))) and not one(spark, A.is_rate_limit(lit("bad")))
    assert one(spark, A.chinese_search(lit("Peru"), lit("阿里山"), lit(None).cast("array<string>"))) and not one(spark, A.chinese_search(lit("Japan"), lit("阿里山"), F.array(lit("zh"))))


def test_label_overlay_and_candidates(spark):
    answer = {"localityText": ["Mt. X", " "], "detectedLanguages": "zh, en", "coordinateCandidates": [{"latitude": "23.5", "longitude": 120.8, "score": 0.8, "sourceUrls": ["u1", "u2"], "evidence": "explicit coordinate"}, {"latitude": 91, "longitude": 0}, {"latitude": 1, "longitude": 2, "type": "Place_Centroid"}]}
    df = spark.createDataFrame([(1, "", "", "old", "c", "", "", ["und"], "dwc_text", "dwc_text_only", json.dumps(answer)), (2, "i", "", "keep", "", "", "", ["la"], "s", "t", None)], "id int, image_path string, label_transcription string, locality_text string, event_date_text string, collector_text string, elevation_text string, detected_languages array<string>, label_source string, label_status string, answer string")
    a, b = A.label_overlay(df, "answer").orderBy("id").collect()
    assert (a.locality_text, a.event_date_text, a.detected_languages, a.label_source, a.label_status) == ("Mt. X", "c", ["zh", "en"], "llm", "llm_text_augmented")
    assert (b.locality_text, b.detected_languages, b.label_status) == ("keep", ["la"], "t")
    got = [(r.candidate_latitude, r.candidate_type, r.source_urls, r.candidate_source) for r in A.answer_candidates(df, "answer", "m", "id").orderBy("candidate_latitude").collect()]
    assert got == [("1.000000", "place_centroid", "", "llm:m"), ("23.500000", "verbatim_coordinate", "u1 | u2", "llm:m")]


def test_store_of_answers(spark, tmp_path):
    requests = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("a", "p1"), ("c", "fail")], "key string, prompt string")
    store = str(tmp_path / "store")

    def client(p: str) -> str:
        if p == "fail":
            raise ValueError("429 rate limit")
        return p.upper()

    for _ in range(2):
        A.add_answers(spark, store, A.ask(requests, client, wait=0.01, jitter=0.0))
    hits, misses = A.stored_and_missing(requests, spark.read.parquet(store))
    assert sorted((r.key, r.answer) for r in hits.collect()) == [("a", "P1"), ("a", "P1"), ("b", "P2")] and [r.key for r in misses.collect()] == ["c"]


def _elements():
    line = [{"lat": 23.48 + i / 1000, "lon": 120.83} for i in range(6)]
    return {"elements": [
        {"type": "way", "id": 1, "tags": {"highway": "path", "name": "Alishan Trail"}, "geometry": line}, {"type": "way", "id": 2, "tags": {"highway": "service"}, "geometry": line[:2]}, {"type": "node", "id": 3, "lat": 1, "lon": 2, "tags": {"natural": "wood"}},
        {"type": "relation", "id": 4, "center": {"lat": 5, "lon": 6}, "tags": {"landuse": "residential"}}, {"type": "node", "id": 3, "lat": 3, "lon": 4, "tags": {"natural": "heath"}}, {"type": "way", "id": 9, "tags": {"highway": "motorway"}, "geometry": line},
    ]}


def test_routes(spark):
    pages = spark.createDataFrame([("k", json.dumps(_elements())), ("e", "{}")], "context string, body string")
    elements = R.map_elements(pages)
    got = {(r.osm_type, r.osm_id): r for r in elements.collect()}
    assert got["node", 3].classes == ["heath", "shrubland"] and got["node", 3].geometry[0].lat == 3.0 and got["relation", 4].geometry[0].lon == 6.0 and got["way", 1].is_route and not got["way", 9].is_route and len(got) == 5
    anchors = spark.createDataFrame([("k", 23.484, 120.83, 300.0, "Alishan Trail", 2290.0, 2000.0, "0.80", "u", "place_centroid")], "context string, latitude double, longitude double, radius_m double, place_text string, target double, anchor_uncertainty_m double, score string, source_urls string, candidate_type string")
    points = R.route_points(elements, anchors)
    assert sorted((round(r.latitude, 3), r.osm_id) for r in points.collect()) == [(23.482, 1), (23.483, 1), (23.484, 1), (23.485, 1)]
    heights = spark.createDataFrame([(23.484, 120.83, 2285.0), (23.483, 120.83, 1000.0)], "lat7 double, lon7 double, elevation double")
    with_h, missing = R.with_elevations(points, heights)
    assert missing.count() == 2
    (best,) = R.best_route_point(R.scored_inputs(with_h, anchors)).collect()
    assert (round(best.latitude, 3), best.osm_id, best.uncertainty_m) == (23.484, 1, 250) and best.point_score > 0.9
    (c,) = R.refined_candidates(R.best_route_point(R.scored_inputs(with_h, anchors)), anchors).collect()
    assert (c.candidate_latitude, c.candidate_elevation_meters, c.candidate_type, c.source_urls) == ("23.484000", "2290", "route_dem_refinement", "u | https://www.openstreetmap.org/way/1") and float(c.score) > 0.84
    assert [one(spark, R.search_radius(F.lit(u))) for u in ("100", "3000", "9000", "", None, "-1")] == [500.0, 3000.0, 5000.0, 2000.0, 2000.0, 2000.0]
    assert one(spark, R.target_elevation(F.lit(""), F.lit(100), F.lit(200))) == 150.0
