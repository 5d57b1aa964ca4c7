from __future__ import annotations

import json

from pyspark.sql import functions as F

from phyllary.operators import refinement as R


def test_any_name_of_a_way_may_match(spark):
    names = {"alt_name": "Northern Ridge", "name": "Old Mill Way", "name:de": "Mühlenweg | Ost", "name:en": "", "name:fr": "Chemin du moulin", "name:zh": "阿里山步道", "old_name": "Brook Lane"}
    ways = [{"type": "way", "id": i, "tags": {"highway": "path"} | tags, "geometry": [{"lat": 10 + i / 1000, "lon": 20}]} for i, tags in enumerate([names, {"name": "Elsewhere"}, {}], 1)]
    pages = spark.createDataFrame([(c, json.dumps({"elements": ways})) for c in ("zh", "old", "fr", "none")], "context string, body string")
    texts = [("zh", "阿里山"), ("old", "brook lane, east"), ("fr", "Chemin du moulin"), ("none", None)]
    anchors = spark.createDataFrame([(c, 10.0, 20.0, 2000.0, t, None, 800.0) for c, t in texts], "context string, latitude double, longitude double, radius_m double, place_text string, target double, anchor_uncertainty_m double")
    scored = R.scored_inputs(R.route_points(R.map_elements(pages), anchors), anchors).withColumn("elevation", F.lit(5.0))
    got = {(r.context, r.osm_id): r.name_score for r in scored.collect()}
    assert got == {(c, i): 1.0 if i == 1 and c != "none" else 0.0 for c, _ in texts for i in (1, 2, 3)}
    assert {(r.context, r.osm_id, r.uncertainty_m) for r in R.best_route_point(scored).collect()} == {("zh", 1, 250), ("old", 1, 250), ("fr", 1, 250)}
