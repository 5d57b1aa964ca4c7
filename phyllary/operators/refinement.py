"""Points of routes near an anchor, scored by height, distance, names and habitat; the best becomes a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.coordinates import rounded_elevation
from phyllary.functions.sphere import degrees, haversine_m
from phyllary.functions.text import text
from phyllary.operators.environment import route_class, route_scores, tag_classes
from phyllary.sources.common import entries, value

ROUTE_KINDS, RAIL_KINDS = ["path", "track", "footway", "bridleway", "steps", "service", "unclassified"], ["narrow_gauge", "abandoned", "disused"]
#: Limits of a search radius in metres, the radius where none is known, the grid of the height model, and how near to the best score counts as its equal.
LEAST_RADIUS, MOST_RADIUS, USUAL_RADIUS, GRID_M, NEAR_BEST = 500.0, 5000.0, 2000.0, 90.0, 0.05


def search_radius(uncertainty: Column) -> Column:
    """The radius to search around an anchor of that uncertainty (text)."""
    u = degrees(uncertainty)
    return F.least(F.lit(MOST_RADIUS), F.greatest(F.lit(LEAST_RADIUS), F.when(u > 0, u).otherwise(USUAL_RADIUS)))


def element_geometry(element: Column) -> Column:
    """The places of a map element (JSON): its own, those of its line, or else its centre; array of struct(lat, lon)."""

    def place(e: Column, lat: str = "lat", lon: str = "lon") -> Column:
        return F.struct(value(e, lat).try_cast("double").alias("lat"), value(e, lon).try_cast("double").alias("lon"))

    own = F.concat(F.array(place(element)), F.transform(entries(element, "geometry"), lambda e: place(e)))
    known = F.filter(own, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    centre = F.filter(F.array(place(element, "center.lat", "center.lon")), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.when(F.size(known) > 0, known).otherwise(centre)


def map_elements(pages: DataFrame) -> DataFrame:
    """The elements of map answers (context, body): context, pos, osm_type, osm_id, tags, geometry, classes, is_route. Of elements that
    come several times in a context the last counts, at the place of the first."""
    rows = pages.select("context", F.posexplode(entries(F.col("body"), "elements")).alias("pos", "e"))
    e = F.col("e")
    rows = rows.select("context", "pos", value(e, "type").alias("osm_type"), F.coalesce(value(e, "id").try_cast("long"), F.lit(0)).alias("osm_id"), F.coalesce(F.from_json(value(e, "tags"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("tags"), element_geometry(e).alias("geometry"))
    merged = rows.groupBy("context", "osm_type", "osm_id").agg(F.min("pos").alias("pos"), F.max_by(F.struct("tags", "geometry"), "pos").alias("x")).select("context", "pos", "osm_type", "osm_id", "x.*")
    highway, railway = (F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")) for k in ("highway", "railway"))
    return merged.withColumn("classes", tag_classes(F.col("tags"))).withColumn("is_route", (F.col("osm_type") == "way") & (highway.isin(ROUTE_KINDS) | railway.isin(RAIL_KINDS)))


def route_names(tags: Column) -> Column:
    """All filled names of a way, in any language."""
    return F.map_values(F.map_filter(tags, lambda k, v: (k.isin("name", "old_name", "alt_name") | k.startswith("name:")) & (F.coalesce(v, F.lit("")) != "")))


def has_name(tags: Column) -> Column:
    """Whether one of a way's names is filled."""
    return F.size(route_names(tags)) > 0


def route_points(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """The vertices of routes within the radius of their context's anchor (context, latitude, longitude, radius_m), with distance_m.
    Of vertices at one place (seven decimals) a named one counts, else the first."""
    ways = elements.where("is_route").select("context", "pos", "osm_id", "tags", F.posexplode("geometry").alias("v", "p"))
    near = ways.join(anchors.select("context", F.col("latitude").alias("__a"), F.col("longitude").alias("__o"), "radius_m"), "context")
    near = near.withColumn("distance_m", haversine_m(F.col("__a"), F.col("__o"), F.col("p.lat"), F.col("p.lon"))).where("distance_m <= radius_m")
    order = F.struct(has_name(F.col("tags")).alias("named"), (-F.col("pos")).alias("pos"), (-F.col("v")).alias("v"))
    keys = [F.bround("p.lat", 7).alias("lat7"), F.bround("p.lon", 7).alias("lon7")]
    best = near.groupBy("context", *keys).agg(F.max_by(F.struct("osm_id", "tags", "p", "distance_m", "radius_m", "pos", "v"), order).alias("x"))
    return best.select("context", "lat7", "lon7", "x.osm_id", "x.tags", F.col("x.p.lat").alias("latitude"), F.col("x.p.lon").alias("longitude"), "x.distance_m", "x.radius_m", (F.col("x.pos").cast("long") * 1_000_000 + F.col("x.v")).alias("point_no"))


def with_elevations(points: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with elevation where the heights know their place, the places still to be looked up, each once). heights: lat7, lon7,
    elevation. Places are compared at seven decimals."""
    joined = points.join(heights.select("lat7", "lon7", "elevation"), ["lat7", "lon7"], "left")
    return joined, points.select("lat7", "lon7").distinct().join(heights.select("lat7", "lon7"), ["lat7", "lon7"], "left_anti")


def target_elevation(candidate: Column, low: Column, high: Column) -> Column:
    """The height looked for: the candidate's own, else the middle of the label's."""
    return F.coalesce(degrees(candidate), (low + high) / 2.0)


def best_route_point(points: DataFrame) -> DataFrame:
    """The best point of each context with the uncertainty of the choice: context, osm_id, latitude, longitude, elevation, point_score,
    uncertainty_m.

    points: what route_scores asks for, context, osm_id, latitude, longitude, point_no and anchor_uncertainty_m. Highest score, then
    nearest, then the first. The spread is the greatest distance to a point whose score is within NEAR_BEST of the best; the
    uncertainty is half of it, at least 250 m (500 m where the names agree little), at most the anchor's, never below the height
    model's grid.
    """
    scored = route_scores(points).where("point_score is not null")
    # the best is a minimum by its place in the order, found with partial aggregation
    place = F.struct((-F.col("point_score")).alias("s"), F.col("distance_m").alias("d"), F.col("point_no").alias("n"))
    best = scored.groupBy("context").agg(F.min_by(F.struct("latitude", "longitude", "point_score", "name_score", "osm_id", "elevation"), place).alias("top"))
    rows = scored.join(best, "context")
    apart = F.when(F.col("point_score") >= F.col("top.point_score") - NEAR_BEST, haversine_m(F.col("top.latitude"), F.col("top.longitude"), F.col("latitude"), F.col("longitude")))
    out = rows.groupBy("context").agg(F.max(apart).alias("spread"), F.first("top").alias("top"), F.max(F.coalesce("anchor_uncertainty_m", "radius_m")).alias("anchor"))
    least = F.when(F.col("top.name_score") >= 0.35, 250.0).otherwise(500.0)
    uncertainty = F.bround(F.greatest(F.lit(GRID_M), F.least(F.col("anchor"), F.greatest(least, F.col("spread") / 2.0)))).cast("int")
    return out.select("context", "top.osm_id", "top.latitude", "top.longitude", "top.elevation", "top.point_score", uncertainty.alias("uncertainty_m"))


def refined_candidates(best: DataFrame, anchors: DataFrame) -> DataFrame:
    """A candidate for each best point: the anchor's columns with the point's place, uncertainty and height (to 10 m); the score joins
    the anchor's and the point's. anchors: context and candidate columns."""
    b = best.select("context", F.col("latitude").alias("__a"), F.col("longitude").alias("__o"), F.col("elevation").alias("__e"), F.col("point_score").alias("__s"), F.col("uncertainty_m").alias("__u"), F.col("osm_id").alias("__w"))
    j = anchors.join(b, "context")
    score = F.least(F.lit(0.96), 0.55 * F.coalesce(degrees(F.col("score")), F.lit(0.0)) + 0.45 * F.col("__s"))
    j = j.withColumn("candidate_latitude", F.format_string("%.6f", "__a")).withColumn("candidate_longitude", F.format_string("%.6f", "__o")).withColumn("candidate_geodetic_datum", F.lit("WGS84"))
    j = j.withColumn("candidate_uncertainty_meters", F.col("__u").cast("string")).withColumn("candidate_elevation_meters", rounded_elevation(F.col("__e")).cast("string")).withColumn("candidate_type", F.lit("route_dem_refinement"))
    j = j.withColumn("source_urls", F.concat_ws(" | ", F.nullif(text("source_urls"), F.lit("")), F.concat(F.lit("https://www.openstreetmap.org/way/"), F.col("__w").cast("string"))))
    return j.withColumn("score", F.format_string("%.2f", score)).withColumn("candidate_source", F.lit("geospatial_refinement:osm_open_meteo")).drop("__a", "__o", "__e", "__s", "__u", "__w")


def scored_inputs(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """points joined to what their anchor tells: class_score of the way, name_score (the best of all its names) against the anchor's
    place text, target height and uncertainty; without a habitat prior. anchors: context, place_text, target, anchor_uncertainty_m."""
    from phyllary.functions.place_names import best_similarity

    j = points.join(anchors.select("context", "place_text", "target", "anchor_uncertainty_m"), "context")
    j = j.withColumn("class_score", route_class(F.col("tags"))).withColumn("name_score", best_similarity(route_names(F.col("tags")), F.col("place_text")))
    return j.withColumn("habitat", F.lit(None).cast("double")).withColumn("hard", F.lit(False))
