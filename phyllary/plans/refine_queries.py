"""Queries over map answers, route points and models' answers, built from the tables; with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from phyllary.functions.text import text
from phyllary.operators.refinement import best_route_point, map_elements, route_points, scored_inputs, search_radius, with_elevations
from phyllary.operators.responses import answer_candidates, json_object, label_overlay, stored_and_missing
from phyllary.plans.place_queries import _CA, _CO, deg, km, place_ok
from phyllary.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, d):
    """Map answers of twenty elements each, whose ids repeat."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 20).cast("string").alias("context"), "event_id", "value")
    i = F.col("event_id")
    one = F.to_json(F.struct(F.lit("way").alias("type"), (i % 7).alias("id"), F.struct(F.when(i % 2 == 0, "path").otherwise("motorway").alias("highway"), F.when(i % 3 == 0, "heath").alias("natural")).alias("tags"), F.array(F.struct((F.lit(10.0) + (i % 5) / 1000).alias("lat"), F.lit(20.0).alias("lon"))).alias("geometry")))
    pages = e.groupBy("context").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("e")))), lambda x: x["e"]).alias("es"))
    return pages.select("context", F.concat(F.lit('{"elements": ['), F.array_join("es", ","), F.lit("]}")).alias("body"))


_ELEMENTS = """e as (select (event_id // 20)::varchar as context, event_id, event_id % 7 as osm_id, row_number() over (partition by event_id // 20 order by event_id) - 1 as pos from events),
g as (select context, osm_id, min(pos) as pos, max(event_id) as last from e group by all)"""


@query(f"with {_ELEMENTS} select context, osm_id, pos::int as pos, last % 2 = 0 as is_route, case when last % 3 = 0 then 'heath,shrubland' else '' end as classes from g")
def map_element_dedup(spark, d):
    """Of elements that come several times the last counts, at the place of the first."""
    return map_elements(_pages(spark, d)).select("context", "osm_id", "pos", "is_route", F.array_join("classes", ",").alias("classes"))


@query(f"with {_ELEMENTS} select context, count(distinct last % 5) as points from g where last % 2 = 0 and 6371.0088 * radians((last % 5) / 1000.0) * 1000 <= 300 group by 1")
def route_point_dedup(spark, d):
    """Vertices of routes within 300 m of an anchor, one for each place."""
    pages = _pages(spark, d)
    anchors = pages.select("context", F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.lit(300.0).alias("radius_m"))
    return route_points(map_elements(pages), anchors).groupBy("context").agg(F.count("*").alias("points"))


_HT = deg("candidate_elevation_meters")


@query(f"""with p as (select cand_seq, round_even({_CA}, 7) as lat7, round_even({_CO}, 7) as lon7, {_HT} as height from coordinate_candidates where {place_ok(_CA, _CO)}), h as (select lat7, lon7, max(height) as elevation from p where height is not null group by all)
select 'known' as kind, count(*) as n from p join h using (lat7, lon7) union all select 'missing', count(*) from (select distinct lat7, lon7 from p) where (lat7, lon7) not in (select (lat7, lon7) from h)""")
def elevation_lookup(spark, d):
    """Points whose height some candidate gives at their place (seven decimals), and places still to be asked for."""
    from phyllary.functions.sphere import degrees, usable_place

    c = table(spark, d, "coordinate_candidates").select("cand_seq", degrees(F.col("candidate_latitude")).alias("a"), degrees(F.col("candidate_longitude")).alias("o"), degrees(F.col("candidate_elevation_meters")).alias("height"))
    p = c.where(usable_place(F.col("a"), F.col("o"))).select("cand_seq", F.bround("a", 7).alias("lat7"), F.bround("o", 7).alias("lon7"), "height")
    h = p.where("height is not null").groupBy("lat7", "lon7").agg(F.max("height").alias("elevation"))
    known, missing = with_elevations(p, h)
    return known.where("elevation is not null").agg(F.lit("known").alias("kind"), F.count("*").alias("n")).unionByName(missing.agg(F.lit("missing").alias("kind"), F.count("*").alias("n")))


_POINT = "select event_id // 25 as context, event_id, 10 + (event_id % 11) / 1000.0::double as latitude, 20 + (event_id % 7) / 1000.0::double as longitude, (event_id % 13) * 150.0::double as distance_m, 2000.0::double as radius_m, (event_id % 4) / 3.0::double as name_score, 1.0::double as class_score, 2000 + value as elevation, case when event_id // 25 % 3 = 0 then null else 2100.0::double end as target from events"


@query(f"""with p as ({_POINT}), t as (select *, greatest(120.0, least(300.0, abs(target) * 0.08)) as tol, abs(elevation - target) as dl, exp(-distance_m / greatest(250.0, radius_m / 2)) as ds from p),
s as (select *, case when target is not null then case when dl <= greatest(500.0, tol * 2.5) then 0.52 * exp(-dl / tol) + 0.25 * ds + 0.13 * name_score + 0.10 * class_score end
 else case when name_score >= 0.35 then 0.55 * ds + 0.35 * name_score + 0.10 * class_score end end as score from t),
k as (select *, row_number() over (partition by context order by score desc, distance_m, event_id) as rn, max(score) over (partition by context) as best from s where score is not null),
b as (select * from k where rn = 1), sp as (select k.context, max({km("b.latitude", "b.longitude", "k.latitude", "k.longitude")} * 1000) as spread from k join b using (context) where k.score >= b.score - 0.05 group by 1)
select context, event_id as osm_id, round(score, 6) as point_score, round_even(greatest(90.0, least(800.0, greatest(case when name_score >= 0.35 then 250.0 else 500.0 end, spread / 2))), 0)::int as uncertainty_m from b join sp using (context)""")
def route_choice(spark, d):
    """The best route point of each anchor and how sure it is."""
    e, i = table(spark, d, "events"), F.col("event_id")
    p = e.select(
        F.floor(i / 25).alias("context"), i.alias("osm_id"), i.alias("point_no"), (10 + (i % 11) / 1000.0).alias("latitude"), (20 + (i % 7) / 1000.0).alias("longitude"), ((i % 13) * 150.0).alias("distance_m"), F.lit(2000.0).alias("radius_m"), ((i % 4) / 3.0).alias("name_score"),
        F.lit(1.0).alias("class_score"), (2000 + F.col("value")).alias("elevation"), F.when(F.floor(i / 25) % 3 != 0, 2100.0).alias("target"), F.lit(None).cast("double").alias("habitat"), F.lit(False).alias("hard"), F.lit(800.0).alias("anchor_uncertainty_m"),
    )
    return best_route_point(p).select("context", "osm_id", F.round("point_score", 6).alias("point_score"), "uncertainty_m")


#: Names of a way in the order in which they are tagged, and words that they and places are made of.
_NAME_KEYS = ["name", "alt_name", "old_name", "name:de", "name:en", "name:fr", "name:zh"]
_WORDS = ["alder", "brook", "cedar", "delta", "ember", "falls", "grove", "heath", "inlet", "jetty", "knoll"]
_WORD = "['" + "', '".join(_WORDS) + "']"
_NAMES = f"list_transform(range(event_id % 8), lambda k: [{_WORD}[(event_id + 3 * k) % 11 + 1], {_WORD}[(event_id * 5 + 4 * k + 1) % 11 + 1]])"


@query(f"""with e as (select event_id // 10 as c, event_id, row_number() over (partition by event_id // 10 order by event_id) - 1 as pos, {_NAMES} as names from events),
p as (select *, [{_WORD}[c % 11 + 1], {_WORD}[c * 3 % 11 + 1], {_WORD}[c * 7 % 11 + 1]] as place, 6371.0088 * radians((pos + 1) / 10000.0) * 1000 as m from e),
n as (select *, coalesce(list_max(list_transform(names, lambda x: case when contains(place[1] || ' ' || place[2] || ' ' || place[3], x[1] || ' ' || x[2]) then 1.0
 else len(list_intersect(list_distinct(x), list_distinct(place)))::double / len(list_distinct(list_concat(x, place))) end)), 0.0)::double as name_score from p),
s as (select *, 0.55 * exp(-m / 1000.0) + 0.35 * name_score + 0.10 as score from n where name_score >= 0.35),
k as (select *, row_number() over (partition by c order by score desc, m, pos) as rn, max(score) over (partition by c) as best from s),
sp as (select c, max(m) as far, min(m) as near from k where score >= best - 0.05 group by 1)
select c::varchar as context, event_id as osm_id, round(score, 6) as point_score, round_even(greatest(250.0, greatest(far - m, m - near) / 2), 0)::int as uncertainty_m from k join sp using (c) where rn = 1""")
def route_by_names(spark, d):
    """The best route point of each anchor without a target height, where ways have up to seven names and any of them may be the place's."""
    i, c = F.col("event_id"), F.floor(F.col("event_id") / 10)

    def word(n):
        return F.element_at(F.array(*map(F.lit, _WORDS)), (n % 11 + 1).cast("int"))

    names = [F.when(i % 8 > k, F.concat_ws(" ", word(i + 3 * k), word(i * 5 + 4 * k + 1), F.lit("Trail"))).alias(key) for k, key in enumerate(_NAME_KEYS)]
    e = table(spark, d, "events").select(c.alias("c"), "event_id", *[F.struct(F.lit("path").alias("highway"), *names).alias("tags")])
    ways = e.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("event_id", "tags"))).alias("ways"))
    elements = F.transform("ways", lambda w, pos: F.struct(F.lit("way").alias("type"), w["event_id"].alias("id"), w["tags"].alias("tags"), F.array(F.struct((F.lit(0.0) + (pos + 1) / 10000.0).alias("lat"), F.lit(20.0).alias("lon"))).alias("geometry")))
    pages = ways.select(F.col("c").cast("string").alias("context"), F.to_json(F.struct(elements.alias("elements"))).alias("body"))
    place = F.concat_ws(" ", word(F.col("c")), word(F.col("c") * 3), word(F.col("c") * 7))
    anchors = ways.select(F.col("c").cast("string").alias("context"), F.lit(0.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.lit(2000.0).alias("radius_m"), place.alias("place_text"), F.lit(None).cast("double").alias("target"), F.lit(800.0).alias("anchor_uncertainty_m"))
    points = route_points(map_elements(pages), anchors).withColumn("elevation", F.lit(100.0))
    return best_route_point(scored_inputs(points, anchors)).select("context", "osm_id", F.round("point_score", 6).alias("point_score"), "uncertainty_m")


_UN = deg("candidate_uncertainty_meters")


@query(f"select cand_seq, least(5000.0::double, greatest(500.0, case when {_UN} > 0 then {_UN} else 2000.0 end)) as radius_m from coordinate_candidates")
def search_radii(spark, d):
    return table(spark, d, "coordinate_candidates").select("cand_seq", search_radius(F.col("candidate_uncertainty_meters")).alias("radius_m"))


def _answers(spark, d):
    """A model's answer for each candidate, in a code fence, with what the candidate says."""
    c = table(spark, d, "coordinate_candidates")
    body = F.to_json(F.struct(text("locality_text").alias("localityText"), F.array(F.struct(text("candidate_latitude").alias("latitude"), text("candidate_longitude").alias("longitude"), text("score").alias("score"), F.array(F.lit("u1"), F.lit(" u2 ")).alias("sourceUrls"), F.when(F.col("cand_seq") % 2 == 0, "explicit coordinate").otherwise("a place").alias("evidence"))).alias("coordinateCandidates")))
    return c.withColumn("answer", json_object(F.concat(F.lit("```json\n"), body, F.lit("\n```"))))


@query(f"""select cand_seq, printf('%.6f', {_CA}) as candidate_latitude, printf('%.6f', {_CO}) as candidate_longitude, coalesce(score, '') as score, 'u1 | u2' as source_urls,
 case when cand_seq % 2 = 0 then 'verbatim_coordinate' else 'refined_georeference' end as candidate_type from coordinate_candidates where {_CA} between -90 and 90 and {_CO} between -180 and 180""")
def json_answers(spark, d):
    """Candidates read out of models' answers."""
    return answer_candidates(_answers(spark, d), "answer", "m", "cand_seq").select("cand_seq", "candidate_latitude", "candidate_longitude", "score", "source_urls", "candidate_type")


@query("""select label_seq, case when coalesce(locality_text, '') = '' then 'from the answer' else locality_text end as locality_text, case when coalesce(locality_text, '') = '' then case when coalesce(image_path, '') <> '' then 'llm_image_transcribed' else 'llm_text_augmented' end else label_status end as label_status from label_reads""")
def label_overlays(spark, d):
    """Label fields that an answer fills where they are empty."""
    labels = table(spark, d, "label_reads").withColumn("answer", F.when(text("locality_text") == "", '{"localityText": "from the answer"}'))
    return label_overlay(labels, "answer").select("label_seq", "locality_text", "label_status")


@query("""with r as (select distinct trim(catalog_number) as key from coordinate_candidates where trim(catalog_number) <> ''), s as (select distinct trim(catalog_number) as key from label_reads where trim(catalog_number) <> '')
select 'stored' as kind, count(*) as n from r where key in (select key from s) union all select 'missing', count(*) from r where key not in (select key from s)""")
def stored_answers(spark, d):
    """Requests whose answer is stored, and such as must be asked."""
    requests = table(spark, d, "coordinate_candidates").select(F.trim("catalog_number").alias("key")).where("key <> ''").distinct()
    store = table(spark, d, "label_reads").select(F.trim("catalog_number").alias("key")).where("key <> ''").distinct().withColumn("answer", F.lit("a"))
    hits, misses = stored_and_missing(requests, store)
    return hits.agg(F.lit("stored").alias("kind"), F.count("*").alias("n")).unionByName(misses.agg(F.lit("missing").alias("kind"), F.count("*").alias("n")))
