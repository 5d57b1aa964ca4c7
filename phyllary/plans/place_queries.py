"""Queries over places: coordinates, elevations, distances, gazetteer, candidates, map features; with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.functions.coordinates import (
    datum,
    elevation_range,
    feature_m,
    haversine_km,
    in_polygon,
    is_wgs84,
    original_status,
    rounded_elevation,
    segment_m,
    six_decimals,
    status_with_issue,
    uncertainty_m,
)
from phyllary.functions.place_names import GENERIC, similarity
from phyllary.functions.sphere import degrees
from phyllary.functions.text import text
from phyllary.operators.candidates import anchor_rank, best_by_tier, first_without_veto, label_conflicts, with_rank
from phyllary.operators import environment
from phyllary.operators.environment import distance_sample, habitat_score, habitat_table, nearest_of_list, route_class, tag_classes
from phyllary.operators.gazetteer import match_places, read_places
from phyllary.operators.labels import label_candidates, parsed_coordinates
from phyllary.operators.proximity import pairs_within
from phyllary.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def deg(c: str) -> str:
    return f"(case when regexp_full_match(trim({c}), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(trim({c}) as double) end)"


def place_ok(a: str, o: str) -> str:
    return f"({a} between -90 and 90 and {o} between -180 and 180 and not ({a} = 0 and {o} = 0))"


def km(a: str, o: str, b: str, p: str) -> str:
    x = f"(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({p} - {o}) / 2), 2))"
    return f"(2 * 6371.0088 * atan2(sqrt({x}), sqrt(greatest(1 - {x}, 0))))"


def places(c: str) -> str:
    return f"length(regexp_extract(trim(coalesce({c}, '')), '\\.(\\d+)', 1))"


_A, _O = deg("decimal_latitude"), deg("decimal_longitude")


@query(f"""select seq, case when a is null or o is null then 'missing' when not (a between -90 and 90 and o between -180 and 180) then 'invalid' when abs(a) < 1e-12 and abs(o) < 1e-12 then 'zero_placeholder'
 when least(p, q) >= 4 then 'precise' else 'coarse' end as status, greatest(1, round_even(111000 / pow(10.0, least(p, q)), 0))::int as uncertainty_m
from (select seq, {_A} as a, {_O} as o, {places("decimal_latitude")} as p, {places("decimal_longitude")} as q from specimen_records)""")
def decimal_status(spark, d):
    r = table(spark, d, "specimen_records")
    lat, lon = F.col("decimal_latitude"), F.col("decimal_longitude")
    return r.select("seq", original_status(lat, lon).alias("status"), uncertainty_m(lat, lon).alias("uncertainty_m"))


@query("select seq, case when coalesce(decimal_latitude, '') = '' or coalesce(decimal_longitude, '') = '' then 'missing_coordinates' when coalesce(coordinate_status, '') = 'issue' then 'coordinates_geospatial_issue' else 'coordinates_ok' end as status from specimen_records")
def coordinate_status(spark, d):
    r = table(spark, d, "specimen_records")
    return r.select("seq", status_with_issue(F.col("decimal_latitude"), F.col("decimal_longitude"), F.col("coordinate_status") == "issue").alias("status"))


_G = "coalesce(candidate_geodetic_datum, '')"


@query(f"""select cand_seq, case when contains(upper({_G}), 'TWD67') or contains(upper({_G}), 'TWD 67') then 'TWD67' when contains(upper({_G}), 'TWD97') or contains(upper({_G}), 'TWD 97') then 'TWD97'
 when contains(upper({_G}), 'WGS84') or contains(upper({_G}), 'WGS 84') then 'WGS84' when contains(upper({_G}), 'TOKYO') and contains(upper({_G}), 'DATUM') then 'Tokyo' else '' end as datum,
 regexp_replace(upper({_G}), '[^\\p{{L}}\\p{{N}}]', '', 'g') in ('', 'WGS84', 'EPSG4326') as wgs84 from coordinate_candidates""")
def datum_names(spark, d):
    c = table(spark, d, "coordinate_candidates")
    return c.select("cand_seq", datum("candidate_geodetic_datum").alias("datum"), is_wgs84(F.col("candidate_geodetic_datum")).alias("wgs84"))


@query(f"select seq, case when {_A} between -90 and 90 then printf('%.6f', {_A}) end as lat, case when {_O} between -180 and 180 then printf('%.6f', {_O}) end as lon from specimen_records")
def normal_coordinates(spark, d):
    """Coordinates as six-decimal text."""
    r = table(spark, d, "specimen_records")
    return r.select("seq", six_decimals(F.col("decimal_latitude"), True).alias("lat"), six_decimals(F.col("decimal_longitude"), False).alias("lon"))


@query("""select l_orderkey, l_linenumber, round(d + m / 60.0 + s / 3600.0, 9) as latitude, round(e + n / 60.0 + t / 3600.0, 9) as longitude
from (select l_orderkey, l_linenumber, l_orderkey % 90 as d, l_partkey % 60 as m, l_suppkey % 60 as s, l_partkey % 180 as e, l_orderkey % 60 as n, l_linenumber as t from lineitem)""")
def dms_extract(spark, d):
    """Degrees, minutes and seconds written into a text and read from it."""
    l = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    written = F.format_string("Alt. 300 m; N %d° %d′ %d″ E %d° %d′ %d″", F.col("l_orderkey") % 90, F.col("l_partkey") % 60, F.col("l_suppkey") % 60, F.col("l_partkey") % 180, F.col("l_orderkey") % 60, F.col("l_linenumber"))
    found = l.select("l_orderkey", "l_linenumber", F.explode(parsed_coordinates(written)).alias("c"))
    return found.select("l_orderkey", "l_linenumber", F.round("c.latitude", 9).alias("latitude"), F.round("c.longitude", 9).alias("longitude"))


@query(f"""select seq, {_A} as latitude, {_O} as longitude, least({places("decimal_latitude")}, {places("decimal_longitude")})::int as places from specimen_records
where {_A} between -90 and 90 and {_O} between -180 and 180 and not regexp_matches(decimal_latitude || decimal_longitude, '[eE]') and not regexp_matches(trim(decimal_latitude) || trim(decimal_longitude), '(^|[^0-9])\\.|\\.($|[^0-9])')""")
def decimal_extract(spark, d):
    """Decimal coordinates written into a text and read from it."""
    r = table(spark, d, "specimen_records").select("seq", F.trim("decimal_latitude").alias("a"), F.trim("decimal_longitude").alias("o"))
    r = r.where("a rlike '^[+-]?[0-9]+([.][0-9]+)?$' and o rlike '^[+-]?[0-9]+([.][0-9]+)?$'")
    found = r.select("seq", F.explode(parsed_coordinates(F.concat(F.lit("lat: "), "a", F.lit("; long: "), "o"))).alias("c"))
    return found.select("seq", "c.latitude", "c.longitude", F.regexp_extract("c.precision_kind", r"decimal_(\d+)dp", 1).cast("int").alias("places"))


def label_coordinates(spark, d):
    """The coordinates in the labels' own texts, as candidates, of every reading and candidate (SQL has no grammar for them)."""
    labels = table(spark, d, "label_reads").select(F.lit("label_reads").alias("table_name"), F.col("label_seq").alias("row_id"), "label_transcription", "elevation_text")
    candidates = table(spark, d, "coordinate_candidates").select(F.lit("coordinate_candidates").alias("table_name"), F.col("cand_seq").alias("row_id"), "label_transcription", "elevation_text")
    return label_candidates(spread(labels.unionByName(candidates)), "table_name", "row_id")


QUERIES["label_coordinates"] = label_coordinates


_U = "(?:meters|metres|meter|metre|feet|foot|ft[.]|ft|m)"
_RG, _SG = f"(?i)(-?\\d+(?:\\.\\d+)?)\\s*({_U})?\\s*[-–~]\\s*(-?\\d+(?:\\.\\d+)?)\\s*({_U})", f"(?i)(-?\\d+(?:\\.\\d+)?)\\s*({_U})"


def _metres_sql(value: str, unit: str) -> str:
    return f"round_even(try_cast({value} as double) * case when starts_with(lower({unit}), 'f') then 0.3048 else 1.0 end, 0)::int"


@query(f"""with x as (select label_seq, replace(coalesce(elevation_text, ''), ',', '') as e from label_reads),
p as (select label_seq, regexp_matches(e, '{_RG}') as isr, regexp_matches(e, '{_SG}') as iss, regexp_extract(e, '{_RG}', 1) as a, regexp_extract(e, '{_RG}', 2) as ua, regexp_extract(e, '{_RG}', 3) as b, regexp_extract(e, '{_RG}', 4) as ub,
 regexp_extract(e, '{_SG}', 1) as v, regexp_extract(e, '{_SG}', 2) as uv from x)
select label_seq, case when isr then {_metres_sql("a", "case when ua <> '' then ua else ub end")} when iss then {_metres_sql("v", "uv")} end as low_m, case when isr then {_metres_sql("b", "ub")} when iss then {_metres_sql("v", "uv")} end as high_m from p""")
def elevation_parse(spark, d):
    low, high = elevation_range(F.col("elevation_text"))
    return table(spark, d, "label_reads").select("label_seq", low.alias("low_m"), high.alias("high_m"))


@query("select p_partkey, (case when p_retailprice >= 0 then floor(p_retailprice / 10 + 0.5) else ceil(p_retailprice / 10 - 0.5) end * 10)::int as metres from part")
def elevation_round(spark, d):
    return table(spark, d, "part").select("p_partkey", rounded_elevation(F.col("p_retailprice")).alias("metres"))


@query(f"""with r as (select seq, catalog_number, {_A} as a, {_O} as o from specimen_records where trim(catalog_number) <> ''), c as (select cand_seq, catalog_number, {deg("candidate_latitude")} as b, {deg("candidate_longitude")} as p from coordinate_candidates)
select seq, cand_seq, round({km("a", "o", "b", "p")}, 6) as distance_km from r join c using (catalog_number) where {place_ok("a", "o")} and {place_ok("b", "p")}""")
def haversine_pairs(spark, d):
    """How far candidates lie from the coordinates of the records with their catalogue number."""
    r = table(spark, d, "specimen_records").where("trim(catalog_number) <> ''").select("seq", "catalog_number", degrees(F.col("decimal_latitude")).alias("a"), degrees(F.col("decimal_longitude")).alias("o"))
    c = table(spark, d, "coordinate_candidates").select("cand_seq", "catalog_number", degrees(F.col("candidate_latitude")).alias("b"), degrees(F.col("candidate_longitude")).alias("p"))
    ok = "a between -90 and 90 and o between -180 and 180 and not (a = 0 and o = 0) and b between -90 and 90 and p between -180 and 180 and not (b = 0 and p = 0)"
    return r.join(c, "catalog_number").where(ok).select("seq", "cand_seq", F.round(haversine_km(F.col("a"), F.col("o"), F.col("b"), F.col("p")), 6).alias("distance_km"))


@query(f"""with g as (select place_id, {deg("decimal_latitude")} as a, {deg("decimal_longitude")} as o from gazetteer_entries), r as (select seq, {_A} as b, {_O} as p from specimen_records)
select place_id, seq from g join r on abs(a - b) < 0.5 where {place_ok("a", "o")} and {place_ok("b", "p")} and {km("a", "o", "b", "p")} <= 25""")
def radius_range_join(spark, d):
    """Records within 25 km of a gazetteer place."""
    return pairs_within(table(spark, d, "gazetteer_entries"), table(spark, d, "specimen_records"), "place_id", "seq", ("decimal_latitude", "decimal_longitude"), ("decimal_latitude", "decimal_longitude"), 25_000.0)


@query(f"""with g as (select place_id, {deg("decimal_latitude")} as b, {deg("decimal_longitude")} as p from gazetteer_entries where {deg("decimal_latitude")} is not null and {deg("decimal_longitude")} is not null),
r as (select seq, {_A} as a, {_O} as o from specimen_records where {place_ok(_A, _O)}),
x as (select seq, place_id, {km("a", "o", "b", "p")} as k from r, g) select seq, round(min(k), 6) as nearest_km from x group by seq""")
def nearest_place(spark, d):
    """The nearest gazetteer place of each record."""
    g = read_places(table(spark, d, "gazetteer_entries")).select("place_id", degrees(F.col("latitude")).alias("latitude"), degrees(F.col("longitude")).alias("longitude"))
    r = table(spark, d, "specimen_records").select("seq", degrees(F.col("decimal_latitude")).alias("a"), degrees(F.col("decimal_longitude")).alias("o"))
    r = r.where("a between -90 and 90 and o between -180 and 180 and not (a = 0 and o = 0)")
    return nearest_of_list(r, g, F.col("a"), F.col("o")).select("seq", F.round(F.col("nearest_m") / 1000, 6).alias("nearest_km"))


@query(f"""with g as (select place_id, country, {deg("decimal_latitude")} as b, {deg("decimal_longitude")} as p from gazetteer_entries where coalesce(country, '') <> ''),
r as (select seq, country, {_A} as a, {_O} as o from specimen_records where {place_ok(_A, _O)}),
x as (select seq, place_id, {km("a", "o", "b", "p")} as k from r join g using (country) where b is not null and p is not null and place_id % 4 <> 3)
select seq, round(min(k), 6) as nearest_km, arg_min(case when place_id % 4 = 0 then 'forest' when place_id % 4 = 1 then 'river' else 'forest' end, {{'k': k, 'i': place_id}}) as class from x group by seq""")
def nearest_feature(spark, d):
    """The nearest place with a forest or a river of each record's country; places are taken to have one, the other, both or a desert."""
    g = table(spark, d, "gazetteer_entries").where("coalesce(country, '') <> ''")
    lat, lon = degrees(F.col("decimal_latitude")), degrees(F.col("decimal_longitude"))
    classes = F.get(F.array(*[F.array(*map(F.lit, c)) for c in (["forest"], ["river"], ["river", "forest"], ["desert"])]), (F.col("place_id") % 4).cast("int"))
    features = g.select("country", F.col("place_id").alias("feature_id"), classes.alias("classes"), F.array(F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geometry")).where(lat.isNotNull() & lon.isNotNull())
    points = table(spark, d, "specimen_records").select("seq", "country", lat.alias("latitude"), lon.alias("longitude"))
    points = points.where("latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)")
    out = environment.nearest_feature(points, F.broadcast(features), "seq", "country", F.array(F.lit("river"), F.lit("forest")))
    return out.select("seq", F.round(F.col("distance_m") / 1000, 6).alias("nearest_km"), "class")


_SEG = [("lat1", "l_orderkey % 50 + 0.01"), ("lon1", "l_partkey % 90 + 0.02"), ("lat2", "l_orderkey % 50 + 0.03"), ("lon2", "l_partkey % 90 + 0.01"), ("lat", "l_orderkey % 50 + 0.02"), ("lon", "l_partkey % 90 + l_linenumber * 0.01")]


@query(f"""with q as (select l_orderkey, l_linenumber, {", ".join(f"({e})::double as {n}" for n, e in _SEG)} from lineitem),
s as (select *, (lon1 - lon) * 111320 * cos(radians(lat)) as x1, (lat1 - lat) * 110540 as y1, (lon2 - lon) * 111320 * cos(radians(lat)) as x2, (lat2 - lat) * 110540 as y2 from q),
u as (select *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as k from s)
select l_orderkey, l_linenumber, round(sqrt(pow(x1 + k * (x2 - x1), 2) + pow(y1 + k * (y2 - y1), 2)), 4) as metres from u""")
def segment_distance(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"double({e})").alias(n) for n, e in _SEG])
    return l.select("l_orderkey", "l_linenumber", F.round(segment_m(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]), 4).alias("metres"))


RINGS = {"north": [(20, -60), (60, -60), (60, 60), (40, 0), (20, 60), (20, -60)], "south": [(-50, -100), (-10, -100), (-10, 100), (-50, 100), (-50, -100)], "open": [(0, 0), (10, 0), (10, 10)]}
_EDGES = ", ".join(f"('{n}', {a}, {o}, {b}, {p})" for n, ring in RINGS.items() if n != "open" for (a, o), (b, p) in zip(ring, ring[1:], strict=False))


@query(f"""with e(ring, a1, o1, a2, o2) as (values {_EDGES}), r as (select seq, {_A} as a, {_O} as o from specimen_records where {place_ok(_A, _O)}),
x as (select seq, ring, sum(case when (a2 > a) <> (a1 > a) and o < (o1 - o2) * (a - a2) / (a1 - a2)::double + o2 then 1 else 0 end) as n from r, e group by all)
select seq, string_agg(ring, ',' order by ring) filter (where n % 2 = 1) as rings from x group by seq having count(*) filter (where n % 2 = 1) > 0""")
def point_in_polygon(spark, d):
    """Which regions hold each record."""
    r = table(spark, d, "specimen_records").select("seq", degrees(F.col("decimal_latitude")).alias("a"), degrees(F.col("decimal_longitude")).alias("o")).where("a between -90 and 90 and o between -180 and 180 and not (a = 0 and o = 0)")
    rings = {n: F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in ring]) for n, ring in RINGS.items()}
    held = F.array(*[F.when(in_polygon(F.col("a"), F.col("o"), ring), F.lit(n)) for n, ring in sorted(rings.items())])
    out = r.select("seq", F.filter(held, lambda n: n.isNotNull()).alias("h")).where(F.size("h") > 0)
    return out.select("seq", F.array_join("h", ",").alias("rings"))


@query("""with r as (select event_id, event_type, value, row_number() over (partition by event_type order by value, event_id) as distance_rank, count(*) over (partition by event_type) as n from events),
p as (select distinct event_type, (round_even(i * (n - 61) / 39.0, 0) + 61)::bigint as pos from r, range(40) x(i) where n > 100)
select event_id, event_type, distance_rank from r where n <= 100 or distance_rank <= 60 or (event_type, distance_rank) in (select (event_type, pos) from p)""")
def nearest60_even_tail(spark, d):
    """The sixty nearest and forty evenly spaced of the rest, for each group."""
    return distance_sample(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value", "event_id").select("event_id", "event_type", "distance_rank")


_CASES = ["{'landuse': 'residential'}", "{'natural': 'heath', 'wetland': 'bog'}", "{'waterway': 'waterfall'}", "{'natural': 'desert', 'surface': 'serpentinite'}", "{'tidal': 'no', 'water': 'lake'}", "{'place': 'village', 'geological': 'Karst limestone'}", "{'name': 'none'}"]
_CLASSES = ["built_up", "heath,shrubland,wetland,peatland", "river,water,waterfall", "desert,sand,ultramafic", "water,standing_water", "built_up,limestone,karst", ""]


@query("select event_id, case event_id % 7 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CLASSES)) + " end as classes from events")
def environment_classes(spark, d):
    e = table(spark, d, "events")
    tags = F.from_json(F.get(F.array(*[F.lit(c.replace("'", '"')) for c in _CASES]), (F.col("event_id") % 7).cast("int")), "map<string,string>")
    return e.select("event_id", F.array_join(tag_classes(tags), ",").alias("classes"))


@query("""select event_id, case event_id % 4 when 0 then 1.0::double when 1 then 0.85 when 2 then 0.7 else 0.5 end as score from events""")
def route_classes(spark, d):
    e = table(spark, d, "events")
    tags = F.from_json(F.get(F.array(*[F.lit(c) for c in ('{"highway":"path"}', '{"railway":"abandoned"}', '{"highway":"steps"}', '{"highway":"motorway"}')]), (F.col("event_id") % 4).cast("int")), "map<string,string>")
    return e.select("event_id", route_class(tags).alias("score"))


@query("""with h as (select event_id, value as e, event_id % 3000 as x, event_id % 700 as v, event_id % 900 as b, (event_id % 3) * 400 as fl, case when event_id % 5 = 0 then 100 else 0 end as ce, event_id % 2 = 0 as w from events),
s as (select *, case when fl > 0 and e < fl then exp(-(fl - e) / 300.0) else 1.0 end * case when ce > 0 and e > ce then exp(-(e - ce) / 100.0) else 1.0 end as hs from h)
select event_id, round(greatest(0.0, least(1.0, 0.55 * exp(-x / 800.0) + 0.25 * hs + 0.20 * (1 - exp(-v / 300.0)))), 6) as score,
 (ce > 0 and e > ce + greatest(100, ce)) or (w and b <= 150 and not x <= 250) or (fl > 0 and e < greatest(0, fl - 500) and b <= 500) as hard from s""")
def habitat_scores(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    score, hard = habitat_score((i % 3000).cast("double"), (i % 700).cast("double"), (i % 900).cast("double"), F.col("value"), (i % 3) * 400, F.when(i % 5 == 0, 100).otherwise(0), i % 2 == 0)
    return e.select("event_id", F.round(score, 6).alias("score"), hard.alias("hard"))


def habitat_dimension(spark, d):
    """The controlled habitats."""
    return habitat_table(spark)


QUERIES["habitat_dimension"] = habitat_dimension


def _plain_sql(c: str) -> str:
    x = f"lower({c})"
    for g in GENERIC:
        x = f"replace({x}, '{g}', ' ')"
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _shared_sql(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) else 0.0 end)"


@query(f"""with x as (select cand_seq, {_plain_sql('modern_place_name')} as n, {_plain_sql('historical_place_name')} as c from coordinate_candidates where historical_place_name <> '' and modern_place_name <> ''),
w as (select *, list_distinct(list_filter(string_split(n, ' '), lambda t: length(t) >= 3)) as nw, list_distinct(list_filter(string_split(c, ' '), lambda t: length(t) >= 3)) as cw,
 list_distinct(regexp_extract_all(n, '[\\x{{3400}}-\\x{{9fff}}]{{2}}')) as np, list_distinct(regexp_extract_all(c, '[\\x{{3400}}-\\x{{9fff}}]{{2}}')) as cp from x)
select cand_seq, round(case when n = '' or c = '' then 0.0 when length(n) > 1 and (contains(c, n) or contains(n, c)) then 1.0 else greatest({_shared_sql('nw', 'cw')}, {_shared_sql('np', 'cp')}) end, 6) as similarity from w""")
def name_jaccard(spark, d):
    """How alike the modern and historical place names of candidates are."""
    c = table(spark, d, "coordinate_candidates").where("historical_place_name <> '' and modern_place_name <> ''")
    return c.select("cand_seq", F.round(similarity(F.col("modern_place_name"), F.col("historical_place_name")), 6).alias("similarity"))


_HAY = "lower(concat_ws(' ', coalesce(modern_place_name, ''), coalesce(historical_place_name, ''), coalesce(locality_text, ''), coalesce(label_transcription, '')))"


@query(f"""with n as (select place_id, unnest([place_name] || list_transform(split(coalesce(aliases, ''), '|'), lambda x: trim(x))) as name from gazetteer_entries where coalesce(trim(place_name), '') <> '' and {deg("decimal_latitude")} is not null and {deg("decimal_longitude")} is not null),
t as (select distinct {_HAY} as hay from coordinate_candidates), m as (select hay, place_id, least(0.95, 0.55 + max(length(name)) / 40.0) as score from t join n on name <> '' and contains(hay, lower(name)) group by all),
k as (select hay, place_id, score as found, row_number() over (partition by hay order by score desc, place_id) as match_rank from m)
select cand_seq, place_id, round(found, 6) as match_score, match_rank from coordinate_candidates join k on k.hay = {_HAY} where match_rank <= 5""")
def gazetteer_topk(spark, d):
    """The five best gazetteer places named in each candidate's texts (a top-k report is the feature)."""
    c = table(spark, d, "coordinate_candidates").select("cand_seq", F.concat_ws(" ", *[text(x) for x in ("modern_place_name", "historical_place_name", "locality_text", "label_transcription")]).alias("hay"))
    out = match_places(c, read_places(table(spark, d, "gazetteer_entries")), F.col("hay"), F.lit(""), F.lit(""))
    return out.select("cand_seq", "place_id", F.round("match_score", 6).alias("match_score"), "match_rank")


_SCORE, _UNC = f"coalesce({deg('score')}, 0)", f"coalesce({deg('candidate_uncertainty_meters')}, 'inf'::double)"
_WGS = "regexp_replace(upper(coalesce(candidate_geodetic_datum, '')), '[^\\p{L}\\p{N}]', '', 'g') in ('', 'WGS84', 'EPSG4326')"
#: The tables' words for producers of candidates, in the engine's: (source, type) -> (source, type).
PRODUCERS = {
    ("gazetteer", "gazetteer_match"): ("gazetteer:local", "place_centroid"), ("label", "label_coordinates"): ("label:decimal", "verbatim_coordinate"), ("map", "route_point"): ("geospatial_refinement:map", "route_dem_refinement"),
    ("llm", "llm_inference"): ("llm:model", "refined_georeference"), ("llm", "unresolved"): ("llm:model", "place_centroid"), ("dwc", "original"): ("original_dwc", "original_coordinate"),
}


def _produced(i: int) -> str:
    own = ("candidate_source", "candidate_type")[i]
    return "(case " + " ".join(f"when candidate_source = '{s}' and candidate_type = '{t}' then '{new[i]}'" for (s, t), new in PRODUCERS.items()) + f" else coalesce({own}, '') end)"


def _candidates(spark, d) -> DataFrame:
    """Candidates with their producers in the engine's words."""
    c = table(spark, d, "coordinate_candidates").withColumnsRenamed({"candidate_source": "__s", "candidate_type": "__t"})
    for i, name in enumerate(("candidate_source", "candidate_type")):
        new = F.coalesce(F.col(("__s", "__t")[i]), F.lit(""))
        for (s, t), words in PRODUCERS.items():
            new = F.when((F.col("__s") == s) & (F.col("__t") == t), words[i]).otherwise(new)
        c = c.withColumn(name, new)
    return c.drop("__s", "__t")


_SRC, _KIND, _CITED = _produced(0), _produced(1), "coalesce(source_urls, '') <> ''"
_TIER = f"""case when starts_with({_SRC}, 'geospatial_refinement:') and {_KIND} = 'route_dem_refinement' and {_CITED} and {_WGS} then 1 when starts_with({_SRC}, 'llm:') and {_KIND} = 'refined_georeference' and {_WGS} then 2
 when starts_with({_SRC}, 'llm:') and {_KIND} = 'place_centroid' and {_CITED} and {_WGS} then 3 when starts_with({_SRC}, 'label:') then 4 when starts_with({_SRC}, 'gazetteer:') then 5 when {_SRC} = 'original_dwc' then 6 end"""
_CA, _CO = deg("candidate_latitude"), deg("candidate_longitude")


@query("select cand_seq, row_number() over (partition by catalog_number order by cand_seq) as candidate_rank from coordinate_candidates where trim(catalog_number) <> ''")
def candidate_union_rank(spark, d):
    c = table(spark, d, "coordinate_candidates").where("trim(catalog_number) <> ''").select("cand_seq", "catalog_number")
    return with_rank(c, "catalog_number", "cand_seq").select("cand_seq", "candidate_rank")


_BEST = f"""b as (select catalog_number, cand_seq, {_TIER} as tier, {_CA} as a, {_CO} as o, row_number() over (partition by catalog_number order by {_TIER}, {_SCORE} desc, case when {_TIER} = 5 then 0 else {_UNC} end, cand_seq) as rn
 from coordinate_candidates where trim(catalog_number) <> '' and {_TIER} is not null and {place_ok(_CA, _CO)})"""


@query(f"with {_BEST} select catalog_number, cand_seq, tier from b where rn = 1")
def tiered_selection(spark, d):
    c = _candidates(spark, d).where("trim(catalog_number) <> ''")
    return best_by_tier(c, "catalog_number", "cand_seq").select("catalog_number", "cand_seq", "tier")


@query(f"""with {_BEST}, l as (select catalog_number, {_CA} as la, {_CO} as lo, coalesce({deg('candidate_uncertainty_meters')}, 0) as u from coordinate_candidates where starts_with({_SRC}, 'label:') and {place_ok(_CA, _CO)})
select catalog_number, round(max({km("a", "o", "la", "lo")}), 6) as conflict_km from b join l using (catalog_number) where rn = 1 and {km("a", "o", "la", "lo")} > greatest(5.0, u / 1000) group by 1""")
def conflict_review(spark, d):
    c = _candidates(spark, d).where("trim(catalog_number) <> ''")
    out = label_conflicts(best_by_tier(c, "catalog_number", "cand_seq"), c, "catalog_number")
    return out.where("conflict_km is not null").select("catalog_number", F.round("conflict_km", 6).alias("conflict_km"))


_ROUTE = "regexp_matches(concat_ws(' ', coalesce(modern_place_name, ''), coalesce(historical_place_name, ''), coalesce(evidence_layers, ''), coalesce(evidence, '')), '(?i)\\b(?:trail|path|road|route|track|railway|rail)\\b|登山|步道|林道|古道')"
_LEVEL = f"case when {_KIND} = 'place_centroid' and {_ROUTE} then 3 when {_KIND} = 'refined_georeference' and {_ROUTE} then 2 when {_KIND} = 'refined_georeference' then 1 when {_KIND} = 'place_centroid' then 0 end"


@query(f"""with a as (select cand_seq, catalog_number, {_CA} < 0 as south, row_number() over (partition by catalog_number order by {_LEVEL} desc, {_SCORE} desc, {_UNC}, cand_seq) as rk from coordinate_candidates
 where starts_with({_SRC}, 'llm:') and {_CITED} and {_LEVEL} is not null and {_CA} between -90 and 90 and {_CO} between -180 and 180),
f as (select *, min(case when not south then rk end) over (partition by catalog_number) as first from a)
select cand_seq, rk as anchor_rank, case when rk = first then 'used' when first is null or rk < first then 'ecological_conflict' else 'untouched' end as anchor_state from f""")
def anchor_veto(spark, d):
    """Where refinement starts when candidates south of the equator are vetoed."""
    anchors = anchor_rank(_candidates(spark, d), "catalog_number", "cand_seq", environment_only=True)
    return first_without_veto(anchors, "catalog_number", degrees(F.col("candidate_latitude")) < 0).select("cand_seq", "anchor_rank", "anchor_state")
