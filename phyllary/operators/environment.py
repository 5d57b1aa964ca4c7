"""Map features around a place: classes of tags, habitats, nearest features, routes and their scores."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.functions.coordinates import feature_m
from phyllary.functions.sphere import VantageTree
from phyllary.operators.ranks import numbered
from phyllary.session import arrow_function

#: (tag keys, values or words, exact or contained, classes that follow), in the order in which classes are listed (fixed values).
TAG_RULES = [
    (["landuse"], "residential commercial industrial retail", True, "built_up"),
    (["place"], "city town village suburb neighbourhood quarter hamlet", True, "built_up"),
    (["landuse"], "forest plantation", True, "forest"),
    (["natural"], "wood", True, "forest"),
    (["natural"], "scrub", True, "shrubland"),
    (["natural"], "heath", True, "heath shrubland"),
    (["natural"], "grassland", True, "grassland"),
    (["landuse"], "meadow", True, "grassland"),
    (["landuse"], "farmland farmyard orchard vineyard plant_nursery", True, "agriculture"),
    (["natural"], "wetland", True, "wetland"),
    (["wetland"], "*", True, "wetland"),
    (["wetland"], "bog fen peat_bog", True, "peatland"),
    (["wetland"], "mangrove", True, "mangrove"),
    (["waterway"], "*", True, "river water"),
    (["waterway"], "waterfall", True, "waterfall"),
    (["natural"], "spring", True, "spring water"),
    (["natural"], "hot_spring geyser", True, "geothermal spring water"),
    (["natural"], "water", True, "water"),
    (["water"], "*", True, "water"),
    (["landuse"], "reservoir basin salt_pond", True, "water"),
    (["water"], "lake pond reservoir basin", True, "standing_water"),
    (["landuse"], "reservoir basin", True, "standing_water"),
    (["water"], "river stream", True, "river"),
    (["natural"], "coastline", True, "coast marine"),
    (["estuary"], "*no", True, "estuary coast water"),
    (["tidal"], "*no", True, "coast marine"),
    (["natural"], "beach", True, "beach coast sand"),
    (["natural"], "sand", True, "sand"),
    (["surface"], "sand", True, "sand"),
    (["natural"], "desert dune", True, "desert sand"),
    (["natural"], "glacier", True, "snow_ice"),
    (["natural"], "tundra", True, "moss_lichen shrubland grassland"),
    (["natural"], "bare_rock scree cliff", True, "bare_rock"),
    (["landuse"], "quarry", True, "bare_rock"),
    (["natural"], "scree", True, "scree"),
    (["natural"], "cliff", True, "cliff"),
    (["natural"], "cave_entrance", True, "cave"),
    (["natural"], "volcano", True, "volcanic"),
    (["geological", "rock", "surface", "description"], "volcan lava", False, "volcanic"),
    (["geological", "rock", "surface", "description"], "limestone calcareous", False, "limestone"),
    (["geological", "rock", "surface", "description"], "karst", False, "karst"),
    (["geological", "rock", "surface", "description"], "ultramafic serpentine serpentinite", False, "ultramafic"),
    (["geological", "rock", "surface", "description"], "gypsum", False, "gypsum"),
    (["landuse"], "salt_pond", True, "saline"),
    (["geological", "rock", "surface", "description"], "saline salt", False, "saline"),
]

#: Habitats: key | other names | expected classes | avoided classes | lowest | highest elevation | wilderness (fixed values).
HABITAT_ROWS = [
    ("city", ["urban", "built-up"], ["built_up"], [], 0, 0, False),
    ("ruderal", ["disturbed", "waste ground"], ["built_up", "agriculture"], [], 0, 0, False),
    ("roadside", ["road verge"], ["transport", "built_up"], [], 0, 0, False),
    ("agricultural", ["farmland", "cropland"], ["agriculture"], [], 0, 0, False),
    ("paddy field", ["rice field", "paddy"], ["agriculture", "wetland"], [], 0, 0, False),
    ("plantation", [], ["forest", "agriculture"], [], 0, 0, False),
    ("orchard", [], ["agriculture"], [], 0, 0, False),
    ("forest", ["woodland"], ["forest"], ["built_up"], 0, 0, True),
    ("lowland forest", [], ["forest"], ["built_up"], 0, 1200, True),
    ("temperate forest", [], ["forest"], ["built_up"], 0, 0, True),
    ("boreal forest", ["taiga"], ["forest"], ["built_up"], 0, 0, True),
    ("tropical rainforest", ["rainforest"], ["forest"], ["built_up", "desert"], 0, 0, True),
    ("dry forest", [], ["forest", "shrubland"], ["built_up"], 0, 0, True),
    ("cloud forest", [], ["forest"], ["built_up", "desert"], 400, 0, True),
    ("montane forest", [], ["forest"], ["built_up"], 400, 0, True),
    ("subalpine forest", ["sub-alpine forest"], ["forest"], ["built_up"], 600, 0, True),
    ("alpine", ["alpine meadow"], ["grassland", "bare_rock", "snow_ice"], ["built_up"], 800, 0, True),
    ("shrubland", ["scrub"], ["shrubland"], ["built_up"], 0, 0, True),
    ("heathland", ["heath"], ["heath", "shrubland"], ["built_up"], 0, 0, True),
    ("grassland", [], ["grassland"], ["built_up"], 0, 0, False),
    ("meadow", [], ["grassland"], [], 0, 0, False),
    ("savanna", [], ["grassland", "shrubland", "forest"], ["built_up"], 0, 0, True),
    ("steppe", [], ["grassland", "shrubland"], ["built_up"], 0, 0, True),
    ("tundra", [], ["moss_lichen", "grassland", "shrubland", "snow_ice"], ["built_up"], 0, 0, True),
    ("wetland", [], ["wetland", "water"], ["built_up"], 0, 0, False),
    ("marsh", [], ["wetland", "water"], ["built_up"], 0, 0, False),
    ("swamp", [], ["wetland", "forest", "water"], ["built_up"], 0, 0, False),
    ("bog", [], ["wetland", "peatland"], ["built_up"], 0, 0, False),
    ("fen", [], ["wetland", "peatland"], ["built_up"], 0, 0, False),
    ("peatland", ["peat bog"], ["peatland", "wetland"], ["built_up"], 0, 0, False),
    ("riparian", ["riverine", "streamside"], ["river", "wetland"], ["built_up"], 0, 0, False),
    ("river", [], ["river", "water"], [], 0, 0, False),
    ("stream", ["creek", "brook", "ravine"], ["river", "water"], [], 0, 0, False),
    ("spring", ["seep", "seepage"], ["spring", "water", "wetland"], [], 0, 0, False),
    ("waterfall spray zone", ["waterfall", "spray zone"], ["waterfall", "river", "water"], [], 0, 0, False),
    ("lake", [], ["standing_water", "water"], [], 0, 0, False),
    ("pond", [], ["standing_water", "water"], [], 0, 0, False),
    ("freshwater aquatic", ["freshwater", "aquatic"], ["water", "river", "standing_water"], [], 0, 0, False),
    ("brackish", [], ["estuary", "coast", "water"], [], 0, 100, False),
    ("estuary", [], ["estuary", "coast", "water"], [], 0, 100, False),
    ("mangrove", [], ["mangrove", "wetland", "coast"], ["built_up"], 0, 50, False),
    ("salt marsh", [], ["wetland", "coast"], [], 0, 50, False),
    ("sea", ["marine", "ocean"], ["marine", "coast", "water"], ["built_up"], 0, 100, False),
    ("seagrass meadow", ["seagrass"], ["marine", "coast", "water"], [], 0, 20, False),
    ("intertidal", ["tidal"], ["coast", "marine", "wetland"], [], 0, 30, False),
    ("rocky shore", [], ["coast", "bare_rock"], [], 0, 100, False),
    ("beach", [], ["beach", "coast", "sand"], [], 0, 100, False),
    ("coastal dune", ["coastal sand dune"], ["sand", "coast"], [], 0, 150, False),
    ("desert", [], ["desert", "sand", "bare_rock"], ["forest", "wetland"], 0, 0, True),
    ("semi-desert", ["semidesert"], ["desert", "shrubland", "bare_rock"], ["wetland"], 0, 0, True),
    ("inland dune", ["sand dune", "dune"], ["sand", "desert"], ["wetland"], 0, 0, True),
    ("limestone", ["calcareous"], ["limestone", "karst", "bare_rock"], [], 0, 0, False),
    ("karst", [], ["karst", "limestone", "cave", "bare_rock"], [], 0, 0, False),
    ("ultramafic", ["serpentine", "serpentinite"], ["ultramafic", "bare_rock"], [], 0, 0, False),
    ("volcanic", ["lava"], ["volcanic", "bare_rock"], [], 0, 0, False),
    ("geothermal", ["hot spring"], ["geothermal", "spring", "bare_rock"], [], 0, 0, False),
    ("gypsum", [], ["gypsum", "bare_rock"], [], 0, 0, False),
    ("saline", ["salt flat"], ["saline", "bare_rock"], [], 0, 0, False),
    ("rock outcrop", ["rocky outcrop", "bare rock"], ["bare_rock"], [], 0, 0, False),
    ("cliff", [], ["cliff", "bare_rock"], [], 0, 0, False),
    ("scree", ["talus"], ["scree", "bare_rock"], [], 0, 0, False),
    ("cave", [], ["cave", "karst"], [], 0, 0, False),
    ("epiphytic", ["epiphyte"], ["forest"], [], 0, 0, False),
    ("canopy", [], ["forest"], [], 0, 0, False),
    ("soil", [], [], [], 0, 0, False),
    ("rock crevice", [], ["bare_rock", "cliff"], [], 0, 0, False),
]


def habitat_table(spark: SparkSession) -> DataFrame:
    """The 66 habitats: habitat, other_names, expected, avoided, floor_m, ceiling_m, wilderness."""
    return spark.createDataFrame(HABITAT_ROWS, "habitat string, other_names array<string>, expected array<string>, avoided array<string>, floor_m int, ceiling_m int, wilderness boolean")


def tag_classes(tags: Column) -> Column:
    """The classes of a map feature's tags (map of text), each once, in the order of the rules; an empty array without any."""

    def tag(key: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit("")))

    found = []
    for keys, values, exact, classes in TAG_RULES:
        t = F.concat_ws(" ", *[tag(k) for k in keys])
        if values == "*":
            hit = t != ""
        elif values == "*no":
            hit = ~t.isin("", "no")
        elif exact:
            hit = t.isin(values.split())
        else:
            hit = t.rlike("|".join(values.split()))
        found.append(F.when(hit, F.array(*[F.lit(c) for c in classes.split()])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*found)))


def parse_habitats(raw: str | None) -> tuple[list[str], list[str]]:
    """(known habitats, terms kept as they are) of a text parted by comma, semicolon or bar.

    A term that is a habitat's name or other name is that habitat. Others keep their wording, and the habitats whose names stand in
    them as words, longest names first, are known too.
    """
    names = {}
    for key, others, *_ in HABITAT_ROWS:
        for n in (key, *others):
            names[" ".join(re.sub(r"[_-]+", " ", n.casefold()).split())] = key
    known, own = [], []
    for part in re.split(r"[,;|]", raw or ""):
        part = part.strip()
        if not part:
            continue
        plain = " ".join(re.sub(r"[_-]+", " ", part.casefold()).split())
        if plain in names:
            known.append(names[plain])
            continue
        known += [names[n] for n in sorted(names, key=len, reverse=True) if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", plain)]
        own.append(part)
    return list(dict.fromkeys(known)), list(dict.fromkeys(own))


def habitat_summary(known: Sequence[str]) -> tuple[list[str], list[str], int, int, bool]:
    """(expected, avoided classes, highest floor, lowest ceiling above 0 or 0, any wilderness) of several habitats."""
    rows = {r[0]: r for r in HABITAT_ROWS}
    picked = [rows[k] for k in known]
    ceilings = [r[5] for r in picked if r[5] > 0]
    return list(dict.fromkeys(c for r in picked for c in r[2])), list(dict.fromkeys(c for r in picked for c in r[3])), max((r[4] for r in picked), default=0), min(ceilings, default=0), any(r[6] for r in picked)


def nearest_feature(points: DataFrame, features: DataFrame, key: str, context: str, wanted: Column) -> DataFrame:
    """For each point the nearest feature of its context (an equal key) with a wanted class: key, distance_m, feature_id, class.

    points: key, context, latitude, longitude. features: context, feature_id, classes, geometry (array of struct(lat, lon)). Equal
    distances go to the smaller feature_id; class is the first by name. Points without one have no row.
    """
    joined = points.withColumn("__w", wanted).join(features, context).withColumn("__c", F.array_sort(F.array_intersect("classes", "__w"))).where(F.size("__c") > 0)
    far = joined.withColumn("__d", feature_m(F.col("latitude"), F.col("longitude"), F.col("geometry"))).where(F.col("__d").isNotNull())
    best = far.groupBy(key).agg(F.min(F.struct(F.col("__d").alias("d"), F.col("feature_id").alias("f"), F.get("__c", 0).alias("c"))).alias("b"))
    return best.select(key, F.col("b.d").alias("distance_m"), F.col("b.f").alias("feature_id"), F.col("b.c").alias("class"))


def habitat_score(expected_m: Column, avoided_m: Column, built_m: Column, elevation: Column, floor_m: Column, ceiling_m: Column, wilderness: Column) -> tuple[Column, Column]:
    """(score from 0 to 1, hard conflict) of a place for a habitat; null distances mean that no such feature is mapped nearby."""
    near = F.coalesce(F.exp(-expected_m / 800.0), F.lit(0.5))
    clear = F.coalesce(1.0 - F.exp(-avoided_m / 300.0), F.lit(1.0))
    low = F.when((floor_m > 0) & (elevation < floor_m), F.exp(-(floor_m - elevation) / 300.0)).otherwise(1.0)
    high = F.when((ceiling_m > 0) & (elevation > ceiling_m), F.exp(-(elevation - ceiling_m) / 100.0)).otherwise(1.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * near + 0.25 * low * high + 0.20 * clear))
    built = F.coalesce(built_m, F.lit(float("inf")))
    hard = (
        ((ceiling_m > 0) & (elevation > ceiling_m + F.greatest(F.lit(100), ceiling_m)))
        | (wilderness & (built <= 150) & ~F.coalesce(expected_m <= 250, F.lit(False)))
        | ((floor_m > 0) & (elevation < F.greatest(F.lit(0), floor_m - 500)) & (built <= 500))
    )
    return score, hard


def route_class(tags: Column) -> Column:
    """How well a way's kind serves as a collecting route."""
    highway, railway = F.coalesce(F.try_element_at(tags, F.lit("highway")), F.lit("")), F.coalesce(F.try_element_at(tags, F.lit("railway")), F.lit(""))
    return F.when(highway.isin("path", "footway", "track", "bridleway"), 1.0).when(railway.isin("narrow_gauge", "abandoned", "disused"), 0.85).when(highway.isin("steps", "service", "unclassified"), 0.70).otherwise(0.50)


def distance_sample(df: DataFrame, group: str, distance: str, tie: str, nearest: int = 60, most: int = 100) -> DataFrame:
    """Of each group the nearest rows and an even sample of the rest, most rows in all (the feature: a lookup takes so many points).

    Rows are ranked by distance, then tie; groups of any size are ranked (operators/ranks.py); rows without a group have no sample. Beyond the nearest, the positions round(i * (rest - 1) / (slots - 1)), halves to even, are
    taken. Adds distance_rank.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n"))
    ranked = numbered(df, [group], [distance, tie], "distance_rank").join(counts, group)
    slots = most - nearest
    at = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.bround(i * (F.col("__n") - nearest - 1) / float(max(1, slots - 1))).cast("long") + nearest + 1)
    keep = (F.col("__n") <= most) | (F.col("distance_rank") <= nearest) | F.array_contains(at, F.col("distance_rank"))
    return ranked.where(keep).drop("__n")


def route_scores(points: DataFrame) -> DataFrame:
    """points with point_score, null where a point is ruled out: distance_m, radius_m, name_score, class_score, habitat (score or null
    without a habitat prior), hard (boolean), elevation, target (metres or null)."""
    distance = F.exp(-F.col("distance_m") / F.greatest(F.lit(250.0), F.col("radius_m") / 2.0))
    tolerance = F.greatest(F.lit(120.0), F.least(F.lit(300.0), F.abs("target") * 0.08))
    delta = F.abs(F.col("elevation") - F.col("target"))
    height = F.exp(-delta / tolerance)
    n, c, h = F.col("name_score"), F.col("class_score"), F.col("habitat")
    with_target = F.when(h.isNotNull(), 0.38 * height + 0.18 * distance + 0.10 * n + 0.08 * c + 0.26 * h).otherwise(0.52 * height + 0.25 * distance + 0.13 * n + 0.10 * c)
    without = F.when(h.isNotNull(), 0.45 * distance + 0.20 * n + 0.10 * c + 0.25 * h).otherwise(0.55 * distance + 0.35 * n + 0.10 * c)
    ruled_out = F.col("elevation").isNull() | F.coalesce(F.col("hard"), F.lit(False))
    ruled_out = ruled_out | F.when(F.col("target").isNotNull(), delta > F.greatest(F.lit(500.0), tolerance * 2.5)).otherwise((n < 0.35) & F.coalesce(h < 0.65, F.lit(True)))
    return points.withColumn("point_score", F.when(~ruled_out, F.when(F.col("target").isNotNull(), with_target).otherwise(without)))


_worker: dict = {}


def _nearest_in(sent, token: str):
    """The search in a list of places (ids, latitudes and longitudes in radians) that every worker makes a tree of once."""

    def nearest(a: pd.Series, o: pd.Series) -> pd.DataFrame:
        ids, lat, lon = sent.value
        if token not in _worker:
            _worker[token] = VantageTree(lat, lon)
        p, m = _worker[token].nearest(np.radians(a.to_numpy(float, na_value=np.nan)), np.radians(o.to_numpy(float, na_value=np.nan)))
        found = p >= 0
        out = np.where(found, ids[np.maximum(p, 0)] if len(ids) else 0, 0)
        return pd.DataFrame({"m": np.where(found, m, np.nan), "id": pd.Series(out).astype("Int64").where(found, pd.NA)})

    return nearest


def nearest_of_list(df: DataFrame, places: DataFrame, latitude: Column, longitude: Column, block_rows: int = 500_000) -> DataFrame:
    """df with nearest_id and nearest_m: the nearest place of a list (place_id, latitude, longitude as numbers), equal distances to the
    smaller place_id; null where the row or the list has no place. One pass over df, no join: the list goes to the workers, where a
    vantage-point tree is searched; lists of more than block_rows places go as several blocks by hash, each with a tree of its own,
    and the nearest of the blocks' nearest counts. Repeated rows stay; columns of the two names are replaced."""
    places = places.select(F.col("place_id").cast("long").alias("place_id"), F.col("latitude").cast("double").alias("a"), F.col("longitude").cast("double").alias("o")).where("place_id is not null and a is not null and o is not null")
    total = places.count()
    blocks = max(1, -(-total // block_rows))
    best = []
    for b in range(blocks):
        part = places.where(F.pmod(F.xxhash64("place_id"), F.lit(blocks)) == b).orderBy("place_id").toPandas()
        sent = df.sparkSession.sparkContext.broadcast((part["place_id"].to_numpy(np.int64), np.radians(part["a"].to_numpy(float)), np.radians(part["o"].to_numpy(float))))

        s = arrow_function(_nearest_in(sent, uuid.uuid4().hex), "struct<m:double,id:long>")(latitude, longitude)
        best.append(F.when(s["id"].isNotNull(), s))
    chosen = best[0] if blocks == 1 else F.array_min(F.filter(F.array(*best), lambda x: x.isNotNull()))
    return df.withColumn("__n", chosen).withColumn("nearest_id", F.col("__n.id")).withColumn("nearest_m", F.col("__n.m")).drop("__n")
