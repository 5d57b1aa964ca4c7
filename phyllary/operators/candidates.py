"""Coordinate candidates: union, ranks, tiers, the best of each record, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.coordinates import haversine_km, is_wgs84
from phyllary.functions.sphere import degrees, usable_place
from phyllary.functions.text import text
from phyllary.operators.ranks import numbered

ROUTE_WORDS = r"(?iU)\b(?:trail|path|road|route|track|railway|rail)\b|登山|步道|林道|古道"
#: Highest uncertainty in metres, and lowest score, with which a tier's candidates count in robust mode (fixed values).
ROBUST = {"route": (5000, 0.60), "refined": (10000, 0.60), "anchor": (5000, 0.60), "label": (1500, None)}


def union_candidates(*parts: DataFrame) -> DataFrame:
    """The candidates of several producers in their order: union_part tells which, from 0; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("union_part", F.lit(i)) for i, p in enumerate(parts)])


def with_rank(candidates: DataFrame, record: str, *order: str, name: str = "candidate_rank") -> DataFrame:
    """candidates with their place in their record's order, from 1; records of any number of candidates are numbered."""
    return numbered(candidates, [record], order, name)


def score_number() -> Column:
    return F.coalesce(degrees(F.col("score")), F.lit(0.0))


def uncertainty_number() -> Column:
    return F.coalesce(degrees(F.col("candidate_uncertainty_meters")), F.lit(float("inf")))


def has_route_words() -> Column:
    return F.concat_ws(" ", *[text(c) for c in ("modern_place_name", "historical_place_name", "evidence_layers", "evidence")]).rlike(ROUTE_WORDS)


def tier(robust: bool = False) -> Column:
    """The candidate's tier: 1 route, 2 refined, 3 anchor, 4 label, 5 gazetteer, 6 original coordinate; null if it is not eligible.

    In robust mode the limits of ROBUST apply and refined candidates need a source.
    """
    source, kind = text("candidate_source"), text("candidate_type")
    cited, wgs = text("source_urls") != "", is_wgs84(F.col("candidate_geodetic_datum"))

    def within(name: str) -> Column:
        if not robust:
            return F.lit(True)
        most, least = ROBUST[name]
        ok = (uncertainty_number() > 0) & (uncertainty_number() <= most)
        return ok & (score_number() >= least) if least else ok

    return (
        F.when(source.startswith("geospatial_refinement:") & (kind == "route_dem_refinement") & cited & wgs & within("route"), 1)
        .when(source.startswith("llm:") & (kind == "refined_georeference") & wgs & (cited | F.lit(not robust)) & within("refined"), 2)
        .when(source.startswith("llm:") & (kind == "place_centroid") & cited & wgs & within("anchor"), 3)
        .when(source.startswith("label:") & (wgs | F.lit(not robust)) & within("label"), 4)
        .when(source.startswith("gazetteer:"), 5)
        .when(source == "original_dwc", 6)
    )


def best_by_tier(candidates: DataFrame, record: str, order: str, robust: bool = False) -> DataFrame:
    """For each record its best eligible candidate: the columns of the candidates and tier.

    The lowest tier wins; in it the highest score, then the smallest uncertainty, then the first by order; gazetteer candidates go by
    score and order alone. One aggregation with partial maxima before its shuffle; records of any size are fine. Candidates without a
    usable place are left out.
    """
    usable = candidates.withColumn("tier", tier(robust)).where(F.col("tier").isNotNull() & usable_place(degrees(F.col("candidate_latitude")), degrees(F.col("candidate_longitude"))))
    rank = F.struct(F.col("tier"), -score_number(), F.when(F.col("tier") == 5, 0.0).otherwise(uncertainty_number()), F.col(order))
    best = usable.groupBy(record).agg(F.min_by(F.struct(*[F.col(c) for c in usable.columns if c != record]), rank).alias("__b"))
    return best.select(record, "__b.*")


def label_conflicts(selected: DataFrame, candidates: DataFrame, record: str, review_km: float = 5.0) -> DataFrame:
    """selected with conflict_km: the greatest distance to one of the record's label candidates that lies farther off than review_km
    and than its own uncertainty; null without such. Records are joined on their key."""
    labels = candidates.where(text("candidate_source").startswith("label:")).select(
        F.col(record), degrees(F.col("candidate_latitude")).alias("__la"), degrees(F.col("candidate_longitude")).alias("__lo"), F.coalesce(degrees(F.col("candidate_uncertainty_meters")), F.lit(0.0)).alias("__u")
    ).where(usable_place(F.col("__la"), F.col("__lo")))
    own = selected.select(record, degrees(F.col("candidate_latitude")).alias("__a"), degrees(F.col("candidate_longitude")).alias("__o"))
    far = labels.join(own, record).withColumn("__d", haversine_km(F.col("__a"), F.col("__o"), F.col("__la"), F.col("__lo")))
    far = far.where(F.col("__d") > F.greatest(F.lit(review_km), F.col("__u") / 1000.0)).groupBy(record).agg(F.max("__d").alias("conflict_km"))
    return selected.join(far, record, "left")


def anchor_rank(candidates: DataFrame, record: str, order: str, environment_only: bool = False) -> DataFrame:
    """Candidates that refinement may start from, with anchor_rank in each record: cited ones of the language model with route words,
    anchors before refined points; with environment_only also those without, behind them. Then by score, uncertainty and order."""
    kind, route = text("candidate_type"), has_route_words()
    level = F.when((kind == "place_centroid") & route, 3).when((kind == "refined_georeference") & route, 2)
    if environment_only:
        level = level.when(kind == "refined_georeference", 1).when(kind == "place_centroid", 0)
    lat, lon = degrees(F.col("candidate_latitude")), degrees(F.col("candidate_longitude"))
    ok = candidates.withColumn("__level", level).where(text("candidate_source").startswith("llm:") & (text("source_urls") != "") & F.col("__level").isNotNull() & lat.between(-90, 90) & lon.between(-180, 180))
    ok = ok.withColumn("__score", -score_number()).withColumn("__unc", uncertainty_number()).withColumn("__level", -F.col("__level"))
    return numbered(ok, [record], ["__level", "__score", "__unc", order], "anchor_rank").drop("__level", "__score", "__unc")


def first_without_veto(anchors: DataFrame, record: str, veto: Column) -> DataFrame:
    """anchors (with anchor_rank) with anchor_state: used for the first one without veto, ecological_conflict for those before it,
    untouched for the rest. The veto of an anchor depends on that anchor alone, so one minimum with partial aggregation replaces trying
    one after another."""
    firsts = anchors.groupBy(record).agg(F.min(F.when(~veto, F.col("anchor_rank"))).alias("__first"))
    anchors, first = anchors.join(firsts, record), F.col("__first")
    state = F.when(F.col("anchor_rank") == first, "used").when(first.isNull() | (F.col("anchor_rank") < first), "ecological_conflict").otherwise("untouched")
    return anchors.withColumn("anchor_state", state).drop("__first")
