"""What all source adapters share: landed pages in, records out.

An adapter never touches the network. It reads landed pages, a table of (source, query_name, page_no, url, body), one row for each
response body, and gives records: page_no, item_no and the record fields, all text, "" for what is missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phyllary.functions.text import first_filled, name_matches, text
from phyllary.schema import RECORD_FIELDS

PAGE = "source string, query_name string, page_no int, url string, body string"
SPECIMEN = "PRESERVED_SPECIMEN"


def value(item: Column, *paths: str) -> Column:
    """The first filled value of a JSON object under the paths (keys parted by dots; keys may hold colons), as text."""
    return first_filled(*[F.get_json_object(item, _path(p)) for p in paths])


def _path(p: str) -> str:
    return "$" + "".join(f"['{k}']" for k in p.split("."))


def listed(item: Column, *paths: str) -> Column:
    """The first filled value; a list's filled entries joined by semicolons (a text that only looks like a list stays a text)."""
    parsed = F.try_parse_json(item)

    def one(p: str) -> Column:
        many = F.try_variant_get(parsed, _path(p), "array<string>")
        return F.when(many.isNotNull(), F.array_join(F.filter(many, lambda e: F.coalesce(e, F.lit("")) != ""), "; ")).otherwise(value(item, p))

    return first_filled(*[one(p) for p in paths])


def entries(item: Column, path: str) -> Column:
    """The list of objects or values under a path, each as its JSON text; a lone object counts as a list of one; empty without any."""
    v = value(item, path)
    many = F.from_json(F.when(v.startswith("["), v).otherwise(F.when(v != "", F.concat(F.lit("["), v, F.lit("]")))), "array<string>")
    return F.coalesce(F.filter(many, lambda e: e.isNotNull()), F.array().cast("array<string>"))


def coordinate_state(lat: Column, lon: Column, issue: Column | None = None) -> Column:
    there = (text(lat) != "") & (text(lon) != "")
    return F.when(~there, "missing_coordinates").when(F.coalesce(issue, F.lit(False)) if issue is not None else F.lit(False), "coordinates_geospatial_issue").otherwise("coordinates_ok")


def finish(rows: DataFrame, made: Mapping[str, Column | str], order: tuple[str, ...] = ("page_no", "item_no")) -> DataFrame:
    """Records of rows: the made fields, source and query_name of the page, and what follows from them; other fields are empty."""
    fixed = {k: F.lit(v) if isinstance(v, str) else v for k, v in made.items()}
    out = rows.select(*order, *[(text(F.col(f)) if f in ("source", "query_name") and f not in fixed else text(fixed[f]) if f in fixed else F.lit("")).alias(f) for f in RECORD_FIELDS])
    if "original_image_url" not in fixed:
        out = out.withColumn("original_image_url", F.col("image_url"))
    if "coordinate_status" not in fixed:
        out = out.withColumn("coordinate_status", coordinate_state(F.col("decimal_latitude"), F.col("decimal_longitude")))
    return out.withColumn("download_status", F.when(F.col("image_url") != "", "pending").otherwise("no_image_url"))


def matching(records: DataFrame, *names: Column | str, exact: bool = True) -> DataFrame:
    """Records whose names hold the query's binomial; all of them unless exact."""
    return records.where(name_matches("query_name", *names)) if exact else records


def page_of(records: DataFrame, offset: int = 0, limit: int | None = None, order: tuple[str, ...] = ("page_no", "item_no"), number: str | None = None) -> DataFrame:
    """The records of each source and query from offset on, at most limit of them (a query's own limit), in the order they came; number
    names a column for their places from 1. With a limit every task keeps no more than that many of a query before they are shuffled,
    however many it has."""
    n = F.row_number().over(Window.partitionBy("source", "query_name").orderBy(*order))
    ranked = records.withColumn("__n", n)
    if limit is not None:
        ranked = ranked.where(F.col("__n") <= offset + limit)
    ranked = ranked.where(F.col("__n") > offset)
    return ranked.withColumn(number, F.col("__n").cast("long")).drop("__n") if number else ranked.drop("__n")


def union_components(parts: list[DataFrame], source: str, limit: int | None = None, order: tuple[str, ...] = ("page_no", "item_no"), number: str | None = None) -> DataFrame:
    """The components of a federated source in their order, under its name, with one limit for each query over all of them."""
    tagged = [p.withColumn("component", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, tagged).withColumn("source", F.lit(source))
    return page_of(both, 0, limit, ("component", *order), number).drop("component") if limit is not None else both.drop("component")
