"""Keys of specimens and gatherings, and names made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.text import code, first_filled, institution, normal_url, text, type_token, words
from phyllary.operators.ranks import HOT_ROWS, numbered


def with_codes(records: DataFrame) -> DataFrame:
    """records with the codes that keys and names are made of, each computed once: __cat (catalogue number), __holder (the holding
    collection), __sid (the source's id), __src (the source).

    The holder is a plausible collection code that begins the catalogue number, else the institution's that does, else the plausible
    collection code, else the institution's.
    """
    r = records.withColumn("__inst", institution("institution_code")).withColumn("__coll", code("collection_code")).withColumn("__cat", code("catalog_number"))
    inst, coll, cat = F.col("__inst"), F.col("__coll"), F.col("__cat")
    plausible = coll.rlike("^[A-Z][A-Z0-9]{0,7}$")
    holder = F.when(plausible & cat.startswith(coll), coll).when((inst != "") & cat.startswith(inst), inst).when(plausible, coll).otherwise(inst)
    return r.withColumn("__holder", holder).withColumn("__sid", code(first_filled("source_record_id", "occurrence_id"))).withColumn("__src", institution("source")).drop("__inst", "__coll")


def identity_key() -> Column:
    """The physical specimen's key, over with_codes(): SHA-256 of holder and catalogue number, else of the occurrence id, the image's
    address, the record's address, or source, id and query."""
    inst, cat = F.col("__holder"), F.col("__cat")
    occurrence = F.lower(F.regexp_replace(F.trim(text("occurrence_id")), r"\s+", " "))
    value = (
        F.when((inst != "") & (cat != ""), F.concat(F.lit("institution_catalog|"), inst, F.lit("|"), cat))
        .when(text("occurrence_id") != "", F.concat(F.lit("occurrence|"), F.when(inst != "", F.concat(inst, F.lit("|"))).otherwise(""), occurrence))
        .when((text("image_url") != "") | (text("source_record_url") != ""), normal_url(first_filled("image_url", "source_record_url")))
        .otherwise(F.concat_ws("|", text("source"), text("source_record_id"), text("query_name")))
    )
    return F.sha2(value, 256)


def event_key() -> Column:
    """The gathering's key: SHA-256 of collector, number, date and place; "" unless collector, date and place are known."""
    who, number, date = words("recorded_by"), words("record_number"), words("event_date")
    where = words(F.concat_ws(" ", text("country"), text("state_province"), text("locality")))
    key = F.sha2(F.concat(F.lit("collection_event|"), F.concat_ws("|", who, number, date, where)), 256)
    return F.when((who != "") & (date != "") & (where != ""), key).otherwise("")


def specimen_code() -> Column:
    """The specimen's code for exports and file names, over with_codes(): the catalogue number with the holder's code in front, or the
    source's id."""
    inst, cat, sid, src = (F.col(c) for c in ("__holder", "__cat", "__sid", "__src"))
    return (
        F.when((cat != "") & ((inst == "") | cat.startswith(inst)), cat)
        .when((inst != "") & (cat != ""), F.concat(inst, cat))
        .when((inst != "") & (sid != "") & ~sid.startswith(inst), F.concat(inst, sid))
        .when(sid != "", F.when((src == "") | sid.startswith(src), sid).otherwise(F.concat(src, sid)))
        .otherwise(F.concat(F.coalesce(F.nullif(src, F.lit("")), F.lit("SPECIMEN")), F.lit("UNKNOWN")))
    )


def name_token(c: Column | str) -> Column:
    """The first two words of a scientific name, joined by an underscore."""
    found = F.slice(F.regexp_extract_all(text(c), F.lit("([A-Za-z][A-Za-z-]*)"), 1), 1, 2)
    return F.coalesce(F.nullif(F.array_join(found, "_"), F.lit("")), F.lit("Unknown_taxon"))


def image_basename(accepted_name: Column | str) -> Column:
    """Code, name and kind of type, over with_codes()."""
    return F.concat_ws("_", specimen_code(), name_token(accepted_name), F.nullif(type_token("type_status"), F.lit("")))


def numbered_names(df: DataFrame, base: Column, order: str, name: str = "file_name", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with a name of its own for each row: the base, and for its n-th use (by the order column, from the second on) _n behind it.

    Bases that more than hot_rows rows share are numbered by many tasks.
    """
    ranked = numbered(df.withColumn("__base", base), ["__base"], [order], "__n", hot_rows)
    return ranked.withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("_", "__base", F.col("__n").cast("string"))).otherwise(F.col("__base"))).drop("__base", "__n")
