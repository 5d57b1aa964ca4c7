"""Variant spellings of people and bodies linked (problem 6): MinHash banding over padded q-grams, Monge-Elkan, star clustering."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.functions.vectorised import vectorised
from phyllary.llm.names import ALIKE, BAND_ROWS, EDITS, RECALL, TARGET, bands_for, formal, name_similarity, parse_name, within_edits
from phyllary.session import arrow_function, broadcast_if_small, durable


@vectorised("struct<kind:string,main:string,others:array<string>,form:string,first:string>")
def _parsed(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(n) for n in names], columns=["kind", "main", "others", "form", "first"])


@vectorised("array<string>")
def _keys(kind: pd.Series, others: pd.Series) -> pd.Series:
    """What must agree beside the main part: the initial of the given name, formal or as written, or of a body's words."""
    out = []
    for k, o in zip(kind, others, strict=True):
        o = list(o) if o is not None else []
        out.append(["".join(w[0] for w in o)] if k == "b" else sorted({f[0] for f in formal(o[0])}) if o else [])
    return pd.Series(out, dtype=object)


def _bands(n: int, rows: int):
    rng = np.random.default_rng(7)
    p = (1 << 31) - 1
    a, b = rng.integers(1, p, n * rows, dtype=np.int64), rng.integers(0, p, n * rows, dtype=np.int64)

    def bands(mains: pd.Series) -> pd.Series:
        out = []
        for m in mains:
            padded = f"^{m}$"
            h = np.array([zlib.crc32(padded[i : i + 2].encode()) % p for i in range(len(padded) - 1)], np.int64)
            low = ((h[:, None] * a + b) % p).min(axis=0).reshape(n, rows)
            mixed = np.arange(n, dtype=np.uint64)
            for r in range(rows):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + low[:, r].astype(np.uint64)
            out.append(mixed.astype(np.int64))
        return pd.Series(out, dtype=object)

    return arrow_function(bands, "array<long>")


def _similar(edits: int):
    def similar(kind: pd.Series, ma: pd.Series, oa: pd.Series, mb: pd.Series, ob: pd.Series) -> pd.Series:
        return pd.Series([name_similarity(k, a, list(x), b, list(y), edits) for k, a, x, b, y in zip(kind, ma, oa, mb, ob, strict=True)], dtype="float64")

    return arrow_function(similar, "double")


def _near(edits: int):
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(len(x), len(y)) >= 4 and within_edits(x, y, edits) for x, y in zip(a, b, strict=True)], dtype="boolean")

    return arrow_function(near, "boolean")


def parsed_names(names: DataFrame) -> DataFrame:
    """name, n -> name, n, kind, main, others. The roles in "Word Word" are settled by how often either word is a surname or a given
    name where that is plain (before a comma, beside initials), counted over all names."""
    p = names.withColumn("__p", _parsed("name")).select("name", "n", "__p.*")
    sure = p.where("kind = 'p' and form = 'sure' and main <> ''")
    votes = sure.select(F.col("main").alias("word"), F.lit(-1).alias("v")).unionByName(sure.where(F.length(F.get("others", 0)) > 2).select(F.get("others", 0).alias("word"), F.lit(1).alias("v")))
    votes = broadcast_if_small(durable(votes.groupBy("word").agg(F.sum("v").alias("v"))))
    free = p.where("form = 'free'")
    scored = free.join(votes.select(F.col("word").alias("first"), F.col("v").alias("v1")), "first", "left").join(votes.select(F.col("word").alias("main"), F.col("v").alias("v2")), "main", "left")
    swap = F.coalesce("v2", F.lit(0)) > F.coalesce("v1", F.lit(0))
    settled = scored.select("name", "n", "kind", F.when(swap, F.col("first")).otherwise(F.col("main")).alias("main"), F.array(F.when(swap, F.col("main")).otherwise(F.col("first"))).alias("others"))
    return p.where("form <> 'free'").select("name", "n", "kind", "main", "others").unionByName(settled).where("main <> '' and size(others) > 0")


def name_links(parsed: DataFrame, target: float = TARGET, recall: float = RECALL, rows: int = BAND_ROWS, alike: float = ALIKE, edits: int = EDITS) -> DataFrame:
    """Links between spellings that may be the same: name_a, name_b (name_a smaller), similarity. Candidates share a band of the
    MinHash of their main parts' padded bigrams, and an initial; each is verified. Main parts may differ by so many edits; with more than
    one, target should be lower, as two edits leave fewer bigrams in common."""
    keyed = durable(parsed.withColumn("key", F.explode(_keys("kind", "others"))))
    mains = keyed.select("kind", "key", "main").distinct()
    banded = mains.withColumn("band", F.explode(_bands(bands_for(target, recall, rows), rows)("main")))
    a, b = banded.select("kind", "key", "band", F.col("main").alias("ma")), banded.select("kind", "key", "band", F.col("main").alias("mb"))
    near = a.join(b, ["kind", "key", "band"]).where(f"ma < mb and abs(length(ma) - length(mb)) <= {int(edits)}").select("kind", "key", "ma", "mb").distinct().where(_near(edits)("ma", "mb"))
    both = near.unionByName(near.select("kind", "key", F.col("mb").alias("ma"), F.col("ma").alias("mb"))).unionByName(mains.select("kind", "key", F.col("main").alias("ma"), F.col("main").alias("mb")))
    left = keyed.select("kind", "key", F.col("main").alias("ma"), F.col("others").alias("oa"), F.col("name").alias("name_a"))
    right = keyed.select("kind", "key", F.col("main").alias("mb"), F.col("others").alias("ob"), F.col("name").alias("name_b"))
    pairs = left.join(both, ["kind", "key", "ma"]).join(right, ["kind", "key", "mb"]).where("name_a < name_b").dropDuplicates(["name_a", "name_b"])
    return pairs.withColumn("similarity", _similar(edits)("kind", "ma", "oa", "mb", "ob")).where(F.col("similarity") >= alike).select("name_a", "name_b", "similarity")


def star_clusters(names: DataFrame, links: DataFrame) -> DataFrame:
    """name, center: star clustering of the links. Of the names not yet in a star, each that outranks all its neighbours among them
    becomes a center, and its neighbours join the most similar center; until none is left. A name ranks by whether its given name is
    written out (rank_full), then by links, then by how often it occurs (n), then by code points. Every round is a join; stars of
    names that no link touches have one member."""
    links = durable(links)
    both = links.unionByName(links.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "similarity"))
    degree = both.groupBy(F.col("name_a").alias("name")).agg(F.count("*").alias("degree"))
    rank = names.join(degree, "name", "left").select("name", F.struct(F.col("rank_full"), F.coalesce("degree", F.lit(0)).alias("degree"), F.col("n"), F.col("name")).alias("rank"))
    rank = durable(rank)
    done = rank.where("rank.degree = 0").select("name", F.col("name").alias("center"))
    edges = durable(both.join(rank.select(F.col("name").alias("name_a"), F.col("rank").alias("ra")), "name_a").join(rank.select(F.col("name").alias("name_b"), F.col("rank").alias("rb")), "name_b"))
    while not edges.isEmpty():
        top = edges.groupBy("name_a").agg(F.first("ra").alias("ra"), F.max("rb").alias("rb"))
        centers = top.where(F.col("ra") > F.col("rb")).select(F.col("name_a").alias("center"))
        joined = edges.join(centers, edges["name_b"] == centers["center"]).groupBy(F.col("name_a").alias("name")).agg(F.max_by("center", F.struct("similarity", "rb")).alias("center"))
        new = durable(centers.select(F.col("center").alias("name"), "center").unionByName(joined))
        done = done.unionByName(new)
        gone = new.select("name")
        left = edges.join(gone.withColumnRenamed("name", "name_a"), "name_a", "left_anti").join(gone.withColumnRenamed("name", "name_b"), "name_b", "left_anti")
        alone = edges.select(F.col("name_a").alias("name")).distinct().join(gone, "name", "left_anti")
        left = durable(left)
        done = done.unionByName(alone.join(left.select(F.col("name_a").alias("name")), "name", "left_anti").select("name", F.col("name").alias("center")))
        edges = left
    return done


def link_names(names: DataFrame, **tuning) -> DataFrame:
    """name, center, n for each distinct name: spellings of one person or body have the same center.

    names: name, n (how often it occurs), distinct by name; null and blank names are left out; names without a given name or initial,
    of which nothing tells whom they mean, stay alone. An empty df gives an empty result.
    """
    names = names.where(F.length(F.trim("name")) > 0)
    parsed = durable(parsed_names(names))
    links = name_links(parsed, **tuning)
    full = parsed.select("name", "n", (F.length(F.get("others", 0)) > 2).cast("int").alias("rank_full"))
    clusters = star_clusters(full, links)
    return names.join(clusters, "name", "left").select("name", F.coalesce("center", "name").alias("center"), "n")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """name_a < name_b by code points, for every two spellings with one center."""
    a, b = linked.select("center", F.col("name").alias("name_a")), linked.select("center", F.col("name").alias("name_b"))
    return a.join(b, "center").where("name_a < name_b").select("name_a", "name_b")
