"""Places of a gazetteer found in locality texts."""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.sphere import degrees
from phyllary.functions.text import first_present, text
from phyllary.session import arrow_function

#: Places up to which every worker holds the automaton of their names.
PLACES = 500_000
_worker: dict = {}


def read_places(entries: DataFrame) -> DataFrame:
    """Usable entries of a gazetteer table of any of the usual headers: those with a name and coordinates that are numbers."""
    have = set(entries.columns)

    def of(*names: str) -> Column:
        return first_present(*[F.col(n) for n in names if n in have], F.lit(""))

    places = entries.select(
        of("place_id", "id").try_cast("long").alias("place_id"),
        of("place_name", "placeName", "name", "locality").alias("place_name"),
        of("historical_place_name", "historicalPlaceName", "historicalName").alias("historical_place_name"),
        of("aliases", "alias").alias("aliases"),
        of("decimal_latitude", "decimalLatitude", "latitude", "lat").alias("latitude"),
        of("decimal_longitude", "decimalLongitude", "longitude", "lon", "lng").alias("longitude"),
        of("uncertainty_meters", "uncertaintyMeters", "coordinateUncertaintyInMeters").alias("uncertainty_meters"),
        of("country").alias("country"),
        of("state_province", "stateProvince", "state", "province").alias("state_province"),
        of("place_language", "language").alias("place_language"),
        F.coalesce(F.nullif(of("source"), F.lit("")), F.lit("local_gazetteer")).alias("source"),
    )
    return places.where((F.col("place_name") != "") & degrees(F.col("latitude")).isNotNull() & degrees(F.col("longitude")).isNotNull())


def match_places(df: DataFrame, places: DataFrame, haystack: Column, country: Column, state: Column, best: int = 5, most: int = PLACES) -> DataFrame:
    """df with one row for each place found in a row's text: place_id, match_score, match_rank (from 1), matched_names.

    A place matches if one of its names stands in the text (any case, as part of words too) and its country and state agree with the
    row's: one contains the other, or one is empty. The score is 0.55 plus a fortieth of the longest name's length, 0.95 at most. The
    best matches count, equal ones in the order of place_id. The names of all places (read_places gives the table; at most `most`,
    else an error) are found in one pass over each text by an automaton, so rows are not joined to the gazetteer. Rows without a match
    give none; null texts match nothing; columns of the new names are replaced.
    """
    got = places.select("place_id", "place_name", "historical_place_name", "aliases", "country", "state_province").orderBy("place_id").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"the gazetteer has more than {most} places")
    sent, token = df.sparkSession.sparkContext.broadcast([tuple(r) for r in got]), uuid.uuid4().hex

    def build() -> tuple:
        names: dict[str, list] = {}
        for at, (_, name, old, aliases, _, _) in enumerate(sent.value):
            for k, n in enumerate([name, old, *[a.strip() for a in (aliases or "").split("|")]]):
                if n:
                    names.setdefault(n.lower(), []).append((at, k, n))
        a = ahocorasick.Automaton()
        for n, where in names.items():
            a.add_word(n, where)
        a.make_automaton() if names else None
        return a, [((c or "").lower(), (s or "").lower(), i) for i, _, _, _, c, s in sent.value]

    def agree(a: str, b: str) -> bool:
        return not a or not b or a in b or b in a

    def match(texts: pd.Series, countries: pd.Series, states: pd.Series) -> pd.Series:
        if _worker.get("token") != token:
            _worker.update(token=token, built=build())
        a, own = _worker["built"]
        out = []
        for t, c, s in zip(texts, countries, states, strict=True):
            c, s = c.lower(), s.lower()
            hits: dict[int, set] = {}
            if len(a):
                for _, where in a.iter(t.lower()):
                    for at, k, n in where:
                        if at in hits or agree(own[at][0], c) and agree(own[at][1], s):
                            hits.setdefault(at, set()).add((k, n))
            rows = []
            for at, found in hits.items():
                score = min(0.95, 0.55 + max(len(n) for _, n in found) / 40.0)
                rows.append((-score, at, own[at][2], score, ", ".join(n for _, n in sorted(found))))
            out.append([(i, score, names) for _, _, i, score, names in sorted(rows)[:best]])
        return pd.Series(out, dtype=object)

    found = arrow_function(match, "array<struct<place_id:long,match_score:double,matched_names:string>>")
    df = df.drop("place_id", "match_score", "match_rank", "matched_names")
    rows = df.select(*df.columns, F.posexplode(found(text(haystack), text(country), text(state))).alias("__i", "__m"))
    return rows.select(*df.columns, F.col("__m.place_id").alias("place_id"), F.col("__m.match_score").alias("match_score"), (F.col("__i") + 1).cast("long").alias("match_rank"), F.col("__m.matched_names").alias("matched_names"))
