"""Quantities recorded in different units, made common ones (problem 5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.functions.quantities import FACTORS, SAME, read_altitude
from phyllary.functions.vectorised import vectorised


@vectorised("struct<low:long,high:long,only:boolean,residual:double>")
def _altitudes(text: pd.Series, unit: pd.Series, units: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    memo: dict = {}
    rows = []
    for t, u, us, e in zip(text, unit, units, evidence, strict=True):
        key = (t, u, us, None if pd.isna(e) else int(e))
        if key not in memo:
            default = (u, *(x for x in us.split() if x != u)) if u in FACTORS else ()
            memo[key] = read_altitude(t, default, key[3]) or (None, None, None, None)
        rows.append(memo[key])
    out = pd.DataFrame(rows, columns=["low", "high", "only", "residual"])
    return out.astype({"low": "Int64", "high": "Int64", "only": "boolean", "residual": "float64"})


def normalise_altitudes(df: DataFrame, text: str, unit: str | None = None, units: Sequence[str] = (), evidence: str | None = None) -> DataFrame:
    """df with low_m, high_m (whole metres, rounded half up), unit_unique and unit_residual; null where the text states no altitude.

    unit names the column with the likeliest unit of a number without one (m, km, ft, yd); where it is null such numbers are no
    altitudes. units are all that such a number may have. evidence names a column with the altitude in metres that something else gives
    for the same thing: a number without unit has the unit under which the two agree best, the likeliest where none agrees.
    unit_unique is false where more than one choice of units fits or only the likeliest unit speaks for itself.

    Null, blank and very long texts are fine; repeated rows stay rows; the four columns replace any of the same names; an empty df
    gives an empty result. No shuffle: one vectorised pass.
    """
    own = F.lower(F.col(unit)) if unit else F.lit(None).cast("string")
    other = F.col(evidence).cast("long") if evidence else F.lit(None).cast("long")
    read = df.withColumn("__a", F.when(F.col(text).rlike(r"\d"), _altitudes(F.col(text), own, F.lit(" ".join(units)), other)))
    return (
        read.withColumn("low_m", F.col("__a.low")).withColumn("high_m", F.col("__a.high")).withColumn("unit_unique", F.col("__a.only")).withColumn("unit_residual", F.col("__a.residual")).drop("__a")
    )


def agreed_altitude(df: DataFrame, key: str, low: str) -> DataFrame:
    """key, evidence_m: the altitude that all rows of a key give, to about a fiftieth or a metre; keys whose rows differ, and null and
    blank keys, give none. One aggregate with partial sums, whatever the number of rows of a key."""
    same = df.where(F.col(low).isNotNull() & (F.length(F.trim(F.col(key).cast("string"))) > 0)).groupBy(key).agg(F.min(low).alias("__a"), F.max(low).alias("__b"))
    return same.where((F.col("__b") - F.col("__a") <= 1) | ((F.col("__a") > 0) & (F.log(F.col("__b") / F.col("__a")) <= SAME))).select(key, F.col("__a").alias("evidence_m"))


def identity_units(df: DataFrame, terms: Sequence[tuple[str, int, Sequence[str]]], factors: Mapping[str, float], tolerance: float = SAME) -> DataFrame:
    """Choose the units of numeric columns by the identity product((value * factor) ** exponent) = 1, such as mass / (density * volume) = 1.

    terms: (column, exponent, units it may have). Adds unit_<column>, base_<column> (the value in base units), identity_residual (the
    least |log residual|) and units_unique (false where another combination lies within tolerance of the best). All combinations are
    scored in one projection, without shuffle or Python. Null, zero, negative and non-finite values leave units and bases null and
    units_unique false, as the identity says nothing about them. Columns with the new names are replaced.
    """
    usable = F.lit(True)
    for c, _, _ in terms:
        v = F.col(c).cast("double")
        usable = usable & F.coalesce((v > 0) & (v < float("inf")), F.lit(False))
    combos = list(product(*[units for _, _, units in terms]))
    scored = []
    for i, combo in enumerate(combos):
        r = F.lit(0.0)
        for (c, k, _), u in zip(terms, combo, strict=True):
            r = r + k * F.log(F.when(usable, F.col(c).cast("double") * float(factors[u])).otherwise(1.0))
        scored.append(F.struct(F.round(F.abs(r), 9).alias("r"), F.lit(i).alias("i")))
    out = df.withColumn("__s", F.array(*scored)).withColumn("__b", F.array_min("__s"))
    out = out.withColumn("identity_residual", F.when(usable, F.col("__b.r")))
    out = out.withColumn("units_unique", usable & (F.size(F.filter("__s", lambda s: s["r"] <= F.col("__b.r") + tolerance)) == 1))
    for j, (c, _, _) in enumerate(terms):
        unit = F.get(F.array(*[F.lit(combo[j]) for combo in combos]), F.col("__b.i"))
        factor = F.get(F.array(*[F.lit(float(factors[combo[j]])) for combo in combos]), F.col("__b.i"))
        out = out.withColumn(f"unit_{c}", F.when(usable, unit)).withColumn(f"base_{c}", F.when(usable, F.col(c).cast("double") * factor))
    return out.drop("__s", "__b")
