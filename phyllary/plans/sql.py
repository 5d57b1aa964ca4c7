"""The engine's functions under names for SQL, and the tables as views."""

from __future__ import annotations

from inspect import signature
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phyllary.functions.dates import normal_time
from phyllary.functions.label_coordinates import read_coordinates
from phyllary.functions.place_names import name_similarity
from phyllary.functions.quantities import read_altitude
from phyllary.functions.segments import split_values
from phyllary.operators.environment import parse_habitats
from phyllary.operators.labels import COORDINATE
from phyllary.session import prepare, table

#: Expressions of SQL functions that need no Python: name, parameters, return type, body.
EXPRESSIONS = [
    ("great_circle_m", "lat1 double, lon1 double, lat2 double, lon2 double", "double", "2 * 6371008.8D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    ("plain_code", "t string", "string", "regexp_replace(upper(coalesce(t, '')), '[^A-Z0-9]+', '')"),
    ("plain_words", "t string", "string", "trim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' '))"),
]


def register(spark: SparkSession) -> list[str]:
    """Temporary functions: normal_date (text, date order), normal_time (also the zone of a local time), altitude_low, altitude_high, coordinates, name_similarity, known_habitats, split_names,
    split_addresses and those of EXPRESSIONS. Gives their names."""
    prepare(spark)

    def each(f, kind: str):
        """A function of values as one of whole columns; each distinct input of a batch is worked on once."""

        def run(columns: tuple[pd.Series, ...]) -> pd.Series:
            memo: dict = {}
            out = []
            for key in zip(*[c.where(c.notna(), None) for c in columns], strict=True):
                if key not in memo:
                    memo[key] = f(*key)
                out.append(memo[key])
            return pd.Series(out, dtype=object)

        def one(a: pd.Series) -> pd.Series:
            return run((a,))

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run((a, b))

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run((a, b, c))

        return F.pandas_udf({1: one, 2: two, 3: three}[len(signature(f).parameters)], kind)

    functions = {
        "normal_date": each(lambda t, order: normal_time(t, order), "string"),
        "normal_time": each(lambda t, order, zone: normal_time(t, order, zone), "string"),
        "altitude_low": each(lambda t, unit: (read_altitude(t, (unit,) if unit else ()) or (None,))[0], "long"),
        "altitude_high": each(lambda t, unit: (read_altitude(t, (unit,) if unit else ()) or (None, None))[1], "long"),
        "coordinates": each(lambda t: read_coordinates(t), COORDINATE),
        "name_similarity": each(lambda a, b: name_similarity(a, b), "double"),
        "known_habitats": each(lambda t: parse_habitats(t)[0], "array<string>"),
        "split_names": each(lambda t: split_values(t, "name", None), "array<string>"),
        "split_addresses": each(lambda t: split_values(t, "address", None), "array<string>"),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    for name, parameters, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*functions, *[e[0] for e in EXPRESSIONS]]


def register_tables(spark: SparkSession, folder: str) -> list[str]:
    """Every Parquet table of a folder as a temporary view."""
    names = sorted(p.name.removesuffix(".parquet") for p in Path(folder).glob("*.parquet"))
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
    return names
