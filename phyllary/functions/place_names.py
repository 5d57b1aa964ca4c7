"""Names of routes and places compared. Pure Python, with vectorised forms."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phyllary.session import arrow_function

#: Common words of route names that tell nothing, taken out in this order (fixed values).
GENERIC = ["forest bathing trail", "hiking trail", "mountain trail", "trail", "road", "track", "登山步道", "森林浴步道", "步道", "登山道", "林道", "古道"]


@dataclass(frozen=True)
class Features:
    """What a name is compared by: its words in a row, its words of three letters or more, and its Han characters two by two."""

    plain: str
    words: frozenset[str]
    pairs: frozenset[str]


def _class(c: str) -> str:
    """han, word (other letters, digits and underscores) or gap."""
    if "㐀" <= c <= "鿿":
        return "han"
    return "word" if c.isalnum() or c == "_" else "gap"


@lru_cache(100_000)
def features(text: str) -> Features:
    t = unicodedata.normalize("NFKC", text).casefold()
    for g in GENERIC:
        t = " ".join(t.split(g))
    runs = [(k, "".join(cs)) for k, cs in groupby(t, _class)]
    plain = "".join(r if k != "gap" else " " for k, r in runs).strip()
    pairs = {r[i : i + 2] for k, r in runs if k == "han" for i in range(0, len(r) - 1, 2)}
    return Features(plain, frozenset(w for w in plain.split() if len(w) > 2), frozenset(pairs))


def _share(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def name_similarity(name: str | None, context: str | None) -> float:
    """1 if one name holds the other, else the greater Jaccard share of words of three letters or of pairs of Han characters."""
    n, c = features(name or ""), features(context or "")
    if not n.plain or not c.plain:
        return 0.0
    if len(n.plain) > 1 and (n.plain in c.plain or c.plain in n.plain):
        return 1.0
    return max(_share(n.words, c.words), _share(n.pairs, c.pairs))


def similarity(name: Column, context: Column) -> Column:
    """name_similarity of two columns."""

    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return arrow_function(compare, "double")(name, context)


def best_similarity(names: Column, context: Column) -> Column:
    """The greatest name_similarity of an array of names, however many; 0 without names."""

    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max((name_similarity(n, c) for n in ns), default=0.0) if ns is not None else 0.0 for ns, c in zip(a, b, strict=True)], dtype="float64")

    return arrow_function(compare, "double")(names, context)
