"""Several values packed in one field: one row for each, with its place (problem 1)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phyllary.functions.segments import ADDRESS_STARTS, AND_WORDS, ATOMS, BEFORE_ADDRESS, automaton, runs, split_values
from phyllary.session import arrow_function, durable, in_batches

#: Known whole values, and characters in them, up to which every worker holds the automaton of all; beyond it each batch gets its own.
DICTIONARY_ROWS, DICTIONARY_CHARS = 200_000, 20_000_000
#: Parts that a frequent value is dealt out to where a large dictionary is joined.
SALTS = 8
#: Fields that may hold several values, by kind; others are taken as they are.
MAYBE_SEVERAL = {
    "name": r"(?i)[;|,+/\n\t\r\"'“«\[]|\s(?:" + "|".join(w for w in AND_WORDS if w != "&") + r"|&)\s",
    "address": r"(?s)\S[\s,;|\"'<]+\S",
    "language": r"[\s,;|&+\[\"]",
}
_STARTS = rf"(?i)(?:^|{BEFORE_ADDRESS})((?:{'|'.join(map(re.escape, ADDRESS_STARTS))}))"
_worker: dict = {}


def known_values(df: DataFrame, text: str, kind: str) -> DataFrame:
    """The whole values that stand alone in a field: distinct, with the column value. An address stands alone where the field has one
    start of an address and single marks without blanks behind it; its figures count as one figure, so that there are as many as there are ways of
    writing addresses."""
    v = F.trim(F.col(text))
    several = F.col("value").rlike(MAYBE_SEVERAL[kind])
    if kind == "address":
        starts = F.size(F.regexp_extract_all("value", F.lit(_STARTS), 1))
        several = F.when(starts == 1, F.col("value").rlike(r"\s|[;,|]{2}") | ~F.col("value").rlike(rf"^{_STARTS}")).otherwise(several)
    alone = df.select(v.alias("value")).where((F.length("value") > 0) & ~several)
    return (alone.select(F.regexp_replace("value", r"\d+", "0").alias("value")) if kind == "address" else alone).distinct()


def _splitter(kind: str, known):
    token = uuid.uuid4().hex

    def split(texts: pd.Series) -> pd.Series:
        if _worker.get("token") != token:
            _worker.update(token=token, automaton=automaton(known.value) if known is not None else None)
        memo: dict = {}
        a = _worker["automaton"]
        out = []
        for t in texts:
            if t not in memo:
                memo[t] = split_values(t, kind, a)
            out.append(memo[t])
        return pd.Series(out, dtype=object)

    return arrow_function(split, "array<string>")


def _split_by_batches(rows: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """rows(__id, __text) with __items, for dictionaries of any size: every run of a text's atoms, as long as the longest known value, is
    joined to the known values by equality, and each batch of texts has an automaton of its own known values. A run that many texts
    have is dealt out to several parts."""

    def count_atoms(values: pd.Series) -> pd.Series:
        return pd.Series([len(ATOMS[kind](v).spans) for v in values], dtype="int64")

    longest = known.select(F.max(arrow_function(count_atoms, "long")("value"))).first()[0] or 1

    def tries(texts: pd.Series) -> pd.Series:
        return pd.Series([runs(t, kind, longest) for t in texts], dtype=object)

    tried = rows.select("__id", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).alias("__salt"), F.explode(arrow_function(tries, "array<string>")("__text")).alias("value"))
    salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = tried.join(salted, ["value", "__salt"]).groupBy("__id").agg(F.collect_list("value").alias("__known"))
    both = rows.join(hits, "__id", "left")
    schema = both.drop("__known").schema.add("__items", T.ArrayType(T.StringType()))

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = automaton({v for vs in b["__known"] if vs is not None for v in vs})
            b["__items"] = [split_values(t, kind, a) for t in b["__text"]]
            yield b.drop(columns="__known")

    return in_batches(both, per_batch, schema)


def split_packed(df: DataFrame, text: str, kind: str, known: DataFrame | None = None, single: bool = False, dictionary_rows: int = DICTIONARY_ROWS, dictionary_chars: int = DICTIONARY_CHARS) -> DataFrame:
    """One row for each value in a field: df's columns, item_no (from 1 in the order of the text) and item_text (as written, without
    blanks, quotes or brackets around it).

    kind: name (people and bodies), address or language. known: whole values, distinct, column value, such as known_values() gives; they
    protect marks inside them. Fields with fewer than two values give no rows, or with single=True their one value. Null and blank
    texts give none; very long texts are split whole; repeated rows are split each. Columns item_no and item_text of df are replaced. An
    empty df gives an empty result. Up to dictionary_rows known values of dictionary_chars characters (counted only so far) each
    worker holds them all, and no row is shuffled; larger dictionaries are joined to the runs of the texts. Both ways give the same rows.
    """
    df = df.drop("item_no", "item_text")
    several = df.where(F.col(text).rlike(MAYBE_SEVERAL[kind]))
    values = None
    if known is not None:
        known = durable(known)
        size = known.limit(dictionary_rows + 1).agg(F.count("*"), F.sum(F.length("value"))).first()
        if size[0] <= dictionary_rows and (size[1] or 0) <= dictionary_chars:
            values = df.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()])
    if known is None or values is not None:
        out = several.withColumn("__items", _splitter(kind, values)(F.col(text)))
    else:
        rows = several.withColumn("__id", F.xxhash64(F.col(text))).withColumn("__text", F.col(text))
        texts = rows.select("__id", "__text").dropDuplicates(["__text"])
        out = rows.join(_split_by_batches(texts, known, kind), ["__id", "__text"]).drop("__id", "__text")
    out = out.where(F.size("__items") >= (1 if single else 2))
    if single:
        # the rest has one value, the text itself
        one = df.where(~F.col(text).rlike(MAYBE_SEVERAL[kind]) & (F.length(F.trim(F.col(text))) > 0)).withColumn("__items", F.array(F.trim(F.col(text))))
        out = out.unionByName(one)
    return out.select(*df.columns, F.posexplode("__items").alias("item_no", "item_text")).withColumn("item_no", (F.col("item_no") + 1).cast("long"))
