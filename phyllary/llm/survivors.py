"""One surviving record for each group of duplicates (problem 4): consistent bundles of fields, chosen by branch and bound."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.sphere import degrees
from phyllary.llm.canonical import Reference, load_reference
from phyllary.session import arrow_function, durable

#: Rows of a group with dependent bundles up to which it is searched in one task; larger ones are solved by joins.
GROUP_COMBINATIONS = 4096
#: Texts that name no place.
NO_PLACE = ["", "-", "--", "?", "illegible", "unknown", "no locality", "s.loc.", "s. loc.", "s.l.", "n/a", "na", "none", "not recorded", "no data", "not stated", "sine loco", "sin datos", "locality lost", "see label", "unlocalised", "unlocalized", "null"]


#: Words before a number that name no holder.
NUMBER_WORDS = {"NO", "NR", "NUM", "NUMBER"}

_NUMBER, _LETTERS = re.compile(r"\d[\d\s./-]*"), re.compile(r"[^\W\d_]+")
_worker: dict = {}


@dataclass(frozen=True)
class Bundle:
    """Fields that survive together, from one member; usable says whether a member's values may."""

    name: str
    columns: Sequence[str]
    usable: Column


def catalogue_parts(text: str | None) -> tuple[str, str] | None:
    """(letters before the number, number without marks and leading zeros) of a catalogue number, None without a digit."""
    up = (text or "").upper().replace("N°", " ").replace("Nº", " ")
    found = _NUMBER.search(up)
    if not found:
        return None
    letters = "".join(w for w in _LETTERS.findall(up[: found.start()]) if w not in NUMBER_WORDS)
    return letters, re.sub(r"\D", "", found[0]).lstrip("0") or "0"


def catalogue_key(records: DataFrame, entries: DataFrame) -> DataFrame:
    """records with holder and number: the holding institution and the catalogue number apart from writing.

    The letters in front of the number name the holder, else the institution_code's entry does. Both null for records without a
    catalogue number (blank, null, no digit, such as "s.n.") or without a known holder. One vectorised pass.
    """
    sent, token = records.sparkSession.sparkContext.broadcast(load_reference(entries)), uuid.uuid4().hex

    def key(catalogue: pd.Series, institution: pd.Series) -> pd.DataFrame:
        if _worker.get("token") != token:
            _worker.update(token=token, reference=Reference(sent.value))
        reference, out = _worker["reference"], []
        for text, code in zip(catalogue, institution, strict=True):
            parts, holder = catalogue_parts(text), None
            if parts:
                holder = parts[0]
                # only numbers without letters need the list
                if not holder and code and code.strip():
                    entry = reference.resolve("institution_code", code, None)[0]
                    holder = reference.listed.get(entry) if entry else None
            out.append((holder, parts[1]) if holder else (None, None))
        return pd.DataFrame(out, columns=["holder", "number"], dtype=object)

    made = arrow_function(key, "struct<holder:string,number:string>")(F.col("catalog_number"), F.col("institution_code"))
    return records.withColumn("__k", made).withColumn("holder", F.col("__k.holder")).withColumn("number", F.col("__k.number")).drop("__k")


def names_place(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.isin(NO_PLACE) & t.rlike(r"(?U)\p{L}")


def usable_latitude(text: Column) -> Column:
    v = degrees(text)
    return F.coalesce(v.between(-90, 90) & (v != 0), F.lit(False))


def branch_and_bound(candidates: Sequence[Sequence[tuple]], links: Sequence[tuple[int, int, set]]) -> list | None:
    """One candidate for each bundle with the highest sum of gains under the dependencies.

    candidates: for each bundle its (gain, recent, -id); a bundle without any gets None. links: (x, y, allowed): bundle x's choice
    determines y's: the pair (id of x, id of y) must be in allowed, where (id of x, None) allows any y. Ties go to the larger
    (recent, -id) bundle by bundle. None if no choice is consistent, which dependencies that form a forest cannot bring about.
    """
    ordered = [sorted(c, reverse=True) for c in candidates]
    ahead = [0] * (len(ordered) + 1)
    for i in range(len(ordered) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (ordered[i][0][0] if ordered[i] else 0)
    best: list = [None, None]

    def fits(chosen: list, i: int) -> bool:
        for x, y, allowed in links:
            if max(x, y) == i and min(x, y) < i and (a := chosen[x]) and (b := chosen[y]):
                if (-a[2], -b[2]) not in allowed and (-a[2], None) not in allowed:
                    return False
        return True

    def go(i: int, chosen: list, total: int) -> None:
        # nothing ahead can lift the total above what is known
        if best[0] is not None and (total + ahead[i] < best[0][0] or i == len(ordered) and (total, [c[1:] if c else ("", 0) for c in chosen]) <= (best[0][0], best[0][1])):
            return
        if i == len(ordered):
            best[0], best[1] = (total, [c[1:] if c else ("", 0) for c in chosen]), list(chosen)
            return
        for c in ordered[i] or [None]:
            if best[0] is not None and c and total + c[0] + ahead[i + 1] < best[0][0]:
                break
            chosen.append(c)
            if fits(chosen, i):
                go(i + 1, chosen, total + (c[0] if c else 0))
            chosen.pop()

    go(0, [], 0)
    return best[1]


def _lists(free, rows, bundles: int, links: list[tuple[int, int]]) -> tuple[list, list]:
    """Candidates of each bundle, the best row of each distinct value, and the pairs of values that rows bear, for branch_and_bound.

    free: the single best rows of bundles without dependency. rows: what each row of the group (id) gives for the dependent bundles, with
    two hashes that stand for the value."""
    lists: list = [[] for _ in range(bundles)]
    for c in free if free is not None else []:
        lists[c["b"]].append((c["gain"], c["recent"] or "", -c["id"]))
    best: dict[tuple, tuple] = {}
    held: dict[int, dict] = {}
    for c in rows if rows is not None else []:
        value, order = (c["b"], c["ha"], c["hb"]), (c["gain"], c["recent"] or "", -c["id"])
        held.setdefault(c["id"], {})[c["b"]] = value
        if value not in best or order > best[value]:
            best[value] = order
    borne = held.values()
    for (b, _, _), order in best.items():
        lists[b].append(order)
    allowed = []
    for x, y in links:
        pairs = {(v[x], v.get(y)) for v in borne if x in v}
        full = {a for a, b in pairs if b is not None}
        # a value of x that no row bears with a value of y allows any
        allowed.append((x, y, {(-best[a][2], None if b is None else -best[b][2]) for a, b in pairs if b is not None or a not in full}))
    return lists, allowed


def _solver(bundles: int, links: list[tuple[int, int]]):
    def solve(free: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for fs, rs in zip(free, rows, strict=True):
            chosen = branch_and_bound(*_lists(fs, rs, bundles, links))
            out.append([None if not c else -c[2] for c in chosen or [None] * bundles])
        return pd.Series(out, dtype=object)

    return arrow_function(solve, "array<long>")


def choose_survivors(
    df: DataFrame, group: Sequence[str], bundles: Sequence[Bundle], trust: str, recent: str, key: str, dependencies: Sequence[tuple[str, str]] = (), combinations: int = GROUP_COMBINATIONS
) -> DataFrame:
    """For each group of two or more rows: the group columns, group_seq (its smallest key), group_size and for each bundle the key of
    the row whose values survive (<bundle>_seq, null if no row's are usable).

    Bundles without dependency take the usable row with the most fields filled, then the smallest trust rank (null ranks last), then
    the greatest text in recent, then the smallest key: that row is in every optimum, so only it goes to the search. A dependency
    (x, y) says that the values of bundle x determine those of y: the chosen pair must be borne by a row of the group, or x's values
    by no row with usable values of y. Such bundles are chosen together, by branch and bound over the group's distinct values, so
    that the summed gains are highest, ties bundle by bundle as above. Groups of more than combinations rows are solved exactly by
    joins instead. Dependencies must form a forest in which each bundle is determined by at most one other.

    Rows with a null in a group column belong to no group; keys must be distinct and not null. An empty df gives an empty result.
    """
    names = [b.name for b in bundles]
    deps = [(names.index(x), names.index(y)) for x, y in dependencies]
    linked = {i for d in deps for i in d}
    if len({y for _, y in deps}) < len(deps):
        raise ValueError("a bundle may be determined by one other only")
    g = list(group)
    rows = df
    for c in g:
        rows = rows.where(F.col(c).isNotNull())
    filled = [sum((F.when(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0, 1).otherwise(0) for c in b.columns), F.lit(0)) for b in bundles]
    tr = F.coalesce(F.col(trust).cast("long"), F.lit(999_999))
    orders = [F.when(b.usable, F.struct((n.cast("long") * 1_000_000 - tr).alias("gain"), F.coalesce(F.col(recent).cast("string"), F.lit("")).alias("recent"), (-F.col(key)).alias("k"))) for b, n in zip(bundles, filled, strict=True)]
    work = rows.select(*g, F.col(key).alias("__key"), *[o.alias(f"__o{i}") for i, o in enumerate(orders)], *[F.when(b.usable, F.struct(*[F.col(c) for c in b.columns])).alias(f"__v{i}") for i, b in enumerate(bundles) if i in linked])
    order = sorted(linked)
    free = [i for i in range(len(bundles)) if i not in linked]

    def candidate(i: int, o: Column) -> list[Column]:
        return [F.lit(i).alias("b"), o["gain"].alias("gain"), o["recent"].alias("recent"), (-o["k"]).alias("id")]

    def solved(groups: DataFrame, rows: Column) -> DataFrame:
        own = F.filter(F.array(*[F.when(F.col(f"__t{i}").isNotNull(), F.struct(*candidate(i, F.col(f"__t{i}")))) for i in free]), lambda c: c.isNotNull()) if free else F.lit(None).cast("array<struct<b:int,gain:long,recent:string,id:long>>")
        out = groups.withColumn("__c", _solver(len(bundles), deps)(own, rows))
        return out.select(*g, "group_seq", "group_size", *[F.get("__c", i).alias(f"{names[i]}_seq") for i in range(len(bundles))])

    main = [F.min("__key").alias("group_seq"), F.count("*").alias("group_size"), *[F.max(f"__o{i}").alias(f"__t{i}") for i in free]]
    if not deps:
        return solved(work.groupBy(*g).agg(*main).where("group_size > 1"), F.lit(None).cast("array<struct<b:int,ha:long,hb:long,gain:long,recent:string,id:long>>"))

    # at most one group for every so many rows
    large = durable(work.groupBy(*g).count().where(F.col("count") > combinations).select(*g))
    none = large.isEmpty()
    small = work if none else work.join(F.broadcast(large), g, "left_anti")
    # what a row gives for the dependent bundles; values go as two hashes of 64 bits each
    given = F.filter(F.array(*[F.when(F.col(f"__o{i}").isNotNull(), F.struct(F.lit(i).alias("b"), F.xxhash64(f"__v{i}").alias("ha"), F.xxhash64(f"__v{i}", F.lit("2")).alias("hb"), *candidate(i, F.col(f"__o{i}"))[1:])) for i in order]), lambda c: c.isNotNull())
    grouped = small.groupBy(*g).agg(*main, F.flatten(F.collect_list(given)).alias("__rows")).where("group_size > 1")
    one = solved(grouped, F.col("__rows"))
    if none:
        return one

    # groups of more rows are solved by joins; the best row of each distinct value stands for the value
    crowd = work.join(F.broadcast(large), g, "left_semi")
    top = crowd.groupBy(*g).agg(*main)
    combos = crowd.groupBy(*g, *[f"__v{i}" for i in order]).agg(*[F.max(f"__o{i}").alias(f"__o{i}") for i in order])
    for i in order:
        best = combos.where(F.col(f"__v{i}").isNotNull()).groupBy(*g, f"__v{i}").agg(F.max(f"__o{i}").alias(f"__b{i}"))
        combos = combos.join(best, [combos[c].eqNullSafe(best[c]) for c in [*g, f"__v{i}"]], "left").select(combos["*"], best[f"__b{i}"])
    combos = durable(combos.select(*g, *[F.col(f"__b{i}") for i in order]))
    two = _by_joins(combos, g, order, deps)
    two = top.join(two, g).select(*g, "group_seq", "group_size", *[(F.col(f"__k{i}") if i in linked else -F.col(f"__t{i}.k")).alias(f"{names[i]}_seq") for i in range(len(bundles))])
    return one.unionByName(two)


def _by_joins(combos: DataFrame, g: list[str], order: list[int], deps: list[tuple[int, int]]) -> DataFrame:
    """The optimum of each group by messages along the dependencies, leaves first: for each value of x the best value of y that may go
    with it; no group is ever in one task. Roots are chosen last, each by its own gain and what depends on it. A group without any
    value of a bundle has the empty value there, with which any value of what depends on it may go."""
    children: dict[int, list[int]] = {}
    for x, y in deps:
        children.setdefault(x, []).append(y)
    roots = [i for i in order if i not in {y for _, y in deps}]

    def message(i: int) -> DataFrame:
        """Each value of bundle i with its total: g, id, total (gain, ties), chosen (map bundle -> id)."""
        values = combos.where(F.col(f"__b{i}").isNotNull()).select(*g, F.col(f"__b{i}").alias("o")).distinct()
        out = values.select(*g, (-F.col("o.k")).alias("id"), F.col("o.gain").alias("gain"), F.array(F.struct(F.col("o.recent"), F.col("o.k"))).alias("ties"), F.create_map(F.lit(i), -F.col("o.k")).alias("chosen"))
        without = combos.groupBy(*g).agg(F.count(f"__b{i}").alias("n")).where("n = 0")
        no_tie, none = F.array(F.struct(F.lit("").alias("recent"), F.lit(0).cast("long").alias("k"))), F.create_map().cast("map<int,bigint>")
        out = out.unionByName(without.select(*g, F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("gain"), no_tie.alias("ties"), none.alias("chosen")))
        for y in children.get(i, []):
            below = message(y).select(*g, F.col("id").alias("yid"), F.struct("gain", "ties", "chosen_e").alias("m"))
            seen = combos.where(F.col(f"__b{i}").isNotNull()).select(*g, (-F.col(f"__b{i}.k")).alias("id"), (-F.col(f"__b{y}.k")).alias("yid")).distinct()
            borne = seen.where(F.col("yid").isNotNull()).join(below, [*g, "yid"]).groupBy(*g, "id").agg(F.max("m").alias("m1"))
            lone = below.groupBy(*g).agg(F.max("m").alias("m2"))
            out = out.join(borne, [*g, "id"], "left").join(lone, g, "left").withColumn("m", F.coalesce("m1", "m2"))
            out = out.select(*g, "id", (F.col("gain") + F.coalesce("m.gain", F.lit(0))).alias("gain"), F.concat("ties", F.coalesce("m.ties", F.array().cast("array<struct<recent:string,k:long>>"))).alias("ties"), F.map_concat("chosen", F.coalesce(F.map_from_entries("m.chosen_e"), F.create_map().cast("map<int,bigint>"))).alias("chosen"))
        return out.withColumn("chosen_e", F.map_entries("chosen"))

    result = combos.select(*g).distinct()
    for r in roots:
        best = message(r).groupBy(*g).agg(F.max(F.struct("gain", "ties", "chosen_e")).alias("m"))
        result = result.join(best.select(*g, F.map_from_entries("m.chosen_e").alias(f"__m{r}")), g, "left")
    tree: dict[int, int] = {}
    for r in roots:
        todo = [r]
        while todo:
            i = todo.pop()
            tree[i] = r
            todo += children.get(i, [])
    return result.select(*g, *[F.try_element_at(F.col(f"__m{tree[i]}"), F.lit(i)).alias(f"__k{i}") for i in order])
