from __future__ import annotations

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phyllary.llm.survivors import Bundle, branch_and_bound, catalogue_key, choose_survivors, names_place, usable_latitude

cand = st.tuples(st.integers(-3, 3), st.sampled_from(["", "a", "b"]), st.integers(-9, -1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(cand, max_size=4, unique_by=lambda c: c[2]), min_size=1, max_size=4), st.data())
def test_branch_and_bound_equals_all_choices(lists, data):
    n = len(lists)
    links = []
    for x, y in [(i, i + 1) for i in range(n - 1)]:
        pairs = [(-a[2], b if b is None else -b[2]) for a in lists[x] for b in [*lists[y], None]]
        links.append((x, y, set(data.draw(st.lists(st.sampled_from(pairs), max_size=6))) if pairs else set()))

    def ok(choice):
        return all(not choice[x] or not choice[y] or (-choice[x][2], -choice[y][2]) in allowed or (-choice[x][2], None) in allowed for x, y, allowed in links)

    every = [c for c in itertools.product(*[one or [None] for one in lists]) if ok(c)]
    best = max(every, key=lambda c: (sum(x[0] for x in c if x), [x[1:] if x else ("", 0) for x in c]), default=None)
    got = branch_and_bound(lists, links)
    assert (got and tuple(got)) == best


def _frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, g string, trust_rank int, accessed_at string, decimal_latitude string, locality string, country string")


def _bundles(*names):
    every = {
        "decimal_latitude": Bundle("decimal_latitude", ["decimal_latitude"], usable_latitude(F.col("decimal_latitude"))),
        "locality": Bundle("locality", ["locality"], names_place(F.col("locality"))),
        "country": Bundle("country", ["country"], F.length(F.trim(F.coalesce("country", F.lit("")))) > 0),
    }
    return [every[n] for n in names]


def test_field_by_field(spark):
    rows = [
        (1, "a", 2, "2024-01-01", "999", "Place", ""), (2, "a", 1, "2024-01-01", "1.5", "-", ""), (3, "a", 1, "2024-01-02", "2.5", "unknown", ""), (4, "a", 1, "2024-01-02", "3.5", None, ""), (5, "a", 2, "2024-02-01", "0.0", "Other", ""),
        (6, "b", 1, None, None, "", ""), (7, "b", None, "2024", "N/A", "s.loc.", ""), (8, "c", 1, "2024", "1", "x", ""), (9, None, 1, "2024", "1", "x", ""), (10, None, 1, "2024", "1", "x", ""), (11, "d", 3, "2024", "x" * 50_000, "y" * 50_000, ""), (12, "d", 3, "2024", "-90", "y" * 50_000, ""),
    ]
    df = _frame(spark, rows)
    got = {(r.g, r.group_seq, r.group_size, r.decimal_latitude_seq, r.locality_seq) for r in choose_survivors(df, ["g"], _bundles("decimal_latitude", "locality"), "trust_rank", "accessed_at", "seq").collect()}
    assert got == {("a", 1, 5, 3, 5), ("b", 6, 2, None, None), ("d", 11, 2, 12, 11)}
    assert choose_survivors(df.limit(0), ["g"], _bundles("locality"), "trust_rank", "accessed_at", "seq").count() == 0


def test_dependent_bundles_by_search_and_by_joins(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abcdef"), rnd.randint(1, 4), rnd.choice(["2023", "2024"]), rnd.choice(["1", "2", "0"]), rnd.choice(["p", "q", "r", "-"]), rnd.choice(["X", "Y", "Z", ""])) for i in range(1, 120)]
    df = _frame(spark, rows)
    args = (["g"], _bundles("locality", "country", "decimal_latitude"), "trust_rank", "accessed_at", "seq", [("locality", "country")])
    searched, joined = choose_survivors(df, *args).collect(), choose_survivors(df, *args, combinations=0).collect()
    assert sorted(map(tuple, searched)) == sorted(map(tuple, joined)) and len(searched) == 6
    by_seq = {r[0]: r for r in rows}
    for r in searched:
        group = [x for x in rows if x[1] == r.g]
        spots = {s: [x for x in group if x[5] == s] for s in "pqr" if any(x[5] == s for x in group)}
        best = max((1_000_000 - min(x[2] for x in spots[s])) + max((1_000_000 - x[2] for x in (spots[s] if any(y[6] for y in spots[s]) else group) if x[6]), default=0) for s in spots)
        assert 2_000_000 - by_seq[r.locality_seq][2] - by_seq[r.country_seq][2] == best
        assert any(x[5] == by_seq[r.locality_seq][5] and x[6] == by_seq[r.country_seq][6] for x in group)


def test_catalogue_key(spark):
    entries = spark.createDataFrame([(1, "institution_code", "Museum of Kew", "KJV", None, None)], "entry_id long, kind string, entry_name string, entry_code string, parent_id long, aliases string")
    rows = [("KJV00000934", "x"), ("kjv.934", ""), ("KJV 00934 ", None), ("No. 934", "Herb. KJV"), ("00000934", "museum of kew"), ("934", "unknown coll."), ("s.n.", "KJV"), (None, "KJV"), ("", "KJV"), ("KJV:935", "KJV")]
    df = spark.createDataFrame(rows, "catalog_number string, institution_code string")
    got = [(r.holder, r.number) for r in catalogue_key(df, entries).collect()]
    assert got == [("KJV", "934")] * 5 + [(None, None)] * 4 + [("KJV", "935")]
