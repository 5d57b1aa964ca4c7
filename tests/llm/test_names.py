from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phyllary.llm.name_variants import link_names, name_links, parsed_names, star_clusters, variant_pairs
from phyllary.llm.names import bands_for, name_similarity, one_edit, parse_name, within_edits

SAME = [
    ("Theodor B. Larkseimholm", "LARKSEIMHOLM, T."), ("Larkseimholm, Theodor B.", "T. Larkseimolm"), ("Paco Dreildguostra", "Dreildguostra, F."), ("Dr. F. Stoseilholm", "Francisco Stoseilholm"), ("Tulstaross U.A.", "Ursula Tulstaross"), ("Thedoor Breldmaanda", "Theodor Breldmaanda"),
    ("The Skähaiross Survey of Rivers and Coasts", "Survey of Rivers and Coasts, Skähaiross"), ("Gidremedo Surv. of Rivers & Coasts", "Gidremedo Survey of Rivers and Coasts"), ("Baskoberg Forest Dept.", "The Baskoberg Forest Department"), ("Fomdenholm Nat. Hist. Soc.", "Fomdenholm Natural History Society"),
]
OTHERS = [("Theodor Larkseimholm", "Yevgenia Larkseimholm"), ("Ottilie Delmostra", "Delmostra W.K."), ("O. M. Reisross", "O. K. Reisross"), ("Brolmtainara Alpine Survey", "Hilduliross Alpine Survey"), ("Hilduliross Alpine Survey", "Hilduliross Geological Institute"), ("Delmostra", "Ottilie Delmostra")]


def _similar(a, b):
    ka, ma, oa, *_ = parse_name(a)
    kb, mb, ob, *_ = parse_name(b)
    return name_similarity(ka, ma, oa, mb, ob) if ka == kb else 0.0


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert _similar(a, b) >= 0.9 and _similar(b, a) >= 0.9


@pytest.mark.parametrize(("a", "b"), OTHERS)
def test_others(a, b):
    assert _similar(a, b) < 0.9


def test_one_edit_and_bands():
    assert one_edit("abcd", "abdc") and one_edit("abc", "abcd") and one_edit("abcd", "axcd") and not one_edit("abcd", "abcd") and not one_edit("abcd", "badc") and not one_edit("a", "abc")
    b = bands_for(0.5, 0.99, 2)
    assert 1 - (1 - 0.25) ** b >= 0.99 > 1 - (1 - 0.25) ** (b - 1)


def _people(n):
    rnd = random.Random(3)
    given = ["Johannes", "Theodor", "Katharina", "William", "Ottilie", "Zachary"]
    out = []
    for i in range(n):
        s = "".join(rnd.choice(["bra", "kel", "mor", "stu", "vin", "zel", "dro", "nak", "ari", "ost"]) for _ in range(4)).capitalize()
        g = rnd.choice(given)
        k = rnd.randrange(1, len(s) - 2)
        out.append([f"{g} {s}", f"{s}, {g[0]}.", f"{s} {g}", f"{g[0]}.{s[:k]}{s[k + 1 :]}", f"{g} {s[:k]}{s[k + 1]}{s[k]}{s[k + 2 :]}".lower()])
    return out


def test_clusters_of_made_people(spark):
    people = _people(60)
    names = sorted({x for p in people for x in p})
    df = spark.createDataFrame([(x, 5 if x == people[0][0] else 1) for x in names], "name string, n long")
    linked = {r.name: r.center for r in link_names(df).collect()}
    assert set(linked) == set(names)
    want = {tuple(sorted((a, b))) for p in people for a in p for b in p if a < b}
    got = {(r.name_a, r.name_b) for r in variant_pairs(link_names(df)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)


def test_banding_finds_what_brute_force_finds(spark):
    names = sorted({x for p in _people(40) for x in p})
    parsed = parsed_names(spark.createDataFrame([(x, 1) for x in names], "name string, n long"))
    rows = parsed.collect()
    brute = {(a.name, b.name) for a in rows for b in rows if a.name < b.name and a.kind == b.kind and name_similarity(a.kind, a.main, a.others, b.main, b.others) >= 0.9}
    got = {(r.name_a, r.name_b) for r in name_links(parsed).collect()}
    assert got <= brute and len(got) >= 0.97 * len(brute)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("  ", 1), ("Cher", 1), ("x" * 20_000, 1), ("A. Bee", 1), ("Bee, A.", 3)], "name string, n long")
    got = {r.name[:10]: r.center[:10] for r in link_names(df).collect()}
    assert got["Cher"] == "Cher" and got["A. Bee"] == got["Bee, A."] and len(got) == 4
    assert link_names(df.limit(0)).count() == 0


def test_star_centers_are_not_linked(spark):
    rnd = random.Random(1)
    names = [f"n{i}" for i in range(40)]
    edges = {tuple(sorted(rnd.sample(names, 2))) for _ in range(70)}
    links = spark.createDataFrame([(a, b, rnd.choice([0.9, 0.95])) for a, b in sorted(edges)], "name_a string, name_b string, similarity double")
    full = spark.createDataFrame([(x, rnd.randint(1, 3), rnd.randint(0, 1)) for x in names], "name string, n long, rank_full int")
    got = {r.name: r.center for r in star_clusters(full, links).collect()}
    assert set(got) == set(names)
    centers = set(got.values())
    assert all(got[c] == c for c in centers) and not any(a in centers and b in centers for a, b in edges)
    assert all(x == c or tuple(sorted((x, c))) in edges for x, c in got.items())


def test_more_edits_link_transliterations(spark):
    assert within_edits("tchaikovsky", "chaikovski", 2) and not within_edits("tchaikovsky", "chaikovski", 1) and within_edits("abcd", "badc", 2) and not within_edits("abcd", "wxyz", 3) and not within_edits("same", "same", 2)
    df = spark.createDataFrame([("P. Tchaikovsky", 3), ("P. Chaikovski", 1), ("Ole Hansen", 2), ("Ola Hanssen", 1), ("P. Mussorgsky", 1)], "name string, n long")
    links = {c: [r.name for r in link_names(df, target=0.3, edits=2).where(F.col("center") == c).collect()] for c in ("P. Tchaikovsky", "Ole Hansen")}
    assert set(links["P. Tchaikovsky"]) == {"P. Tchaikovsky", "P. Chaikovski"}
    assert {r.name for r in link_names(df).where("name <> center").collect()} == set()
