from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phyllary.llm.canonical import Automaton, Reference, Trie, allowed, entries_within, load_reference, map_to_list

ROWS = [
    (1, "country", "Quillaria", "QLR", None, None), (2, "country", "Côte Amarine", "CAM", None, "Amarine Coast"), (3, "country", "Suvanto", "SVT", None, None),
    (4, "state_province", "Northern Province", "QLR-01", 1, None), (5, "state_province", "Northern Province", "CAM-01", 2, None), (6, "state_province", "Raskamiyan", "QLR-02", 1, "Old Rask"),
    (7, "institution_code", "Museum of Natural History Räbriovia", "KJV", None, "Ra Cabinet"), (8, "institution_code", "University of Haldtaberg", "UHAM", None, None),
]
R = Reference(ROWS)
CASES = [
    ("country", "Quillaria", None, (1, "exact")), ("country", " Quillaria", None, (1, "mapped")), ("country", "QUILALRIA", None, (1, "mapped")), ("country", "Cote Amarine", None, (2, "mapped")), ("country", "amarine coast", None, (2, "mapped")),
    ("country", "Suvanto, Rep. of", None, (3, "mapped")), ("country", "Republic of Suvanto", None, (3, "mapped")), ("country", "Suvanto (mainland)", None, (3, "mapped")), ("country", "[Suvanto]", None, (3, "mapped")), ("country", "qlr", None, (1, "mapped")),
    ("country", "Kingdom of Elsewhere", None, (0, "none")), ("country", "??", None, (0, "none")), ("state_province", "Northern Province", "Quillaria", (4, "exact")), ("state_province", "NORTHERN PROVINCE", "cam", (5, "mapped")), ("state_province", "Northern orovince", "Côte Amarine", (5, "mapped")),
    ("state_province", "Northern Province?", None, (None, "ambiguous")), ("state_province", "Northern Province, Quillaria", None, (4, "mapped")), ("state_province", "Raskam.", None, (6, "mapped")), ("state_province", "Prov. Raskamiyan", "x", (6, "mapped")), ("state_province", "Raskamiyan State", "x", (6, "mapped")),
    ("institution_code", "K.J.V.", None, (7, "mapped")), ("institution_code", "Herb. KJV", None, (7, "mapped")), ("institution_code", "KJV (herbarium)", None, (7, "mapped")), ("institution_code", "Museum of Nat. Hist. Rabriovia", None, (7, "mapped")), ("institution_code", "Univ. of Haldtaberg", None, (8, "mapped")),
    ("institution_code", "KJW", None, (0, "none")), ("institution_code", "University of Haldtaberg", None, (8, "mapped")), ("institution_code", "UHAM", None, (8, "exact")),
]


@pytest.mark.parametrize(("kind", "text", "owner", "want"), CASES)
def test_resolve(kind, text, owner, want):
    entry, _, status = R.resolve(kind, text, owner)
    assert (entry, status) == want


def _distance(a: str, b: str) -> int:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return rows[-1][-1]


word = st.text("abc", max_size=7)


@settings(max_examples=400, deadline=None)
@given(word, st.sets(word.filter(bool), min_size=1, max_size=12), st.integers(0, 2))
def test_search_equals_brute_force(w, words, k):
    trie, listed = Trie(), sorted(words)
    for i, x in enumerate(listed):
        trie.add(x, i)
    assert trie.near(w, k) == {i: d for i, x in enumerate(listed) if (d := _distance(w, x)) <= k}
    a = Automaton(w, k)
    for x in listed:
        s = a.start
        for c in x:
            s = a.step(s, c)
        assert a.distance(s) == (d if (d := _distance(w, x)) <= k else None)


def test_rows(spark):
    entries = spark.createDataFrame(ROWS, "entry_id long, kind string, entry_name string, entry_code string, parent_id long, aliases string")
    rows = [(1, "QUILLARIA", "northern province", "KJV"), (2, None, "", "x" * 100_000), (1, "QUILLARIA", "northern province", "KJV"), (3, "nowhere", "--", None)]
    df = spark.createDataFrame(rows, "seq long, country string, state_province string, institution_code string").selectExpr("*", "'old' as entry_id")
    fields = {f: f for f in ("country", "state_province", "institution_code")}
    out = map_to_list(df, fields, entries, "country")
    got = sorted(((r.seq, r.field_name, r.entry_id, r.map_status) for r in out.collect()), key=str)
    assert got == sorted(2 * [(1, "country", 1, "mapped"), (1, "state_province", 4, "mapped"), (1, "institution_code", 7, "exact")] + [
        (2, "country", None, "blank"), (2, "state_province", None, "blank"), (2, "institution_code", 0, "none"), (3, "country", 0, "none"), (3, "state_province", 0, "none"), (3, "institution_code", None, "blank")], key=str)
    assert map_to_list(df.limit(0), fields, entries, "country").count() == 0
    assert map_to_list(df, fields, entries.limit(0), "country").where("entry_id > 0").count() == 0
    with pytest.raises(ValueError):
        load_reference(entries, rows=2)


def test_allowed_grows_with_length():
    assert [allowed(n) for n in (3, 4, 5, 11, 12)] == [0, 0, 1, 1, 2]


def test_all_entries_within_the_distance(spark):
    entries = spark.createDataFrame([(1, "country", "Norlandia", "NL", None, "Norlanda"), (2, "country", "Morlandia", "MO", None, None), (3, "country", "Elsewhere", "EL", None, None)], "entry_id long, kind string, entry_name string, entry_code string, parent_id long, aliases string")
    df = spark.createDataFrame([(1, "Norlandia"), (2, "norlandi"), (3, "nowhere at all"), (4, None), (5, " "), (1, "Norlandia")], "id int, t string").selectExpr("*", "'x' as distance")
    got = sorted((r.id, r.entry_id, r.distance) for r in entries_within(df, "t", "country", entries).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 1), (1, 2, 1), (2, 1, 1)] and entries_within(df.limit(0), "t", "country", entries).count() == 0
