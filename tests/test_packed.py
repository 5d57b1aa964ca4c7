from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phyllary.functions.segments import automaton, split_values
from phyllary.operators.packed import known_values, split_packed
from phyllary.plans.core_queries import known_names
from phyllary.session import table

KNOWN = automaton(["Besttärostra Survey of Rivers and Coasts", "Oak, Elm", "Ann Lee", "Baskoberg Forest Department", "Alpine Survey, Hilduliross", "Alpine Team Zermatt, Visp North", "Survey of Rivers, Coasts, Lakes, Bays and Fens", "Bay + Fen; Ltd."])
NAMES = [
    ("Katharina Tulstaross and William Trorkelemukai and KAIRHOLM, N. and Theodor Eloldberg", ["Katharina Tulstaross", "William Trorkelemukai", "KAIRHOLM, N.", "Theodor Eloldberg"]),
    ("Larkseimholm, Theodor B.;Theodor Breldmaanda | B.Neldskomorel", ["Larkseimholm, Theodor B.", "Theodor Breldmaanda", "B.Neldskomorel"]),
    ('["Xaver Trild", "Stosel, Francisco"]', ["Xaver Trild", "Stosel, Francisco"]), ('"P.Gru","D. Fust","Krurk, Robert K."', ["P.Gru", "D. Fust", "Krurk, Robert K."]), ('Guadalupe Heil; "ottilie reis"', ["Guadalupe Heil", "ottilie reis"]),
    ("A. Bee\nCarl Dee et al.", ["A. Bee", "Carl Dee"]), ("Ursula Sai & al.", ["Ursula Sai"]), ("Besttärostra Survey of Rivers and Coasts; A. Bee", ["Besttärostra Survey of Rivers and Coasts", "A. Bee"]),
    ("Alpine Survey, Hilduliross y Johannes Fand", ["Alpine Survey, Hilduliross", "Johannes Fand"]), ("Unheard Survey of Rivers and Coasts", ["Unheard Survey of Rivers", "Coasts"]), ("Tulstaross U.A., Bee, C.", ["Tulstaross U.A.", "Bee, C."]),
    ("Ann Lee / Bob Ray + Cy Dee", ["Ann Lee", "Bob Ray", "Cy Dee"]), ("Smith, John / Alpine Team Zermatt, Visp North", ["Smith, John", "Alpine Team Zermatt, Visp North"]),
    ("J. Smith; Survey of Rivers, Coasts, Lakes, Bays and Fens", ["J. Smith", "Survey of Rivers, Coasts, Lakes, Bays and Fens"]), ("A. Bee, Bay + Fen; Ltd., C. Dee", ["A. Bee", "Bay + Fen; Ltd.", "C. Dee"]), ("Charles Krond", ["Charles Krond"]), ("", []), (None, []), (" ; , ", []),
]


@pytest.mark.parametrize(("text", "values"), NAMES)
def test_names(text, values):
    assert split_values(text, "name", KNOWN) == values


def test_addresses_and_languages():
    url = "https://a.example/q?names=a|b&k=1; http://b.example/view;s=4;z=1, https://c.example/t?bbox=1.2,3.4&l=5"
    assert split_values(url, "address", None) == ["https://a.example/q?names=a|b&k=1", "http://b.example/view;s=4;z=1", "https://c.example/t?bbox=1.2,3.4&l=5"]
    assert split_values("<urn:place:x1> | <doi:10.9/g.2>", "address", None) == ["urn:place:x1", "doi:10.9/g.2"]
    assert split_values("https://a.example/r?to=https://b.example/x", "address", None) == ["https://a.example/r?to=https://b.example/x"]
    # what no rule knows is learnt: an address without a usual start, one with a mark before a figure
    learnt = automaton(["0.0/a|0", "sftp://h.example/0;v=0"])
    assert split_values("https://a.example/1; 10.5555/a|77; sftp://h.example/12;v=3, https://b.example/2", "address", learnt) == ["https://a.example/1", "10.5555/a|77", "sftp://h.example/12;v=3", "https://b.example/2"]
    assert split_values('["zh", "en/la"]', "language", None) == ["zh", "en/la"]
    assert split_values("en/la zh/x", "language", automaton(["zh", "x", "en"])) == ["en/la", "zh/x"]
    assert split_values("fr, de and la", "language", automaton(["fr"])) == ["fr", "de", "la"]
    assert split_values("fi et en", "language", automaton(["et"])) == ["fi", "et", "en"]


GIVEN, SUR = ["Ann", "Bo", "Cleo"], ["Oakley", "Elmsworth", "Ashford"]
name = st.one_of(st.builds("{} {}".format, st.sampled_from(GIVEN), st.sampled_from(SUR)), st.builds("{}, {}.".format, st.sampled_from(SUR), st.sampled_from("ABC")), st.builds("{}. {}".format, st.sampled_from("ABC"), st.sampled_from(SUR)))


@settings(max_examples=150, deadline=None)
@given(st.lists(name, min_size=1, max_size=6), st.sampled_from(["; ", ";", " | ", "|", "\n", " & ", " and ", " et "]))
def test_round_trip(names, mark):
    assert split_values(mark.join(names), "name", None) == names


def test_rows_and_large_dictionaries(spark):
    long = "; ".join(f"A. Name{i}" for i in range(5000))
    rows = [(1, "Ann Lee; Bob Ray"), (2, "Ann Lee"), (3, None), (4, ""), (5, "Oak, Elm and Ann Lee"), (6, long), (1, "Ann Lee; Bob Ray"), (7, " " * 100_000), (8, "Besttärostra Survey of Rivers and Coasts | A. Bee")]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "9 as item_no")
    known = spark.createDataFrame([("Oak, Elm",), ("Ann Lee",), ("Besttärostra Survey of Rivers and Coasts",)], "value string")
    small = sorted((r.id, r.item_no, r.item_text) for r in split_packed(df, "text", "name", known).collect())
    large = sorted((r.id, r.item_no, r.item_text) for r in split_packed(df, "text", "name", known, dictionary_rows=1).collect())
    assert small == large
    assert [x for x in small if x[0] != 6] == [(1, 1, "Ann Lee"), (1, 1, "Ann Lee"), (1, 2, "Bob Ray"), (1, 2, "Bob Ray"), (5, 1, "Oak, Elm"), (5, 2, "Ann Lee"), (8, 1, "Besttärostra Survey of Rivers and Coasts"), (8, 2, "A. Bee")]
    assert sum(x[0] == 6 for x in small) == 5000
    assert split_packed(df.limit(0), "text", "name", known).count() == 0
    assert {r.item_text for r in split_packed(df, "text", "name", single=True).where("id = 2").collect()} == {"Ann Lee"}
    assert {r.value for r in known_values(df, "text", "name").collect()} == {"Ann Lee"}


def test_known_values_of_any_length_and_mark_both_ways(spark):
    values = ["Alpine Team Zermatt, Visp North", "Survey of Rivers, Coasts, Lakes, Bays and Fens", "Bay + Fen; Ltd.", "Mill / Weir Trust", "O'Dea Club, The", "«Nord», Verein"]
    texts = ["Smith, John / Alpine Team Zermatt, Visp North", "J. Smith; Survey of Rivers, Coasts, Lakes, Bays and Fens", "A. Bee + Alpine Team Zermatt, Visp North + C. Dee", "Mill / Weir Trust | A. Bee", "'Alpine Team Zermatt, Visp North', 'A. Bee'",
             "(A. Bee), Bay + Fen; Ltd. and O'Dea Club, The", "«Nord», Verein; A. Bee et al.", '["Mill / Weir Trust", "A. Bee"]', "; ".join(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([(v,) for v in values], "value string")
    small = sorted(map(tuple, split_packed(df, "text", "name", known).select("id", "item_no", "item_text").collect()))
    large = sorted(map(tuple, split_packed(df, "text", "name", known, dictionary_rows=0).select("id", "item_no", "item_text").collect()))
    assert small == large and [x for x in small if x[0] in (0, 1, 3)] == [(0, 1, "Smith, John"), (0, 2, "Alpine Team Zermatt, Visp North"), (1, 1, "J. Smith"), (1, 2, values[1]), (3, 1, "Mill / Weir Trust"), (3, 2, "A. Bee")]
    assert [x[2] for x in small if x[0] == 8][:5] == values[:5]
    # a dictionary too long by characters takes the other way as well
    assert small == sorted(map(tuple, split_packed(df, "text", "name", known, dictionary_chars=10).select("id", "item_no", "item_text").collect()))


def test_addresses_both_ways(spark):
    texts = ["https://a.example/q?n=a|b&k=1", "https://a.example/q?n=a|b&k=7 | 10.5555/x.12", "10.5555/x.3", "http://c.example/v;s=4;z=1", "http://c.example/v;s=5;z=6;;10.5555/x.9", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = known_values(df, "text", "address")
    assert {r.value for r in known.collect()} == {"https://a.example/q?n=a|b&k=0", "0.0/x.0", "http://c.example/v;s=0;z=0"}
    rows = [sorted(map(tuple, split_packed(df, "text", "address", known, dictionary_rows=n).select("id", "item_no", "item_text").collect())) for n in (9, 0)]
    assert rows[0] == rows[1] == [(1, 1, "https://a.example/q?n=a|b&k=7"), (1, 2, "10.5555/x.12"), (4, 1, "http://c.example/v;s=5;z=6"), (4, 2, "10.5555/x.9")]


def test_the_dictionary_protects_names_of_the_data(spark, sf):
    """Without known values a measured part of the names is cut wrongly; with them bodies keep their marks."""
    records = table(spark, sf, "specimen_records").select("seq", "recorded_by")
    known = known_names(spark, sf)
    own = {tuple(r) for r in split_packed(records, "recorded_by", "name", known).collect()}
    bare = {tuple(r) for r in split_packed(records, "recorded_by", "name").collect()}
    assert len(own - bare) > 0.01 * len(own)
