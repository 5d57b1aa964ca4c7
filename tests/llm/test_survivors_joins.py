from __future__ import annotations

from pyspark.sql import functions as F

from phyllary.llm.survivors import Bundle, choose_survivors


def test_joins_keep_what_depends_on_a_bundle_without_values(spark):
    # a: no locality; b: no country; c: neither; d: all; e: no latitude
    rows = [
        (1, "a", 2, "2024", "1", "", "X"), (2, "a", 1, "2024", "2", "", "Y"), (3, "a", 1, "2023", "1", "", ""), (4, "b", 2, "2024", "1", "p", ""), (5, "b", 1, "2024", "2", "", ""),
        (6, "c", 3, "2024", "", "", ""), (7, "c", 1, "2024", "5", "", ""), (8, "d", 1, "2024", "", "p", "X"), (9, "d", 2, "2024", "3", "q", "Y"), (10, "e", 1, "2024", "", "p", "X"), (11, "e", 2, "2024", "", "q", ""),
    ]
    df = spark.createDataFrame(rows, "seq long, g string, trust_rank int, accessed_at string, latitude string, locality string, country string")
    bundles = [Bundle(c, [c], F.col(c) != "") for c in ("locality", "country", "latitude")]
    columns = ["g", "locality_seq", "country_seq", "latitude_seq"]
    for deps in ([("locality", "country")], [("locality", "country"), ("country", "latitude")], [("locality", "country"), ("locality", "latitude")]):
        args = (["g"], bundles, "trust_rank", "accessed_at", "seq", deps)
        searched, joined = (sorted(map(tuple, choose_survivors(df, *args, combinations=n).select(columns).collect())) for n in (4096, 0))
        assert joined == searched
        assert joined[0] == ("a", None, 2, 2) and joined[1] == ("b", 4, None, 4 if ("locality", "latitude") in deps else 5) and joined[2] == ("c", None, None, 7)
