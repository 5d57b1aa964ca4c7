from __future__ import annotations

import json

from phyllary.plans.sql import register, register_tables
from phyllary.sources.common import PAGE
from phyllary.sources.landing import LandedPages, read_pages, write_pages


def test_functions_and_views(spark, sf):
    names = register(spark)
    assert {"normal_date", "great_circle_m", "coordinates"} <= set(names) and "specimen_records" in register_tables(spark, sf)
    r = spark.sql("select normal_date('28/5/1994', 'dmy') a, altitude_low('1520 ft (463 m)', null) b, altitude_high(null, 'm') c, coordinates('N 23°27′ E 120°55′')[0].latitude d, plain_code('tns-1') e, size(split_names('A. Bee; C. Dee')) f, known_habitats('bog, x') g").first()
    assert (r.a, r.b, r.c, round(r.d, 2), r.e, r.f, r.g) == ("1994-05-28", 463, None, 23.45, "TNS1", 2, ["bog"])
    assert spark.sql("select normal_time('2021-02-19 17:56', 'dmy', 'Asia/Tokyo') a, normal_date('2020-01-01 10:00 Asia/Tokyo', null) b").first() == ("2021-02-19T08:56:00Z", "2020-01-01T01:00:00Z")
    assert spark.sql("select count(*) n from specimen_records where great_circle_m(0, 0, 0, 1) > 111000").first().n > 0


def test_landed_pages(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / "raw" / s).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "raw" / s / f"{i}.json").write_text(json.dumps({"query_name": "q", "page_no": i, "url": "u", "body": {"results": [i]}}))
    spark.dataSource.register(LandedPages)
    pages = spark.read.format("landed_pages").option("folder", str(tmp_path / "raw")).option("files_per_task", "2").load()
    assert pages.count() == 6 and {r.page_no for r in pages.where("source = 'b'").collect()} == {0, 1, 2} and json.loads(pages.first().body)["results"]
    reader = spark.read.format("landed_pages").option("folder", str(tmp_path / "raw"))
    assert {r.source for r in reader.option("source", "a").load().collect()} == {"a"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("landed_pages").option("folder", str(tmp_path / "raw")).option("pushdown", "true").load().where("source = 'b' and page_no > 0")
    assert sorted((r.source, r.page_no) for r in pushed.collect()) == [("b", 1), ("b", 2)]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    write_pages(pages, f"{tmp_path}/landed")
    back = read_pages(spark, f"{tmp_path}/landed", "a", "q")
    assert back.count() == 3 and [f.name for f in back.schema] == [c.split()[0] for c in PAGE.split(", ")]
    assert "PartitionFilters: [isnotnull(source" in back._jdf.queryExecution().toString()
