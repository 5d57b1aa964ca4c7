from __future__ import annotations

from collections import Counter

from phyllary.llm.mixing import LISTED, mix_sources
from phyllary.llm.queries import p9_mixture, p9_report


def test_short_source_does_not_shrink_the_mixture(spark, tmp_path):
    # two tokens a text: 204 listed, of which big can give 200 and small 12
    rows = [(i, "big", "hello world") for i in range(100)] + [(1000 + i, "small", "hello world") for i in range(2)] + [(2000, "unlisted", "hello world")]
    targets = [("big", 0.9, 1), ("small", 0.1, 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    report = {r.source: r for r in p9_report(spark, str(tmp_path)).collect()}
    assert (report["big"].items, report["big"].most_uses, report["small"].items, report["small"].most_uses) == (92, 1, 6, 3)
    assert report["small"].reached_share == round(12 / 196, 6) and report["big"].reached_share == round(184 / 196, 6)
    stream = [r.source for r in sorted(p9_mixture(spark, str(tmp_path)).collect(), key=lambda r: (r.slot, r.slot_start))]
    for t in range(1, len(stream) + 1):
        assert abs(stream[:t].count("small") - 6 / 98 * t) < 2


def test_totals(spark):
    items = spark.createDataFrame([(i, "big", 10) for i in range(50)] + [(100, "small", 4), (101, "never", 5)], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("never", 0.1, 0)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(items, "doc_id", "source", "n", targets, total=LISTED).collect()
    assert Counter(r.source for r in mixed) == {"big": 28, "small": 2}
    assert Counter(r.source for r in mix_sources(items, "doc_id", "source", "n", targets, total=5000).collect()) == {"big": 100, "small": 2}
    assert mix_sources(items, "doc_id", "source", "n", targets, total=0).count() == 0


def test_schedules_repeat_and_stay_fair(spark):
    """With small blocks the schedule is gone through many times; at every place each source is near its share."""
    rows = [(i, "a", 3 + i % 5) for i in range(3000)] + [(10_000 + i, "b", 2 + i % 3) for i in range(3000)] + [(20_000 + i, "c", 4) for i in range(900)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(items, "doc_id", "source", "n", targets, total=12_000, slots=20, block=50, parts=7)
    got = sorted(mixed.collect(), key=lambda r: (r.slot, r.slot_start))
    assert max(r.slot for r in got) >= 200 and len({(r.doc_id, r.repeat) for r in got}) == len(got)
    total, own = 0, {"a": 0, "b": 0, "c": 0}
    for r in got:
        total += r["size"]
        own[r.source] += r["size"]
        assert all(abs(own[s] - w * total) < 2 * 50 + 8 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    again = mix_sources(items, "doc_id", "source", "n", targets, total=12_000, slots=20, block=50, parts=1)
    assert abs(sum(r["size"] for r in again.collect()) - total) < 40
