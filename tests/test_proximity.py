from __future__ import annotations

import numpy as np

from phyllary.functions.sphere import VantageTree, local_pairs, metres
from phyllary.operators.environment import nearest_of_list
from phyllary.operators.proximity import pairs_within


def _brute(a, b, radius):
    x, y = np.radians(np.array(a)), np.radians(np.array(b))
    d = metres(x[:, 0][:, None], x[:, 1][:, None], y[:, 0][None], y[:, 1][None])
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius), strict=True)}


def _places(n, seed):
    rng = np.random.default_rng(seed)
    sites = np.stack([rng.uniform(-89, 89, 12), rng.uniform(-180, 180, 12)], 1)
    sites[0], sites[1] = (89.9999, 10), (0.5, 179.9999)
    at = sites[rng.choice(12, n, p=[0.3] + [0.7 / 11] * 11)] + rng.normal(0, 0.004, (n, 2))
    return np.stack([np.clip(at[:, 0], -90, 90), (at[:, 1] + 180) % 360 - 180], 1)


def test_tree_is_exact():
    a, b = _places(400, 1), _places(700, 2)
    x, y = np.radians(a), np.radians(b)
    q, p = VantageTree(y[:, 0], y[:, 1]).within(x[:, 0], x[:, 1], 500.0)
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == _brute(a, b, 500.0)
    chunks = list(local_pairs(a[:, 0], a[:, 1], b[:, 0], b[:, 1], 500.0, chunk=100))
    assert {(int(i), int(j)) for c in chunks for i, j in zip(*c, strict=True)} == _brute(a, b, 500.0) and max(len(c[0]) for c in chunks) <= 100


def test_join_equals_brute_force_with_hot_cells(spark):
    a, b = _places(300, 3), _places(500, 4)
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, lat double, lon double")
    right = spark.createDataFrame([(i, str(float(x)), str(float(y)), "extra") for i, (x, y) in enumerate(b)], "cid long, lat string, lon string, id string")
    for pivots, rows in ((4, 20), (64, 1000)):
        got = pairs_within(left, right, "id", "cid", ("lat", "lon"), ("lat", "lon"), 500.0, pivots=pivots, block_rows=rows).collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == _brute(a, b, 500.0)


def test_no_places(spark):
    bad = spark.createDataFrame([(1, None, "1"), (2, "x", "1"), (3, "91", "1"), (4, "0", "0.0"), (5, "NaN", "1"), (6, "1" * 50_000, "1")], "id long, lat string, lon string")
    good = spark.createDataFrame([(1, "10", "10"), (2, " 10 ", "10"), (2, "10", "10")], "id long, lat string, lon string")
    assert pairs_within(bad, good, "id", "id", ("lat", "lon"), ("lat", "lon"), 500.0).count() == 0
    assert pairs_within(good.limit(0), good, "id", "id", ("lat", "lon"), ("lat", "lon"), 500.0).count() == 0
    same = pairs_within(good, good, "id", "id", ("lat", "lon"), ("lat", "lon"), 500.0)
    assert same.columns == ["id_left", "id_right"] and same.count() == 9


def test_nearest_of_a_list_in_one_block_and_in_many(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform([-89, -179], [89, 179], (700, 2)).round(1)
    places = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(at)] + [(9000, None, 1.0), (9001, float(at[5, 0]), float(at[5, 1]))], "place_id long, latitude double, longitude double")
    own = [(i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform([-89, -179], [89, 179], (300, 2)).round(1))] + [(1000, None, 5.0), (1001, float(at[5, 0]), float(at[5, 1]))]
    df = spark.createDataFrame(own, "id long, a double, o double")
    one, many = ({r.id: (r.nearest_id, r.nearest_m) for r in nearest_of_list(df, places, df.a, df.o, block_rows=n).collect()} for n in (500_000, 90))
    assert one == many and one[1000] == (None, None) and one[1001] == (5, 0.0)
    for i, a, o in own[:300]:
        d = metres(*np.radians([a, o]), np.radians(at[:, 0]), np.radians(at[:, 1]))
        assert one[i][0] == d.argmin() and abs(one[i][1] - d.min()) < 1e-6
    assert nearest_of_list(df, places.limit(0), df.a, df.o).where("nearest_id is null").count() == len(own)


def test_crowded_cells_are_cut_by_space(spark):
    """Cells cut by pivots of their own, and a quarter of all rows at one place, give all pairs once."""
    rng = np.random.default_rng(11)

    def side(n):
        at = np.vstack([rng.normal([10, 20], 0.15, (n - n // 4, 2)), np.full((n // 4, 2), [10.0, 20.0])])
        return at, spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(at)], "id long, lat double, lon double")

    (a, left), (b, right) = side(600), side(500)
    right = right.withColumnRenamed("id", "other")
    got = [tuple(r) for r in pairs_within(left, right, "id", "other", ("lat", "lon"), ("lat", "lon"), 900.0, pivots=2, block_rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(a, b, 900.0)
