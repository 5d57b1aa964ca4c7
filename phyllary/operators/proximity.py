"""All pairs of places within a distance (problem 3): Voronoi cells around pivots, replication by the triangle inequality, local
vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phyllary.functions.sphere import RADIUS_M, degrees, local_pairs, unit_vectors, usable_place
from phyllary.session import arrow_function, durable, in_batches

#: Pivots, chosen by hash among the distinct places of the first side rounded to a tenth of a degree: a bound on driver and broadcast data.
PIVOTS = 512
#: Rows of a side in one block; cells with more are cut by pivots of their own, and what is still larger into a grid of blocks.
BLOCK_ROWS = 20_000
#: Pivots of one crowded cell at most. With PIVOTS they bound what the driver holds: 131,072 places.
CELL_PIVOTS = 256


def _vectors(rows) -> np.ndarray:
    at = np.radians(np.array([[r["a"], r["o"]] for r in rows], float).reshape(-1, 2))
    return unit_vectors(at[:, 0], at[:, 1])


def _pivots(places: DataFrame, n: int) -> np.ndarray:
    """Up to n places by smallest hash, as unit vectors."""
    near = places.select(F.round("__lat", 1).alias("a"), F.round("__lon", 1).alias("o")).distinct()
    return _vectors(near.orderBy(F.xxhash64("a", "o"), "a", "o").limit(n).collect())


def _cell_pivots(cells: DataFrame, wanted: dict[int, int]) -> dict[int, np.ndarray]:
    """For each crowded cell up to so many of its first side's places by smallest hash, as unit vectors. The ranks are cut in every task
    before they are shuffled."""
    spark = cells.sparkSession
    limits = F.broadcast(spark.createDataFrame(list(wanted.items()), "__cell int, __k int"))
    near = cells.where("__side = 0").join(limits, "__cell").select("__cell", "__k", F.round("__lat", 4).alias("a"), F.round("__lon", 4).alias("o")).distinct()
    n = F.row_number().over(Window.partitionBy("__cell").orderBy(F.xxhash64("a", "o"), "a", "o"))
    rows = near.withColumn("n", n).where(F.col("n") <= CELL_PIVOTS).where("n <= __k").select("__cell", "a", "o").collect()
    held: dict[int, list] = {}
    for r in sorted(rows):
        held.setdefault(r["__cell"], []).append(r)
    return {c: _vectors(rs) for c, rs in held.items()}


def _nearest(pivots: np.ndarray, radius: float, lat: np.ndarray, lon: np.ndarray, every: np.ndarray) -> list:
    """The Voronoi cell of each place; where every is set, all cells that may hold a place within radius of it.

    If x lies in the cell of pivot p and is within r of q, then d(q, p) <= d(x, p) + r <= d(x, n) + r <= d(q, n) + 2r for q's nearest
    pivot n: q goes to every cell whose pivot is at most 2r farther than its nearest one.
    """
    out: list = []
    for s in range(0, len(lat), 8192):
        dots = unit_vectors(np.radians(lat[s : s + 8192]), np.radians(lon[s : s + 8192])) @ pivots.T
        best = dots.argmax(axis=1)
        rows = np.arange(len(best))
        # two metres more cover the rounding of cosines near 1
        reach = np.arccos(np.clip(dots[rows, best], -1, 1)) + (2 * radius + 2) / RADIUS_M
        hit = (dots >= np.cos(np.minimum(reach, np.pi))[:, None] - 1e-15) & every[s : s + 8192, None]
        hit[rows, best] = True
        r, c = np.nonzero(hit)
        out.extend(np.split(c, np.searchsorted(r, np.arange(1, len(best)))))
    return out


def _cells(pivots: np.ndarray, radius: float, every: bool):
    """The cells of places, as _nearest gives them."""

    def assign(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(_nearest(pivots, radius, lat.values, lon.values, np.full(len(lat), every)), dtype=object)

    return arrow_function(assign, "array<int>")


def _inner_cells(pivots: dict[int, np.ndarray], radius: float):
    """The cells inside crowded cells of places of either side; 0 in other cells."""

    def assign(cell: pd.Series, side: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
        out = np.empty(len(cell), dtype=object)
        for c in cell.unique():
            at = np.nonzero((cell == c).values)[0]
            found = _nearest(pivots[c], radius, lat.values[at], lon.values[at], side.values[at] == 1) if c in pivots else [[0]] * len(at)
            for i, f in zip(at, found, strict=True):
                out[i] = f
        return pd.Series(out, dtype=object)

    return arrow_function(assign, "array<int>")


def _counts(cells: DataFrame, *keys: str) -> dict[tuple, list[int]]:
    """Rows of either side in each cell: at most a row for each pivot and side."""
    out: dict[tuple, list[int]] = {}
    for r in cells.groupBy(*keys, "__side").count().collect():
        out.setdefault(tuple(r[k] for k in keys), [0, 0])[r["__side"]] = r["count"]
    return out


def pairs_within(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_place: tuple[str, str], right_place: tuple[str, str], radius_m: float, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every pair (left_id, right_id) of rows whose places are at most radius_m apart by great circle; the ids are long integers. Ids of
    one name get _left and _right behind it.

    Places are columns (latitude, longitude), numbers or text; rows whose place is null, no number, out of range or 0, 0 have no pairs.
    Repeated rows give a pair each, also at one place. Other columns are not carried. Empty sides give an empty result. Cells with more
    than block_rows rows of a side are cut by pivots of their own, as many as their rows ask for, so that blocks grow in proportion to
    the rows; only what is still larger, such as many rows at one place, is cut into a grid of blocks by hash. Pairs leave a task in chunks.
    """
    sides = []
    for df, key, (lat, lon) in ((left, left_id, left_place), (right, right_id, right_place)):
        at = df.select(F.col(key).cast("long").alias("__id"), degrees(F.col(lat)).alias("__lat"), degrees(F.col(lon)).alias("__lon"))
        sides.append(at.where(usable_place(F.col("__lat"), F.col("__lon")) & F.col("__id").isNotNull()))
    spark = left.sparkSession
    left_out, right_out = (left_id, right_id) if left_id != right_id else (f"{left_id}_left", f"{right_id}_right")
    schema = f"`{left_out}` long, `{right_out}` long"
    chosen = _pivots(sides[0], pivots)
    if not len(chosen):
        return spark.createDataFrame([], schema)
    cells = [s.withColumn("__cell", F.explode(_cells(chosen, radius_m, bool(i))("__lat", "__lon"))).withColumn("__side", F.lit(i)) for i, s in enumerate(sides)]
    # the cells of a place are looked for once
    both = durable(cells[0].unionByName(cells[1]))
    live = {k: n for k, n in _counts(both, "__cell").items() if all(n)}
    crowded = {c: min(CELL_PIVOTS, 2 * -(-max(n) // block_rows)) for (c,), n in live.items() if max(n) > block_rows}
    if crowded:
        inner = _inner_cells(_cell_pivots(both, crowded), radius_m)
        few = both.where(~F.col("__cell").isin(list(crowded))).withColumn("__inner", F.lit(0))
        many = durable(both.where(F.col("__cell").isin(list(crowded))).withColumn("__inner", F.explode(inner("__cell", "__side", "__lat", "__lon"))))
        both = few.unionByName(many)
        live = {(*k, 0): n for k, n in live.items() if k[0] not in crowded} | {k: n for k, n in _counts(many, "__cell", "__inner").items() if all(n)}
    else:
        both, live = both.withColumn("__inner", F.lit(0)), {(*k, 0): n for k, n in live.items()}
    if not live:
        return spark.createDataFrame([], schema)
    grid = [(*k, *(-(-x // block_rows) for x in n)) for k, n in sorted(live.items())]
    # at most PIVOTS times CELL_PIVOTS rows
    cuts = F.broadcast(spark.createDataFrame(grid, "__cell int, __inner int, __n0 int, __n1 int"))
    own = F.pmod(F.xxhash64("__id"), F.when(F.col("__side") == 0, F.col("__n0")).otherwise(F.col("__n1"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("__side") == 0, F.col("__n1")).otherwise(F.col("__n0")) - 1)
    blocks = both.join(cuts, ["__cell", "__inner"]).select(
        (F.col("__cell") * CELL_PIVOTS + F.col("__inner")).alias("__cell"), "__side", "__id", "__lat", "__lon", own.alias("__own"), F.explode(other).alias("__other")
    ).select(F.when(F.col("__side") == 0, F.struct("__cell", F.col("__own").alias("i"), F.col("__other").alias("j"))).otherwise(F.struct("__cell", F.col("__other").alias("i"), F.col("__own").alias("j"))).alias("__block"), "__side", "__id", "__lat", "__lon")
    blocks = blocks.select("__block.*", "__side", "__id", "__lat", "__lon")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        block = None

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                b = pd.concat(held, ignore_index=True)
                side = b["__side"].values
                q, p = b[side == 0], b[side == 1]
                if len(q) and len(p):
                    qid, pid = q["__id"].values, p["__id"].values
                    for i, j in local_pairs(q["__lat"].values, q["__lon"].values, p["__lat"].values, p["__lon"].values, radius_m):
                        yield pd.DataFrame({left_out: qid[i], right_out: pid[j]})

        for batch in batches:
            keys = batch[["__cell", "i", "j"]].values
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(batch)]
            for s, e in zip(starts, starts[1:], strict=False):
                if s == e:
                    continue
                if block != (k := tuple(keys[s])):
                    yield from flush()
                    held, block = [], k
                held.append(batch.iloc[s:e])
        yield from flush()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return in_batches(blocks.repartition(tasks, "__cell", "i", "j").sortWithinPartitions("__cell", "i", "j"), join, schema)
