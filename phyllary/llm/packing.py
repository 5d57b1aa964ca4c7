"""Items combined into containers of fixed capacity (problem 8): Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.session import in_batches

#: Items in one block at least, windows that it is to fill, and items at most; blocks are cut by hash, so that no task's work grows
#: with the data.
BLOCK_ITEMS, BLOCK_WINDOWS, MOST_ITEMS = 4096, 64, 65_536


def windows_by_differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, from 0 to k - 1, of each item: nearly equal sums by multiway differencing.

    Every item starts as a partition with one filled window. The two partitions with the largest spread are merged, the fullest window
    of one with the emptiest of the other, until one is left. A partition is kept as its filled windows, fullest first: sums, and
    nodes that stand for what a window holds. Which node was made of which two is written down, and read backwards at the end.
    """
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    at = np.argsort(-sizes, kind="stable")
    heap: list = [(-int(sizes[i]), int(i), sizes[i : i + 1], np.array([i])) for i in at]
    made: list[tuple[int, np.ndarray, np.ndarray]] = []
    nodes = turn = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        if len(sa) + len(sb) <= k:
            sums, ids = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:
            # opposing imbalances: the last windows of one get the first of the other, so that both ends meet at k windows
            both = len(sa) + len(sb) - k
            left, right = na[len(na) - both :], nb[len(nb) - both :][::-1]
            new = np.arange(nodes, nodes + both)
            made.append((nodes, left, right))
            nodes += both
            sums = np.concatenate([sa[: len(sa) - both], sa[len(sa) - both :] + sb[len(sb) - both :][::-1], sb[: len(sb) - both]])
            ids = np.concatenate([na[: len(na) - both], new, nb[: len(nb) - both]])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), turn, sums, ids))
        turn += 1
    window = np.empty(nodes, np.int64)
    ids = heap[0][3]
    window[ids] = np.arange(len(ids))
    for base, left, right in reversed(made):
        own = window[base : base + len(left)]
        window[left] = own
        window[right] = own
    return window[:n]


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """The items (their places) of each of the k windows."""
    out: list[list[int]] = [[] for _ in range(k)]
    for i, w in enumerate(windows_by_differencing(np.asarray(sizes, np.int64), k).tolist()):
        out[w].append(i)
    return out


def pack(sizes: Sequence[int], capacity: int) -> list[int]:
    """The window of each item: as few windows of at most capacity as differencing finds. Sizes must not exceed the capacity.

    The window count starts at the least possible and rises as long as a window is too full; the rise follows the overflow and is at
    least twice the one before, then the counts between the last failure and the first success are tried by halving.
    """
    held = np.asarray(sizes, np.int64)
    if not len(held):
        return []

    def attempt(k: int) -> tuple[np.ndarray, int]:
        windows = windows_by_differencing(held, k)
        return windows, int(np.maximum(np.bincount(windows, weights=held, minlength=k).astype(np.int64) - capacity, 0).sum())

    k = max(1, -(-int(held.sum()) // capacity))
    failed, (windows, over), rise = k - 1, attempt(k), 0
    while over:
        failed = k
        rise = max(1, 2 * rise, -(-over // capacity))
        k += rise
        windows, over = attempt(k)
    while k - failed > 1:
        mid = (k + failed) // 2
        tried, over = attempt(mid)
        if over:
            failed = mid
        else:
            k, windows = mid, tried
    return windows.tolist()


def pack_items(items: DataFrame, key: str, size: str, runs: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Containers for every run: run_name, container (text, unique in the run), key, piece (from 0), piece_start, piece_size.

    items: key and size (in tokens); sizes null, zero or negative hold nothing and are left out. runs: run_name, capacity_tokens
    (a handful of rows). An item larger than the capacity is cut into pieces of the capacity; whole pieces fill a container each, the
    rest is packed like an item. No other item is cut. Containers are filled within blocks, chosen by hash, of block_items items or
    as many as fill BLOCK_WINDOWS windows: a block wastes at most the room of one window beside what differencing leaves. Ties and repeated rows are fine: each
    row is an item. Empty items or runs give an empty result.
    """
    spark = items.sparkSession
    plan = [(r["run_name"], int(r["capacity_tokens"])) for r in runs.select("run_name", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    kind = items.select(key).schema[0].dataType.simpleString()
    schema = f"run_name string, container string, `{key}` {kind}, piece long, piece_start long, piece_size long"
    if not plan:
        return spark.createDataFrame([], schema)
    sized = items.select(F.col(key).alias("__key"), F.col(size).cast("long").alias("__size")).where("__size > 0")
    count, total = sized.agg(F.count("*"), F.sum("__size")).first()
    if not count:
        return spark.createDataFrame([], schema)
    # small items need larger blocks to fill as many windows
    per = [max(block_items, min(MOST_ITEMS, -(-BLOCK_WINDOWS * capacity * count // total))) for _, capacity in plan]
    blocks_of = [max(1, -(-count // n)) for n in per]
    own = F.get(F.array(*[F.lit(n) for n in blocks_of]), F.col("__run"))
    spread = sized.withColumn("__run", F.explode(F.array(*[F.lit(i) for i in range(len(plan))])))
    blocks = spread.withColumn("__block", F.pmod(F.xxhash64("__key", "__size", F.lit(8)), own).cast("int"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = blocks.repartition(min(sum(blocks_of), 16 * tasks), "__run", "__block").sortWithinPartitions("__run", "__block", "__key", "__size")

    def block(r: int, b: int, keys: np.ndarray, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
        run, capacity = plan[r]
        whole = sizes // capacity * (sizes > capacity)
        rest = sizes - whole * capacity
        rows: list = []
        for i in np.nonzero(whole)[0]:
            rows += [(f"{b}-{i}-{p}", keys[i], p, p * capacity, capacity) for p in range(int(whole[i]))]
        at = np.nonzero(rest)[0]
        for i, w in zip(at, pack(rest[at].tolist(), capacity), strict=True):
            rows.append((f"{b}-w{w}", keys[i], int(whole[i]), int(whole[i]) * capacity, int(rest[i])))
        out = pd.DataFrame(rows, columns=["container", key, "piece", "piece_start", "piece_size"])
        out.insert(0, "run_name", run)
        yield out

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                one = pd.concat(held)
                yield from block(*now, one["__key"].values, one["__size"].values)

        for batch in batches:
            for at, part in batch.groupby(["__run", "__block"], sort=False):
                if at != now:
                    yield from flush()
                    held, now = [], at
                held.append(part)
        yield from flush()

    return in_batches(ordered, fill, schema)


def packing_report(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run: containers, items (pieces), tokens, the room they had and the share filled."""
    per = packed.groupBy("run_name").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("piece_size").alias("tokens"))
    return per.join(F.broadcast(runs.select("run_name", "capacity_tokens")), "run_name").withColumn("filled_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
