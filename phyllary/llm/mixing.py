"""Sources mixed to target weights (problem 9): proportionate-fair scheduling of blocks, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phyllary.session import durable

#: Blocks in the schedule at most. Bounds what the driver makes and what is broadcast; a mixture of more blocks repeats the schedule.
SLOTS = 32_768
#: Size of a block at most (in tokens); mixtures of fewer than SLOTS of them have smaller blocks.
BLOCK = 65_536
#: Items of a part, and parts of a source at least: each source is cut by hash to sum its sizes without any task holding a source. Parts
#: of all sources at most, which the driver sums up.
PART_ITEMS, PARTS, MOST_PARTS = 1_000_000, 1024, 4_000_000
#: As total: the size of all items of the sources that can give some.
LISTED = "listed"


def fair_schedule(shares: dict[str, float], slots: int) -> list[tuple[str, int]]:
    """(source, its block) for each slot. Block j of a source with share w is released at floor(j / w) and due at ceil((j + 1) / w);
    of the released blocks the one due first gets the slot, ties by name. With shares that sum to 1 every source is always less than
    one block away from its share, as deadlines can be met for any such set on one resource."""
    order = sorted(s for s, w in shares.items() if w > 0)
    exact = {s: w / math.fsum(shares[x] for x in order) for s, w in ((x, shares[x]) for x in order)}
    nxt = dict.fromkeys(order, 0)
    waiting: list = [(0, s) for s in order]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((nxt[s] + 1) / exact[s] - 1e-9), s))
        if not ready:
            # rounding of shares left no block released: take the one released first
            r, s = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((nxt[s] + 1) / exact[s] - 1e-9), s))
        _, s = heapq.heappop(ready)
        out.append((s, nxt[s]))
        nxt[s] += 1
        heapq.heappush(waiting, (math.floor(nxt[s] / exact[s] + 1e-9), s))
    return out


def mix_sources(items: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: int | str | None = None, slots: int = SLOTS, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """The mixture: key, source, repeat (from 0), size, slot and slot_start (the item's first token counted inside its source's
    stream); in order of (slot, slot_start) it is the interleaved stream.

    targets: source, target_share, max_repeats (a row for each source; at most a few thousand, so read on the driver). Only sources
    with items count; their shares are scaled to sum to 1. total: the size of the mixture; by default the largest at which every
    such source fills its share with at most max_repeats uses of each item; LISTED is the size of all their items. With a larger total,
    short sources give what they have, max_repeats uses of each item, and the stream is interleaved by the shares that are reached.
    A block is at most `block` large: a mixture of more than slots blocks goes through the schedule several times, each time with the same
    part of every source's quota. parts: into how many each source is cut, by default as many as its items ask for.
    Every pass over a source takes its items in the same hash order; the last pass takes the items whose middle lies within the quota,
    so a source misses its quota by at most half an item. Items with null key, null or unlisted source, or size null, 0 or less are left
    out. Ties and repeated rows are items each. No items, or no shares above 0, give an empty result.
    """
    spark = items.sparkSession
    kind = items.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, repeat long, size long, slot long, slot_start long"
    wanted = {r["source"]: (float(r["target_share"]), max(int(r["max_repeats"] or 0), 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and (r["target_share"] or 0) > 0}
    rows = items.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col(size).cast("long").alias("__size")).where("__size > 0 and __key is not null").where(F.col("__source").isin(list(wanted) or [""]))
    rows = durable(rows.withColumn("__hash", F.xxhash64("__key", "__size", F.lit(9))))
    if parts is None:
        parts = min(max(PARTS, -(-rows.count() // PART_ITEMS)), max(1, MOST_PARTS // max(1, len(wanted))))
    rows = rows.withColumn("__part", F.pmod("__hash", F.lit(parts)).cast("int"))
    # at most parts rows for each listed source
    sums = rows.groupBy("__source", "__part").agg(F.sum("__size").alias("s"))
    got = sums.collect()
    held: dict[str, int] = {}
    for r in got:
        held[r["__source"]] = held.get(r["__source"], 0) + r["s"]
    live = {s: w for s, w in wanted.items() if held.get(s) and w[1] > 0}
    if not live:
        return spark.createDataFrame([], schema)
    scale = math.fsum(w for w, _ in live.values())
    share = {s: w / scale for s, (w, _) in live.items()}
    most = min(held[s] * live[s][1] / share[s] for s in live)
    asked = int(most if total is None else sum(held[s] for s in live) if total == LISTED else total)
    if asked <= 0:
        return spark.createDataFrame([], schema)
    quota = {s: min(share[s] * asked, float(held[s] * live[s][1])) for s in live}
    # what the sources give: less than asked where some are short
    whole = min(asked, math.ceil(math.fsum(quota.values()) - 1e-6))
    rounds = max(1, -(-whole // (slots * block)))
    places = min(slots, max(1, -(-whole // rounds)))
    # where each part begins in its source's pass
    begins, at = [], {}
    for r in sorted(got, key=lambda r: (r["__source"], r["__part"])):
        if r["__source"] in live:
            begins.append((r["__source"], r["__part"], at.get(r["__source"], 0)))
            at[r["__source"]] = at.get(r["__source"], 0) + r["s"]
    starts = F.broadcast(spark.createDataFrame(begins, "__source string, __part int, __begin long"))
    schedule = fair_schedule(quota, places)
    own = Counter(s for s, _ in schedule)
    # a source without a block of its own shares the last place
    units = {s: quota[s] / (max(own[s], 1) * rounds) for s in live}
    limits = F.broadcast(spark.createDataFrame([(s, float(quota[s]), held[s], math.ceil(quota[s] / held[s] - 1e-12), units[s], max(own[s], 1)) for s in live], "__source string, __quota double, __held long, __passes int, __unit double, __blocks int"))
    slot_of = F.broadcast(spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(schedule)], "__source string, __block long, __slot long"))
    within = Window.partitionBy("__source", "__part").orderBy("__hash", "__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(starts, ["__source", "__part"]).join(limits, "__source")
    placed = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("__passes") - 1)))
    placed = placed.withColumn("slot_start", F.col("repeat") * F.col("__held") + F.col("__begin") + F.col("__before")).where(F.col("slot_start") + F.col("__size") / 2 <= F.col("__quota"))
    # an item belongs to the block in which its middle lies, of the round in which that lies
    middle = F.floor((F.col("slot_start") + F.col("__size") / 2) / F.col("__unit")).cast("long")
    placed = placed.withColumn("__round", F.least(F.floor(middle / F.col("__blocks")), F.lit(rounds - 1)).cast("long"))
    out = placed.withColumn("__block", F.least(middle - F.col("__round") * F.col("__blocks"), F.col("__blocks") - 1).cast("long")).join(slot_of, ["__source", "__block"], "left")
    slot = F.col("__round") * F.lit(len(schedule)) + F.coalesce("__slot", F.lit(len(schedule) - 1))
    return out.select(F.col("__key").alias(key), F.col("__source").alias("source"), F.col("repeat").cast("long").alias("repeat"), F.col("__size").alias("size"), slot.cast("long").alias("slot"), F.col("slot_start").cast("long").alias("slot_start"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: target_share, items used, distinct items, most uses of one, size, and the share reached of the whole."""
    uses = mixed.groupBy("source").agg(F.count("*").alias("items"), F.max(F.col("repeat") + 1).alias("most_uses"), F.sum("size").alias("size"))
    whole = F.broadcast(uses.agg(F.sum("size").alias("whole")))
    listed = targets.select("source", "target_share", "max_repeats")
    out = listed.join(F.broadcast(uses), "source", "left").crossJoin(whole)
    zero = F.lit(0)
    return out.select("source", "target_share", "max_repeats", F.coalesce("items", zero).alias("items"), F.coalesce("most_uses", zero).alias("most_uses"), F.coalesce("size", zero).alias("size"), F.round(F.coalesce(F.col("size") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"))
