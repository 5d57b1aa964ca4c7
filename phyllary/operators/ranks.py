"""Numbers of rows in their groups, also where one group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phyllary.session import durable

#: Rows of a group beyond which it is numbered by several tasks.
HOT_ROWS = 1_000_000


def _by_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Numbers by sorted ranges: rows are dealt out by ranges of (group, order), numbered in their range, and moved by the rows of the
    group in the ranges before. The ranges are written once, as their bounds are drawn by sampling."""
    g = list(group)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *g, *order).withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part", *g).orderBy(*order))
    counts = ranged.groupBy("__part", *g).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*g).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select("__part", *g, before.alias("__before"))
    numbered = ranged.withColumn("__own", own)
    joined = numbered.join(moved, [numbered[c].eqNullSafe(moved[c]) for c in ["__part", *g]])
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__own") + F.col("__before")).cast("long").alias(name))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with name, the row's number in its group by the order, from 1; rows that the order does not tell apart are numbered as they come.

    A null group is a group like others; a column of that name is replaced; an empty df gives an empty result. Groups of more than
    hot_rows rows are numbered by sorted ranges over many tasks, the others by one window.
    """
    df, g = df.drop(name), list(group)
    hot = df.groupBy(*g).count().where(F.col("count") > hot_rows).select(*g)
    hot = durable(hot)
    window = Window.partitionBy(*g).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    # at most a row for every hot_rows rows
    same = [df[c].eqNullSafe(hot[c]) for c in g]
    cool = df.join(F.broadcast(hot), same, "left_anti").withColumn(name, F.row_number().over(window).cast("long"))
    return cool.unionByName(_by_ranges(df.join(F.broadcast(hot), same, "left_semi"), g, order, name))
