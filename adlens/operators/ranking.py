"""Positions in a total order, computed by all tasks together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import land


def ordered_positions(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
                      name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in ``order_by`` order, per group or overall.

    Rows are range partitioned by group and order, so one large group spreads over many tasks and
    no window ever holds a whole group.  The ranged rows are landed once: the offsets and
    the rows they are added to must come from the same partitioning.  The offsets are landed too, so
    that their size decides how they are joined: if they are few, the rows are not shuffled again.
    """
    group_by = list(group_by)
    keys = [*group_by, *order_by]
    ranged = land(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_mark", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()), "ranged")
    # One row per (partition, group): at most partitions + groups rows.
    parts = ranged.groupBy("_part", *group_by).agg(
        F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    before = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = land(parts.select("_part", *group_by, "_first",
                                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    match = [F.col("r._part") == F.col("o._part")]
    match += [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group_by]
    joined = ranged.alias("r").join(offsets.alias("o"), match)
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("o._before") + F.col("r._mark") - F.col("o._first")).alias(name))
