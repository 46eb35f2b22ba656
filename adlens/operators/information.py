"""Mutual information of features with a continuous target by nearest neighbours.

For a continuous feature the distance to the k-th nearest neighbour is taken in the plane of feature and target (the
larger of both differences), for a discrete one among the rows of its value, along the target.  How many rows lie
closer than that on each axis gives the estimate.  No noise is added to break ties.

The plane is cut into strips of equal row counts along the feature, and every strip into blocks along the target.  A
block compares its own rows; a row whose search square reaches into other blocks visits just those.  What lies within a radius on an
axis is counted by rank: range-partitioned values with running counts.  A block holds ``block_rows`` rows at most, so does what
visits it from one other block, and nothing larger is held by a task.  Each step is landed and what it was made from deleted; tables of
a row per block, label or partition are landed too, so that the planner knows their size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.operators.ranking import ordered_positions
from adlens.session import land, land_alone

NEIGHBOURS = 3
BLOCK_ROWS = 1024
# Standard deviations are rounded to so many digits, so that the last bits of a sum do not decide ties.
SCALE_DIGITS = 9

_SMALL = 16


def digamma(n: Column) -> Column:
    """The digamma function of positive whole numbers: a table below 16, an asymptotic series from there."""
    table = [-0.57721566490153286061]
    for i in range(1, _SMALL - 1):
        table.append(table[-1] + 1 / i)
    x = n.cast("double")
    square = 1 / (x * x)
    series = F.log(x) - 0.5 / x - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return F.when(n < _SMALL, F.get(F.array(*[F.lit(t) for t in table]), n.cast("int") - 1)).otherwise(series)


def _nearest(k: int):
    """The ``k`` smallest distances of each row of a block to the other rows of the block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for feature, strip, part, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                cells = rows.values
                at, x, y = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                gap = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
                np.fill_diagonal(gap, np.inf)
                if len(x) > k:
                    gap = np.partition(gap, k - 1, axis=1)[:, :k]
                size = len(x)
                flat = pa.array(np.sort(gap, axis=1).ravel())
                offsets = pa.array(np.arange(size + 1, dtype=np.int32) * gap.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([feature] * size, pa.string()), pa.array([strip] * size, pa.int64()), pa.array([part] * size, pa.int64()), pa.array(at, pa.int64()),
                     pa.array(x), pa.array(y), pa.ListArray.from_arrays(offsets, flat)], names=["feature", "strip", "part", "at", "x", "y", "gaps"])
    return run


def _visited(k: int):
    """The ``k`` smallest distances of visiting rows to the rows of a block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for feature, strip, part, guests, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                mine, held = guests.values, rows.values
                at, x, y = (mine.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                u, v = (held.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                gap = np.maximum(np.abs(x[:, None] - u), np.abs(y[:, None] - v))
                if gap.shape[1] > k:
                    gap = np.partition(gap, k - 1, axis=1)[:, :k]
                size = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([feature] * size, pa.string()), pa.array([strip] * size, pa.int64()), pa.array([part] * size, pa.int64()), pa.array(at, pa.int64()),
                     pa.array(x), pa.array(y), pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * gap.shape[1]), pa.array(gap.ravel()))],
                    names=["feature", "strip", "part", "at", "x", "y", "gaps"])
    return run


_GAPS = "feature string, strip bigint, part bigint, at bigint, x double, y double, gaps array<double>"


def _along(k: int):
    """In sorted blocks of one value's targets with the rows around them: the distance to the nearest of each own row."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for feature, label, count, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                cells = rows.values
                place, y, own = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.argsort(place)
                place, y, own = place[order], y[order], own[order]
                near = min(k, count - 1)
                wide = np.concatenate([np.full(near, -np.inf), y, np.full(near, np.inf)])
                # The nearest are j rows before and near - j rows behind, for some j.
                least = np.full(len(y), np.inf)
                for j in range(near + 1):
                    before, behind = wide[near - j:near - j + len(y)], wide[2 * near - j:2 * near - j + len(y)]
                    np.minimum(least, np.maximum(y - before, behind - y), out=least)
                size = int(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([feature] * size, pa.string()), pa.array([label] * size, pa.string()), pa.array(place[own], pa.int64()),
                     pa.array(y[own]), pa.array(least[own]), pa.array([near] * size, pa.int64()), pa.array([count] * size, pa.int64())],
                    names=["feature", "label", "place", "y", "radius", "near", "count"])
    return run


def _bounds(n_ids: int):
    """Rows (axis, id, value, radius) to the least and the largest number closer to the value than the radius.

    A number is closer if the difference, as it is computed, is smaller; with radius 0 only the value itself is.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def place(x):
            # Doubles in order as whole numbers.
            bits = np.ascontiguousarray(x + 0.0).view(np.int64)
            return np.where(bits < 0, np.int64(-2**63) - bits, bits)

        def number(at):
            return np.where(at < 0, np.int64(-2**63) - at, at).view(np.float64)

        def edge(value, radius, way):
            # Halving between the value itself and twice the radius.
            near, far = place(value), place(value + 2 * way * radius)
            while True:
                middle = (near >> 1) + (far >> 1) + (near & far & 1)
                if ((middle == near) | (middle == far)).all():
                    break
                inside = np.abs(number(middle) - value) < radius
                near, far = np.where(inside, middle, near), np.where(inside, far, middle)
            near = np.where((way > 0) & (radius > 0) & (np.abs(number(far) - value) < radius), far, near)
            return np.where(radius > 0, number(near), value) + 0.0

        for batch in batches:
            value, radius = batch.column(n_ids).to_numpy(), batch.column(n_ids + 1).to_numpy()
            low, high = edge(value, radius, -1), edge(value, radius, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_ids], pa.array(low), pa.array(high)], names=[*batch.schema.names[:n_ids], "low", "high"])
    return run


def _running():
    """In sorted rows, how much weight of the axis lies before each query, within the partition; kind 3 is all of it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["axis", "kind", "id", "part", "before"]

        def whole(axis, part, held):
            return pa.RecordBatch.from_arrays([pa.array([axis], pa.string()), pa.array([3], pa.int32()), pa.array([""], pa.string()),
                                               pa.array([part], pa.int32()), pa.array([held], pa.int64())], names=names)

        axis, part, held = None, None, 0
        for batch in batches:
            axes, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            weights = batch.column(2).to_numpy()
            total = np.cumsum(weights)
            starts = np.flatnonzero(np.append(True, axes[1:] != axes[:-1])) if len(axes) else np.empty(0, int)
            before = np.zeros(len(axes), np.int64)
            for s, e in zip(starts, np.append(starts[1:], len(axes))):
                if part is not None and axes[s] != axis:
                    yield whole(axis, part, held)
                carried = held if part is not None and axes[s] == axis else 0
                base = total[s] - weights[s]
                before[s:e] = total[s:e] - base + carried
                axis, part, held = axes[s], batch.column(4)[0].as_py(), int(before[e - 1])
            asks = np.flatnonzero(kinds != 1)
            taken = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).take(pa.array(asks))
            yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in (0, 1, 3, 4)), pa.array(before[asks])], names=names)
        if part is not None:
            yield whole(axis, part, held)
    return run


def counts_within(values: DataFrame, asked: DataFrame) -> DataFrame:
    """axis, id, n: how many ``values`` (axis, value) lie between ``low`` and ``high`` of each row of ``asked`` (axis, id,
    low, high; id is text), both ends included.

    Values and ends are range partitioned together; equal values are one row with a weight.
    """
    held = values.groupBy("axis", "value").agg(F.count("*").alias("weight")) \
        .select("axis", "value", F.lit(1).alias("kind"), "weight", F.lit("").alias("id"))
    # A lower end comes before the values equal to it, an upper end behind them.
    ends = F.explode(F.array(F.struct(F.col("low").alias("value"), F.lit(0).alias("kind")), F.struct(F.col("high").alias("value"), F.lit(2).alias("kind"))))
    asks = asked.select("axis", "id", ends.alias("e")).select("axis", "e.value", "e.kind", F.lit(0).cast("bigint").alias("weight"), "id")
    order = ["axis", "value", "kind", "id"]
    # Counted behind the sort, as only there a partition is what it was.
    ranged = held.unionByName(asks).repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("part", F.spark_partition_id()).select("axis", "kind", "weight", "id", "part")
    ranks = land(ranged.mapInArrow(_running(), "axis string, kind int, id string, part int, before bigint"), "ranks")
    # One row per partition and axis.
    earlier = Window.partitionBy("axis").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = land(ranks.where("kind = 3").select("axis", "part", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("offset")), "offsets")
    counted = ranks.where("kind <> 3")
    total = F.col("before") + F.col("offset")
    return counted.join(offsets, ["axis", "part"]).groupBy("axis", "id") \
        .agg(F.sum(F.when(F.col("kind") == 2, total).otherwise(-total)).alias("n"))


def neighbour_radii(points: DataFrame, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, id, x, y, radius: the distance of each of ``points`` (feature, x, y) to its ``neighbours`` th nearest.

    A feature with too few rows has no radius and is left out.
    """
    sizes = points.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > neighbours)
    tied = points.join(F.broadcast(sizes), "feature").withColumn("tie", F.monotonically_increasing_id())
    width = F.ceil(F.sqrt(F.col("n") * F.lit(float(block_rows))))

    def placed() -> DataFrame:
        strips = ordered_positions(tied, ["x", "y", "tie"], ["feature"], "p") \
            .select("feature", "x", "y", "tie", F.floor(F.col("p") / width).alias("strip"))
        inside = ordered_positions(strips, ["y", "x", "tie"], ["feature", "strip"], "q")
        return inside.select("feature", "strip", F.floor(F.col("q") / F.lit(block_rows)).alias("part"), F.col("q").alias("at"), "x", "y")

    cells = land_alone(points.sparkSession, "cells", placed)
    block = ["feature", "strip", "part"]
    rows = cells.groupBy(*block).agg(F.collect_list(F.struct("at", "x", "y")).alias("rows"))
    own = land(rows.mapInArrow(_nearest(neighbours), _GAPS), "own")
    edges = [f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low_", F.min), ("high_", F.max))]
    boxes = land(cells.groupBy(*block).agg(*edges), "boxes")
    reach = F.when(F.size("gaps") >= neighbours, F.element_at("gaps", neighbours)).otherwise(F.lit(math.inf))

    def meets(box: str) -> Column:
        sides = [(F.col(f"{box}.low_{c}") <= F.col(f"g.{c}") + F.col("g.reach")) & (F.col(f"{box}.high_{c}") >= F.col(f"g.{c}") - F.col("g.reach")) for c in ("x", "y")]
        return sides[0] & sides[1]

    # There are as many strips as the square root of the number of blocks, and as many blocks in each.
    guests = own.select(*block, "at", "x", "y", reach.alias("reach")).where("reach > 0").alias("g")
    long = land(boxes.groupBy("feature", "strip").agg(*[f(f"{n}{c}").alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low_", F.min), ("high_", F.max))]), "strips")
    to_strips = guests.join(long.alias("s"), (F.col("g.feature") == F.col("s.feature")) & meets("s")) \
        .select("g.*", F.col("s.strip").alias("to_strip")).alias("g")
    visits = to_strips.join(boxes.alias("b"), (F.col("g.feature") == F.col("b.feature")) & (F.col("g.to_strip") == F.col("b.strip")) & meets("b")) \
        .select("g.*", F.col("b.part").alias("to_part")).where("NOT (strip = to_strip AND part = to_part)")
    grouped = visits.groupBy(*block, "to_strip", "to_part").agg(F.collect_list(F.struct("at", "x", "y")).alias("guests"))
    target = rows.select("feature", F.col("strip").alias("to_strip"), F.col("part").alias("to_part"), "rows")
    abroad = grouped.join(target, ["feature", "to_strip", "to_part"]).select(*block, "guests", "rows").mapInArrow(_visited(neighbours), _GAPS)
    every = own.unionByName(abroad).groupBy(*block, "at", "x", "y").agg(F.array_sort(F.flatten(F.collect_list("gaps"))).alias("gaps"))
    return every.select("feature", F.concat_ws("-", "strip", "at").alias("id"), "x", "y", F.element_at("gaps", neighbours).alias("radius"))


def label_radii(rows: DataFrame, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, id, y, radius, near, count: per row of ``rows`` (feature, label, y) the distance to its nearest
    ``neighbours`` rows of the same label, or to all if there are fewer; a label's only row is left out."""
    group = ["feature", "label"]
    placed = land_alone(rows.sparkSession, "placed", lambda: ordered_positions(
        rows.withColumn("tie", F.monotonically_increasing_id()), ["y", "tie"], group, "place").select(*group, "y", "place"))
    counts = land(placed.groupBy(*group).agg(F.count("*").alias("count")).where(F.col("count") > 1), "counts")
    block, inside = F.floor(F.col("place") / block_rows), F.pmod("place", F.lit(block_rows))
    # The rows at either end of a block are also given to the block beside it.
    homes = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")),
                                    F.when((inside < neighbours) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
                                    F.when(inside >= block_rows - neighbours, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
    blocks = placed.select(*group, "place", "y", F.explode(homes).alias("h")).groupBy(*group, "h.block") \
        .agg(F.collect_list(F.struct("place", "y", "h.own")).alias("rows")).where(F.exists("rows", lambda r: r["own"]))
    found = blocks.join(counts, group).select(*group, "count", "rows").mapInArrow(
        _along(neighbours), "feature string, label string, place bigint, y double, radius double, near bigint, count bigint")
    return found.select("feature", F.concat_ws("-", "place", "label").alias("id"), "y", "radius", "near", "count")


def _asked(df: DataFrame) -> DataFrame:
    return df.select("axis", "id", "value", "radius").mapInArrow(_bounds(2), "axis string, id string, low double, high double")


def continuous_information(points: DataFrame, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, mi of ``points`` (feature, x, y), whose axes are on one scale."""
    spark = points.sparkSession

    def estimate() -> DataFrame:
        radii = land_alone(spark, "radii", lambda: neighbour_radii(points, neighbours, block_rows))
        axes = F.explode(F.array(*[F.struct(F.concat(F.lit(c), "feature").alias("axis"), F.col(c).alias("value")) for c in ("x", "y")]))
        spread = radii.select("id", "radius", axes.alias("a")).select("id", "radius", "a.axis", "a.value")
        counted = counts_within(spread.select("axis", (F.col("value") + 0.0).alias("value")), _asked(spread))
        sums = counted.select(F.substring("axis", 2, 1 << 30).alias("feature"), digamma(F.col("n")).alias("d")).groupBy("feature") \
            .agg(F.sum("d").alias("d"), (F.count("*") / 2).cast("bigint").alias("n"))
        information = digamma(F.col("n")) + digamma(F.lit(neighbours)) - F.col("d") / F.col("n")
        return sums.select("feature", F.greatest(information, F.lit(0.0)).alias("mi"))

    return land_alone(spark, "continuous", estimate)


def discrete_information(rows: DataFrame, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, mi of ``rows`` (feature, label, y); rows whose label occurs once do not count."""
    spark = rows.sparkSession

    def estimate() -> DataFrame:
        radii = land_alone(spark, "radii", lambda: label_radii(rows, neighbours, block_rows))
        spread = radii.select(F.col("feature").alias("axis"), "id", F.col("y").alias("value"), "radius")
        counted = counts_within(spread.select("axis", (F.col("value") + 0.0).alias("value")), _asked(spread))
        within = counted.groupBy(F.col("axis").alias("feature")).agg(F.avg(digamma(F.col("n"))).alias("d"))
        means = radii.groupBy("feature").agg(F.count("*").alias("n"), F.avg(digamma(F.col("near"))).alias("near"), F.avg(digamma(F.col("count"))).alias("of_label"))
        information = digamma(F.col("n")) + F.col("near") - F.col("of_label") - F.col("d")
        return means.join(within, "feature").select("feature", F.greatest(information, F.lit(0.0)).alias("mi"))

    return land_alone(spark, "discrete", estimate)


def neighbour_information(df: DataFrame, discrete: Sequence[str], continuous: Sequence[str], target: str = "log_price",
                          neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mutual information (nats) of each feature with the target, highest first; NULL if there are too few rows.

    Numbers are divided by their standard deviation; missing ones count as 0 and missing categories as ``Unknown``.
    """
    numbers = [*continuous, target]
    types = dict(df.dtypes)
    spark = df.sparkSession
    names = spark.createDataFrame([(f,) for f in [*discrete, *continuous]], "feature string")

    def estimates() -> DataFrame:
        clean = land(df.select(
            *[(F.coalesce(F.col(c), F.lit("Unknown")) if types[c] == "string" else
               F.coalesce(F.col(c).cast("int").cast("string"), F.lit("0"))).alias(c) for c in discrete],
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers]), "clean")
        spreads = clean.agg(*[F.round(F.stddev_pop(c), SCALE_DIGITS).alias(c) for c in numbers]).first()
        on_scale = {c: F.col(c) / F.lit(spreads[c] or 1.0) for c in numbers}
        found = []
        if discrete:
            found.append(discrete_information(clean.select(on_scale[target].alias("y"), F.explode(F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in discrete])).alias("f")).select("f.*", "y"), neighbours, block_rows))
        if continuous:
            found.append(continuous_information(clean.select(on_scale[target].alias("y"), F.explode(F.array(
                *[F.struct(F.lit(c).alias("feature"), on_scale[c].alias("x")) for c in continuous])).alias("f")).select("f.*", "y"), neighbours, block_rows))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    both = land_alone(spark, "information", estimates)
    return names.join(both, "feature", "left").select("feature", "mi").orderBy(F.desc_nulls_last("mi"), "feature")
