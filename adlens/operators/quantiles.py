"""Exact percentiles without collecting a group into one task.

Spark's own ``percentile`` and ``median`` keep every distinct value of a group in one aggregation
buffer.  Here the wanted ranks are located by narrowing: a coarse histogram on a fixed monotone
scale straight from the rows, then the counted values of only those buckets that hold a wanted
rank, a fine histogram of them, and a running count over what is left.  The rows are read twice and
never shuffled: the first exchange carries histograms, the second the values of the chosen buckets.
Each step is a hash aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = 256      # coarse buckets per unit of log1p(|x|): about 0.4 % of the value wide
FINE = 4096       # fine buckets per chosen coarse bucket


def _within(before: Column, count: Column, ranks: Column) -> Column:
    """Ranks that fall into ``[before, before + count)``, as offsets from ``before``."""
    hit = F.filter(ranks, lambda r: (r["off"] >= before) & (r["off"] < before + count))
    return F.transform(hit, lambda r: F.struct(r["rank"], (r["off"] - before).alias("off")))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool) -> DataFrame:
    """Null-safe equi-join that keeps one copy of the key columns."""
    renamed = right.withColumnsRenamed({c: f"_r{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on]
    joined = left.join(F.broadcast(renamed) if small else renamed, match)
    return joined.drop(*[f"_r{c}" for c in on])


def exact_percentiles(df: DataFrame, value: str, probabilities: Sequence[float],
                      group_by: Sequence[str] = (), few_groups: bool = False,
                      name: str = "value") -> DataFrame:
    """Linear-interpolation percentiles: one row per group and probability.

    Columns: ``group_by``, ``p``, ``n`` (values counted) and ``name``.  NULL and NaN are skipped; a
    group without values has no row; without ``group_by`` an empty column gives NULL values.
    ``few_groups`` says that the number of groups is bounded
    by a fixed list, so the located buckets may be broadcast; otherwise Spark decides by size.
    """
    keys = list(group_by)
    small = few_groups or not keys
    probs = sorted({float(p) for p in probabilities})
    v = F.col("_v")
    rows = (df.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
            .withColumn("_b", F.floor(F.signum(v) * F.log1p(F.abs(v)) * COARSE)))

    # Step 1: coarse histogram, running count, ranks wanted in each bucket.
    coarse = rows.groupBy(*keys, "_b").agg(
        F.count("*").alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = coarse.select(
        *keys, "_b", "_cnt", "_lo", "_hi",
        (F.sum("_cnt").over(running) - F.col("_cnt")).alias("_before"),
        F.sum("_cnt").over(group).alias("_total"))
    ranks = F.array_distinct(F.array(*[
        f((F.col("_total") - 1) * F.lit(p)).cast("bigint")
        for p in probs for f in (F.floor, F.ceil)]))
    wanted = F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("off")))
    chosen = (placed.select(
        *keys, "_b", "_lo", "_hi", "_total",
        _within(F.col("_before"), F.col("_cnt"), wanted).alias("_ranks"))
        .where(F.size("_ranks") > 0))

    # Step 2: values of the chosen coarse buckets, and their fine histogram between the real bounds.
    share = F.when(F.col("_hi") > F.col("_lo"),
                   (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    # What depends on the bucket goes along as grouping columns and needs no second join.
    inside = (_join(rows, chosen, [*keys, "_b"], small)
              .groupBy(*keys, "_b", "_v", "_lo", "_hi", "_total", "_ranks").agg(F.count("*").alias("_n"))
              .withColumn("_f", F.least(F.floor(share * FINE), F.lit(FINE - 1))))
    fine = inside.groupBy(*keys, "_b", "_f", "_total", "_ranks").agg(F.sum("_n").alias("_cnt"))
    fine_running = (Window.partitionBy(*keys, "_b").orderBy("_f")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fine_placed = fine.withColumn("_before", F.sum("_cnt").over(fine_running) - F.col("_cnt"))
    fine_chosen = (fine_placed.select(
        *keys, "_b", "_f", "_total",
        _within(F.col("_before"), F.col("_cnt"), F.col("_ranks")).alias("_ranks"))
        .where(F.size("_ranks") > 0))

    # Step 3: running count over the distinct values of the chosen fine buckets.
    left = _join(inside.drop("_total", "_ranks"), fine_chosen, [*keys, "_b", "_f"], small)
    value_running = (Window.partitionBy(*keys, "_b", "_f").orderBy("_v")
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (left.withColumn("_before", F.sum("_n").over(value_running) - F.col("_n"))
            .select(*keys, "_total", "_v", F.explode(
                _within(F.col("_before"), F.col("_n"), F.col("_ranks"))).alias("_hit")))

    # At most two ranks per probability remain in a group.
    ends = hits.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_hit.rank"), F.col("_v")))).alias("_at"))
    spread = ends.select(*keys, "n", "_at", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
    position = (F.col("n") - 1) * F.col("p")
    low = F.element_at("_at", F.floor(position).cast("bigint"))
    high = F.element_at("_at", F.ceil(position).cast("bigint"))
    return spread.select(*keys, "p", "n",
                         (low + (high - low) * (position - F.floor(position))).alias(name))


def percentiles_wide(df: DataFrame, value: str, named: dict[str, float],
                     group_by: Sequence[str] = (), few_groups: bool = False,
                     exact: bool = True) -> DataFrame:
    """Percentiles as columns: ``group_by`` plus one column per name in ``named``.

    ``exact=False`` uses the mergeable sketch behind ``percentile_approx`` instead.
    """
    keys = list(group_by)
    if not exact:
        return df.groupBy(*keys).agg(*[
            F.percentile_approx(value, p, 100_000).alias(n) for n, p in named.items()])
    long = exact_percentiles(df, value, list(named.values()), keys, few_groups, name="_value")
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("_value"))).alias(n) for n, p in named.items()])


def median_by(df: DataFrame, value: str, group_by: Sequence[str] = (), name: str = "median",
              few_groups: bool = False, exact: bool = True) -> DataFrame:
    return percentiles_wide(df, value, {name: 0.5}, group_by, few_groups, exact)
