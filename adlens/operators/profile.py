"""Profiles of a listing table: counts, group statistics, distributions, associations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.constants import PERCENTILES, WEEKDAYS
from adlens.operators.derive import weekday_name
from adlens.operators.quantiles import exact_percentiles, median_by, percentiles_wide


# ---- counts and shares -----------------------------------------------------------------

def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count("*").alias(name)).orderBy(F.desc(name), column))


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of all rows per class.  The total is summed from the counts, not re-read."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (counts.where(F.col(column).isNotNull()).crossJoin(F.broadcast(total))
            .select(column, "n", F.try_divide("n", "_total").alias("share")))


def detection_rate(df: DataFrame, column: str, default: str) -> DataFrame:
    """How often a title rule found something other than its default."""
    found = F.col(column) != default
    return df.agg(F.count_if(found).alias("detected"), F.count("*").alias("total"),
                  F.avg(found.cast("int")).alias("rate"),
                  F.count_distinct(F.when(found, F.col(column))).alias("n_values"))


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    f = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(f(F.col(column)).alias("n_distinct"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows that repeat an earlier key.  A missing key counts as one value."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicates"))


def boolean_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True rows and their share, one row per boolean column, fewest first; no share of no rows."""
    one = df.agg(*[F.count_if(F.col(c)).alias(c) for c in columns], F.count("*").alias("_total"))
    long = one.select("_total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("e"))
    return long.select("e.column", "e.n", F.try_divide("e.n", "_total").alias("share")).orderBy("n", "column")


# ---- column profiles -------------------------------------------------------------------

def _per_column(df: DataFrame, columns: Sequence[str], fields: dict) -> DataFrame:
    """One aggregate over all columns, turned into one row per column.

    ``fields`` maps an output name to a function of the column name that gives an aggregate.
    """
    one = df.agg(*[f(c).alias(f"_{i}_{name}") for i, c in enumerate(columns)
                   for name, f in fields.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n in fields])
        for i, c in enumerate(columns)])))


def missing_fraction(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    return _per_column(df, cols, {
        "missing": lambda c: F.avg(F.col(c).isNull().cast("int"))}
    ).orderBy(F.desc("missing"), "column")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of complete columns and of columns that are more than half empty."""
    return missing_fraction(df, columns).agg(
        F.count_if(F.col("missing") == 0).alias("complete_columns"),
        F.count_if(F.col("missing") > 0.5).alias("mostly_missing_columns"))


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, filled and total rows."""
    types = dict(df.dtypes)
    return _per_column(df, df.columns, {
        "dtype": lambda c: F.first(F.lit(types[c])),
        "filled": lambda c: F.count(F.col(c)),
        "rows": lambda c: F.count(F.lit(1))})


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs; the fan-out stays inside the task, before the map-side combine."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    cols = list(columns)
    moments = _per_column(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quartiles = percentiles_wide(_long_values(df, cols), "value",
                                 {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"], few_groups=True)
    return moments.join(quartiles, "column", "left")


def describe_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, distinct values, most frequent value (lowest on ties) and its count per text column."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = (pairs.where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("top"),
        F.max("n").alias("freq"))


# ---- price distribution ----------------------------------------------------------------

def price_summary(df: DataFrame, price: str = "price_amount") -> DataFrame:
    """Median, mean, p95, p99 and maximum of paid rows, plus the number of free ones."""
    paid = df.where(F.col(price) > 0)
    wide = percentiles_wide(paid, price, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    rest = df.agg(F.avg(F.when(F.col(price) > 0, F.col(price))).alias("mean"),
                  F.max(F.when(F.col(price) > 0, F.col(price))).alias("max"),
                  F.count_if(F.col(price) > 0).alias("n_paid"),
                  F.count_if(F.col(price) == 0).alias("n_free"))
    return rest.crossJoin(F.broadcast(wide))


def percentile_table(df: DataFrame, column: str, percents: Sequence[int] = tuple(PERCENTILES)) -> DataFrame:
    long = exact_percentiles(df, column, [p / 100 for p in percents])
    return long.select(F.round(F.col("p") * 100).cast("int").alias("percent"), "value").orderBy("percent")


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """min, max, exact median, mean and number of zeros of a column."""
    c = F.col(column)
    one = df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
                 F.count_if(c == 0).alias("zeros"))
    return one.crossJoin(F.broadcast(median_by(df, column)))


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis per column."""
    return _per_column(df, list(columns), {
        "skewness": lambda c: F.nanvl(F.skewness(c), F.lit(None)),
        "kurtosis": lambda c: F.nanvl(F.kurtosis(c), F.lit(None))})


def iqr_outliers(df: DataFrame, price: str = "price_amount") -> DataFrame:
    """Rows outside 1.5 IQR in log space: count, share and the fences back in price units."""
    logged = df.select(F.log1p(price).alias("_log"))
    q = percentiles_wide(logged, "_log", {"q1": 0.25, "q3": 0.75})
    fences = q.select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lower"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_upper"))
    outside = (F.col("_log") < F.col("_lower")) | (F.col("_log") > F.col("_upper"))
    return logged.crossJoin(F.broadcast(fences)).agg(
        F.count_if(outside).alias("n_outliers"),
        F.avg(F.coalesce(outside, F.lit(False)).cast("int")).alias("share"),
        F.expm1(F.max("_lower")).alias("lower_price"), F.expm1(F.max("_upper")).alias("upper_price"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are listed.

    A constant column gets the range from half below to half above its value.
    """
    x = F.col("_x")
    values = df.select(F.col(column).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    low, high = F.min("_x"), F.max("_x")
    span = values.agg(
        F.when(low == high, low - 0.5).otherwise(low).alias("_lo"),
        F.when(low == high, high + 0.5).otherwise(high).alias("_hi"))
    edge = lambda i: F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / bins)
    guess = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                    F.lit(bins - 1))
    # Rounding may put a value next to an edge one bin off; compare with the edges themselves.
    settled = (F.when(x < edge(F.col("_g")), F.col("_g") - 1)
               .when((F.col("_g") < bins - 1) & (x >= edge(F.col("_g") + 1)), F.col("_g") + 1)
               .otherwise(F.col("_g")))
    counts = (values.crossJoin(F.broadcast(span)).withColumn("_g", guess)
              .groupBy(settled.alias("bin")).agg(F.count("*").alias("n")))
    frame = span.where(F.col("_lo").isNotNull()).select(
        "_lo", "_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return (frame.join(counts, "bin", "left")
            .select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin"))


def unit_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per whole number from 0, or a negative minimum, to the maximum, empty ones included.

    The numbers are a distributed range, so a wide one builds no array; their bounds are read first.
    """
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(F.floor(column).cast("bigint").alias("value")).agg(F.count("*").alias("n")))
    bounds = counts.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = (0, -1) if bounds["low"] is None else (min(0, bounds["low"]), bounds["high"])
    frame = df.sparkSession.range(low, max(low, high + 1)).withColumnRenamed("id", "value")
    return (frame.join(counts, "value", "left")
            .select("value", F.coalesce("n", F.lit(0)).alias("n")).orderBy("value"))


# ---- group statistics ------------------------------------------------------------------

def median_price_by(df: DataFrame, group: str, price: str = "price_amount",
                    few_groups: bool = False, exact: bool = True) -> DataFrame:
    """Listings and median price per group, dearest first; the missing group is left out."""
    known = df.where(F.col(group).isNotNull())
    medians = median_by(known, price, [group], few_groups=few_groups, exact=exact)
    counts = known.groupBy(group).agg(F.count("*").alias("n"))
    return counts.join(medians, group, "left").orderBy(F.desc_nulls_last("median"), group)


def price_stats_by(df: DataFrame, group: str, price: str = "price_amount",
                   few_groups: bool = False) -> DataFrame:
    """count, median, mean, min and max per group, rounded half-even to whole units."""
    known = df.where(F.col(group).isNotNull())
    stats = known.groupBy(group).agg(
        F.count(price).alias("count"), F.bround(F.avg(price), 0).alias("mean"),
        F.min(price).alias("_min"), F.max(price).alias("_max"))
    medians = median_by(known, price, [group], few_groups=few_groups)
    return stats.join(medians, group, "left").select(
        group, "count", F.bround("median", 0).alias("median"), "mean",
        F.bround("_min", 0).alias("min"), F.bround("_max", 0).alias("max"))


def boxplot_stats(df: DataFrame, group: str, value: str = "price_amount",
                  few_groups: bool = False) -> DataFrame:
    """Quartiles and whiskers (1.5 IQR, clipped to the data) per group, outliers hidden.

    The whiskers are the outermost values within reach, found by a second pass with map-side combine.
    """
    known = df.where(F.col(group).isNotNull())
    q = percentiles_wide(known, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group], few_groups)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    side = F.broadcast(q) if few_groups else q
    v = F.col("_v")
    inside = known.select(group, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v)).join(side, group)
    return inside.groupBy(group).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        F.count("*").alias("n"))


def median_ratio(df: DataFrame, flag: str, value: str = "price_amount") -> DataFrame:
    """Median where the flag is true, where it is false, and their ratio (NULL if the second is 0 or missing)."""
    m = median_by(df.where(F.col(flag).isNotNull()), value, [flag], few_groups=True)
    return m.agg(F.max(F.when(F.col(flag), F.col("median"))).alias("median_true"),
                 F.max(F.when(~F.col(flag), F.col("median"))).alias("median_false")
                 ).withColumn("ratio", F.try_divide("median_true", "median_false"))


# ---- time --------------------------------------------------------------------------------

def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day from the first to the last day, days without rows as 0."""
    counts = (df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"))
              .agg(F.count("*").alias("n")))
    days = counts.agg(F.min("day").alias("_a"), F.max("day").alias("_b")).where(
        F.col("_a").isNotNull()).select(F.explode(F.sequence("_a", "_b")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")
                                                   ).orderBy("day")


def weekday_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per weekday, Monday first; weekdays without rows stay NULL."""
    counts = (df.where(F.col(ts).isNotNull()).groupBy(weekday_name(F.col(ts)).alias("dow"))
              .agg(F.count("*").alias("n")))
    week = df.sparkSession.range(1).select(F.posexplode(F.array(
        *[F.lit(d) for d in WEEKDAYS])).alias("ordinal", "dow"))
    return week.join(counts, "dow", "left").select("ordinal", "dow", "n").orderBy("ordinal")


def hour_counts(df: DataFrame, ts: str) -> DataFrame:
    return (df.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour"))
            .agg(F.count("*").alias("n")).orderBy("hour"))


# ---- association with the price ----------------------------------------------------------

def feature_correlation(df: DataFrame, features: Sequence[str], target: str = "log_price") -> DataFrame:
    """Pearson r of each feature with the target over pairwise complete rows, weakest first.

    A constant feature has no correlation: NULL.
    """
    def pearson(c: str) -> Column:
        x, y = F.col(c), F.col("_y")
        spread = (F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))
        return F.try_divide(F.covar_pop(x, y), spread)

    names = list(features)
    numbers = df.select(F.col(target).cast("double").alias("_y"),
                        *[F.col(c).cast("double").alias(c) for c in names])
    return _per_column(numbers, names, {"r": pearson}).select(
        F.col("column").alias("feature"), "r").orderBy(F.abs("r").asc_nulls_first(), "feature")


def _edges(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """One row with an array of inner equal-frequency bin edges per column."""
    probs = [i / bins for i in range(1, bins)]
    long = exact_percentiles(_long_values(df, columns), "value", probs, ["column"], few_groups=True)
    return long.agg(*[
        F.array_distinct(F.sort_array(F.collect_list(
            F.when(F.col("column") == c, F.col("value"))))).alias(f"_e_{c}") for c in columns])


def mutual_information(df: DataFrame, discrete: Sequence[str], continuous: Sequence[str],
                       target: str = "log_price", bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the binned target, highest first.

    Continuous columns fall into equal-frequency bins; missing numbers count as 0 and missing
    categories as ``Unknown``.  All features share one pass: each row fans out to its (feature,
    bin, target bin) cells, which are counted on the map side, so the shuffle carries
    contingency tables and not rows.
    """
    numbers = [*continuous, target]
    types = dict(df.dtypes)
    clean = df.select(
        *[(F.coalesce(F.col(c), F.lit("Unknown")) if types[c] == "string" else
           F.coalesce(F.col(c).cast("int").cast("string"), F.lit("0"))).alias(c) for c in discrete],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers])
    edges = _edges(clean, numbers, bins)

    def below(value: Column, cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda e: e < value))

    def entry(c: str, label: Column, value: Column, cuts: Column) -> Column:
        return F.struct(F.lit(c).alias("feature"), label.alias("label"), value.alias("value"),
                        cuts.alias("cuts"))

    none = [F.lit(None).cast(t) for t in ("string", "double", "array<double>")]
    long = clean.crossJoin(F.broadcast(edges)).select(
        below(F.col(target), F.col(f"_e_{target}")).alias("y"),
        F.explode(F.array(
            *[entry(c, F.col(c), none[1], none[2]) for c in discrete],
            *[entry(c, none[0], F.col(c), F.col(f"_e_{c}")) for c in continuous])).alias("f"))
    cells = long.select("y", "f.feature", F.coalesce(
        "f.label", below(F.col("f.value"), F.col("f.cuts")).cast("string")).alias("x"))
    joint = cells.groupBy("feature", "x", "y").agg(F.count("*").alias("nxy"))
    return information_from_counts(joint)


def information_from_counts(joint: DataFrame) -> DataFrame:
    """Mutual information per ``feature`` from its contingency counts ``x, y, nxy``.

    The windows run over contingency cells (levels x target bins per feature), not over rows.
    """
    def total(*keys: str) -> Column:
        return F.sum("nxy").over(Window.partitionBy("feature", *keys))

    full = joint.select("nxy", "feature", total("x").alias("nx"), total("y").alias("ny"), total().alias("n"))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return full.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi")
                                       ).orderBy(F.desc("mi"), "feature")


def feature_shortlist(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                      discrete_numeric: Sequence[str], target: str = "log_price",
                      bins: int = 10) -> DataFrame:
    """Mutual information and Pearson r side by side, ranked by mutual information."""
    continuous = [c for c in numeric if c not in set(discrete_numeric)]
    mi = mutual_information(df, [*categorical, *[c for c in numeric if c in set(discrete_numeric)]],
                            continuous, target, bins)
    r = feature_correlation(df, numeric, target)
    kind = F.when(F.col("r_feature").isNull(), "categorical").otherwise("numeric")
    both = mi.join(r.withColumnRenamed("feature", "r_feature"),
                   F.col("feature") == F.col("r_feature"), "full_outer")
    return both.select(F.coalesce("feature", "r_feature").alias("feature"), kind.alias("kind"),
                       "mi", "r").orderBy(F.desc_nulls_last("mi"), "feature")

