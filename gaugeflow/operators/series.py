"""Time-series queries over ``(cell_id, ts, subtopic, reading, …)``.

Every query aggregates with map-side partial aggregation; raw rows are only
moved where a join on exact timestamps asks for it. Relative times count from
``as_of``, by default the newest timestamp (a scalar subquery).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.cells import SENSOR_ALIASES, normalize_cell_id, resolve_sensor
from gaugeflow.functions.joins import join_keys
from gaugeflow.functions.timeranges import choose_interval, interval_literal, latest, period, time_bucket

COMPARISONS = {
    ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__, "!=": Column.__ne__,
}


def meets(column, op: str, threshold) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return COMPARISONS[op](column, F.lit(threshold))


# --- scans -----------------------------------------------------------------


def scan_series(readings: DataFrame, cells=None, sensors=None, start=None, end=None, ordered: bool = False) -> DataFrame:
    """Readings of the chosen cells and sensors in an inclusive time range.

    All conditions are plain column comparisons, so they reach the scan (and
    prune partitions where the table is partitioned by ``cell_id``).
    """
    conditions = []
    if cells is not None:
        conditions.append(F.col("cell_id").isin(list(cells)))
    if sensors is not None:
        conditions.append(F.col("subtopic").isin(list(sensors)))
    if start is not None:
        conditions.append(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        conditions.append(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    found = reduce(DataFrame.filter, conditions, readings)
    return found.orderBy("ts") if ordered else found


def time_range_relative(readings: DataFrame, last: str = "24h", as_of: Column | None = None) -> DataFrame:
    as_of = latest(readings) if as_of is None else as_of
    return readings.filter(F.col("ts") >= as_of - interval_literal(last))


def time_range_absolute(readings: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive range; a bare date as end covers that whole day."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", end.strip()):
        next_day = F.lit(end.strip()).cast("date") + F.expr("INTERVAL '1' DAY")
        return scan_series(readings, start=start).filter(F.col("ts") < next_day.cast("timestamp_ntz"))
    return scan_series(readings, start=start, end=end)


def time_range_points(readings: DataFrame, point: str, as_of: Column | None = None) -> DataFrame:
    """``today``, ``yesterday``, ``this week``, ``this month`` or ``N days ago``."""
    as_of = latest(readings) if as_of is None else as_of
    ts = F.col("ts")
    day = F.date_trunc("day", as_of).cast("timestamp_ntz")
    ago = re.fullmatch(r"(\d+) days? ago", point)
    if point == "today":
        return readings.filter((ts >= day) & (ts <= as_of))
    if point in ("this week", "this month"):
        return readings.filter((ts >= F.date_trunc(point.split()[1], as_of).cast("timestamp_ntz")) & (ts <= as_of))
    if point == "yesterday" or ago:
        back = 1 if point == "yesterday" else int(ago.group(1))
        begin = day - interval_literal(f"{back}d")
        return readings.filter((ts >= begin) & (ts < begin + interval_literal("1d")))
    raise ValueError(f"not a point in time: {point!r}")


# --- catalogue -------------------------------------------------------------


def list_cells(readings: DataFrame) -> DataFrame:
    return readings.select("cell_id").filter(F.col("cell_id").startswith("cell_")).distinct().orderBy("cell_id")


def cell_sensors(readings: DataFrame, cell: str | None = None) -> DataFrame:
    rows = readings if cell is None else readings.filter(F.col("cell_id") == cell)
    keys = ["cell_id"] if cell is None else []
    return rows.select(*keys, "subtopic", "field_name", "unit", "sensor_type").distinct()


def describe_series(readings: DataFrame, cells: str) -> tuple[list[tuple[str, str]], DataFrame, dict[str, str]]:
    """Columns of the series table, sensors of the chosen cells, and the alias map."""
    wanted = readings.sparkSession.createDataFrame([(c,) for c in cells.split(",")], "raw string").select(
        normalize_cell_id("raw").alias("cell_id")
    )
    sensors = cell_sensors(readings).join(wanted, "cell_id", "left_semi")
    return [(f.name, f.dataType.simpleString()) for f in readings.schema], sensors, dict(SENSOR_ALIASES)


def resolve_sensors(requests: DataFrame, alias: str = "alias") -> DataFrame:
    return requests.withColumn("subtopic", resolve_sensor(alias))


def union_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-cell tables as one table with a ``cell_id`` column."""
    parts = [df.select(F.lit(cell).alias("cell_id"), *df.columns) for cell, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- current values --------------------------------------------------------


def current_value(readings: DataFrame, cell: str, sensor: str) -> DataFrame:
    """Newest reading of one sensor: a distributed top-1, no full sort."""
    return scan_series(readings, [cell], [sensor]).orderBy(F.desc("ts"), F.desc("msg_id")).limit(1)


def current_values(readings: DataFrame, sensor: str | None = None, within: str = "1h", as_of: Column | None = None) -> DataFrame:
    """Newest reading per cell and sensor; cells silent for longer than ``within`` are left out."""
    as_of = latest(readings) if as_of is None else as_of
    rows = readings if sensor is None else readings.filter(F.col("subtopic") == sensor)
    newest = F.max_by(F.struct("ts", "msg_id", "reading", "unit"), F.struct("ts", "msg_id"))
    return (
        rows.filter(F.col("ts") >= as_of - interval_literal(within))
        .groupBy("cell_id", "subtopic")
        .agg(newest.alias("n"))
        .select("cell_id", "subtopic", "n.*")
    )


# --- statistics ------------------------------------------------------------


def statistics(readings: DataFrame, by=("cell_id", "subtopic"), median: bool = False) -> DataFrame:
    """Mean, population deviation and variance, extremes, sum and count per group."""
    r = F.col("reading")
    plain = readings.groupBy(*by).agg(
        F.avg(r).alias("mean_value"),
        F.stddev_pop(r).alias("stddev_value"),
        F.var_pop(r).alias("var_value"),
        F.min(r).alias("min_value"),
        F.max(r).alias("max_value"),
        F.sum(r).alias("sum_value"),
        F.count(r).alias("data_point_count"),
    )
    if not median:
        return plain
    return join_keys(plain, percentile(readings, 0.5, by, "median_value"), list(by), "left")


def percentile(readings: DataFrame, p: float, by=("cell_id", "subtopic"), name: str = "percentile_value", accuracy: int = 10000) -> DataFrame:
    """Exact interpolated percentile per group, without holding a group in memory.

    A mergeable sketch brackets the percentile within its error bound. Values
    outside the bracket are only counted, the ones inside are counted by value
    over 64 sub-ranges, and just the sub-ranges that hold the wanted ranks are
    ordered. No task sees more than a sliver of a busy group.
    """
    by = list(by)
    r = F.col("reading")
    rows = readings.filter(r.isNotNull() & ~F.isnan(r)).select(*by, r.alias("v"))
    margin = 3.0 / accuracy
    # Below this size the margin spans less than a few ranks, so the whole range is the bracket.
    small = F.count("v") < 2 * accuracy
    lowest, highest = F.min("v"), F.max("v")
    bracket = rows.groupBy(*by).agg(
        F.count("v").alias("n"),
        (F.when(small, lowest).otherwise(F.percentile_approx("v", p - margin, accuracy)) if p > margin else lowest).alias("lo"),
        (F.when(small, highest).otherwise(F.percentile_approx("v", p + margin, accuracy)) if p < 1 - margin else highest).alias("hi"),
    )
    span = F.col("hi") - F.col("lo")
    sub = (
        F.when(F.col("v") < F.col("lo"), -1)
        .when(F.col("v") > F.col("hi"), 64)
        .when(span > 0, F.least(F.floor((F.col("v") - F.col("lo")) / span * 64), F.lit(63)).cast("int"))
        .otherwise(0)
    )
    counts = (
        join_keys(rows, bracket, by)
        .withColumn("sub", sub)
        .withColumn("v", F.when(F.col("sub").between(0, 63), F.col("v")))
        .groupBy(*by, "n", "sub", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    rank = F.lit(p) * (F.col("n") - 1)
    first, second = F.floor(rank), F.ceil(rank)
    earlier = W.partitionBy(*by).orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        counts.groupBy(*by, "n", "sub")
        .agg(F.sum("c").alias("total"))
        .withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        .filter((F.col("before") <= second) & (F.col("before") + F.col("total") > first))
        .select(*by, "sub", "before")
    )
    upto = W.partitionBy(*by, "sub").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    placed = join_keys(counts, wanted, [*by, "sub"]).withColumn("at", F.col("before") + F.coalesce(F.sum("c").over(upto), F.lit(0)))

    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("at") <= k) & (F.col("at") + F.col("c") > k), F.col("v")))

    found = placed.groupBy(*by, "n").agg(value_at(first).alias("a"), value_at(second).alias("b"))
    # The sketch bound guarantees both ranks lie inside the bracket; fail loudly if it ever did not hold.
    exact = F.when(
        F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (rank - first))
    return found.select(*by, exact.alias(name))


def first_last(readings: DataFrame, by=("cell_id", "subtopic")) -> DataFrame:
    """First and last non-null reading by time."""
    order = F.struct("ts", "msg_id")
    return (
        readings.filter(F.col("reading").isNotNull())
        .groupBy(*by)
        .agg(F.min_by("reading", order).alias("first_value"), F.max_by("reading", order).alias("last_value"))
    )


def compare_cells(readings: DataFrame, sensor: str, cells=None, baseline: str | None = None) -> DataFrame:
    """Per-cell statistics of one sensor with the difference of the mean to the
    overall mean and, if asked for, to the mean of a baseline cell."""
    rows = scan_series(readings, cells, [sensor])
    r = F.col("reading")
    per_cell = rows.groupBy("cell_id").agg(
        F.avg(r).alias("mean_value"),
        F.stddev_pop(r).alias("stddev_value"),
        F.min(r).alias("min_value"),
        F.max(r).alias("max_value"),
        F.count(r).alias("data_point_count"),
    )
    result = per_cell.withColumn("diff_to_overall", F.col("mean_value") - rows.agg(F.avg(r)).scalar())
    if baseline is not None:
        other = rows.filter(F.col("cell_id") == baseline).agg(F.avg(r)).scalar()
        result = result.withColumn("diff_to_baseline", F.col("mean_value") - other)
    return result


# --- trends ----------------------------------------------------------------


def trend(readings: DataFrame, interval: str | None = None, by=("cell_id", "subtopic"), length: str = "24h") -> DataFrame:
    """Tumbling averages; the bucket width follows the period unless given."""
    interval = interval or choose_interval(length)
    r = F.col("reading")
    return readings.groupBy(*by, time_bucket("ts", interval).alias("bucket")).agg(
        F.avg(r).alias("mean_value"), F.min(r).alias("min_value"), F.max(r).alias("max_value"), F.count(r).alias("data_point_count")
    )


def trend_direction(readings: DataFrame, interval: str, by=("cell_id", "subtopic")) -> DataFrame:
    """Direction and size of the change from the first to the last bucket."""
    by = list(by)
    ends = trend(readings, interval, by).groupBy(*by).agg(
        F.min_by("mean_value", "bucket").alias("first_mean"),
        F.max_by("mean_value", "bucket").alias("last_mean"),
        F.count(F.lit(1)).alias("buckets"),
    )
    change = F.col("last_mean") - F.col("first_mean")
    direction = F.when(change > 0, F.lit("up")).when(change < 0, F.lit("down")).otherwise(F.lit("flat"))
    return ends.withColumn("change", change).withColumn("direction", direction)


def trend_steps(readings: DataFrame, interval: str, by=("cell_id", "subtopic")) -> DataFrame:
    """Change of each bucket average against the bucket before it."""
    order = W.partitionBy(*by).orderBy("bucket")
    return trend(readings, interval, by).withColumn("step", F.col("mean_value") - F.lag("mean_value").over(order))


def regression_over_time(readings: DataFrame, by=("cell_id", "subtopic")) -> DataFrame:
    """Least squares line of the reading against days since the group's first reading."""
    y = F.col("reading")
    days = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    rows = readings.filter(y.isNotNull()).withColumn("_x", days)
    slope = F.regr_slope(y, F.col("_x"))
    return rows.groupBy(*by).agg(
        slope.alias("slope_per_day"),
        (F.avg(y) - slope * (F.avg("_x") - F.min("_x"))).alias("intercept"),
        F.regr_r2(y, F.col("_x")).alias("r2"),
        F.count(F.lit(1)).alias("data_point_count"),
    )


# --- several sensors -------------------------------------------------------


def aligned_filter(readings: DataFrame, target: str, condition: str, op: str, threshold: float) -> DataFrame:
    """Readings of one sensor at the timestamps where another one meets a condition.

    Both sides are filtered before the equi join on ``(cell_id, ts)``.
    """
    t = readings.filter(F.col("subtopic") == target).select("cell_id", "ts", F.col("reading").alias("target_value"))
    c = readings.filter((F.col("subtopic") == condition) & meets("reading", op, threshold)).select(
        "cell_id", "ts", F.col("reading").alias("condition_value")
    )
    return t.join(c, ["cell_id", "ts"])


def align_by_bucket(readings: DataFrame, x: str, y: str, interval: str, by=("cell_id",)) -> DataFrame:
    """Bucket averages of two sensors; buckets without one of them are left out.

    One conditional aggregation replaces the self join.
    """
    r, s = F.col("reading"), F.col("subtopic")
    return (
        readings.filter(s.isin(x, y))
        .groupBy(*by, time_bucket("ts", interval).alias("bucket"))
        .agg(F.avg(F.when(s == x, r)).alias("x"), F.avg(F.when(s == y, r)).alias("y"))
        .dropna(subset=["x", "y"])
    )


def correlation(readings: DataFrame, x: str, y: str, interval: str, by=("cell_id",)) -> DataFrame:
    """Coefficient, covariance and number of aligned buckets; NULL for a constant sensor."""
    pairs = align_by_bucket(readings, x, y, interval, by)
    # the corr aggregate fails on a constant side in ANSI mode; the quotient gives NULL there
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    return pairs.groupBy(*by).agg(
        (F.covar_pop("x", "y") / spread).alias("coefficient"),
        F.covar_pop("x", "y").alias("covariance"),
        F.count(F.lit(1)).alias("data_point_count"),
    )


def value_filter(readings: DataFrame, op: str, threshold: float, sensor: str | None = None) -> DataFrame:
    """The same condition over all cells."""
    rows = readings if sensor is None else readings.filter(F.col("subtopic") == sensor)
    return rows.filter(meets("reading", op, threshold))


def matching_cells(readings: DataFrame, op: str, threshold: float, sensor: str | None = None) -> DataFrame:
    return value_filter(readings, op, threshold, sensor).groupBy("cell_id").agg(F.count(F.lit(1)).alias("data_point_count"))


def expand_range_if_empty(
    readings: DataFrame, requested: str = "24h", wider=("7d", "30d"), as_of: Column | None = None
) -> DataFrame:
    """First of the requested and wider ranges that has data, with its count.

    One aggregation counts every candidate range; ``expanded`` is ``all`` when
    only the whole table has data and NULL when the table is empty.
    """
    as_of = latest(readings) if as_of is None else as_of
    steps = [requested, *[w for w in wider if period(w) > period(requested)]]
    counts = readings.filter(F.col("ts") <= as_of).agg(
        *[F.count_if(F.col("ts") >= as_of - interval_literal(s)).alias(f"n_{i}") for i, s in enumerate(steps)],
        F.count(F.lit(1)).alias("n_all"),
    )
    names = [*[(f"n_{i}", s) for i, s in enumerate(steps)], ("n_all", "all")]
    chosen = F.coalesce(*[F.when(F.col(c) > 0, F.lit(s)) for c, s in names])
    amount = F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c, _ in names], F.lit(0))
    return counts.select(F.lit(requested).alias("original"), chosen.alias("expanded"), amount.alias("data_point_count"))


def result_envelope(stats: DataFrame, sensors: list[str], time_range: str, days: float, intent: str) -> DataFrame:
    """Answer document over an aggregated result with one row per cell.

    ``data`` is filled for trend and current queries only, ``correlations`` for
    correlation queries, ``statistics`` otherwise.
    """
    values = [c for c in stats.columns if c != "cell_id"]
    rows = F.array_sort(F.collect_list(F.struct("cell_id", *values)))
    section = {"trend": "data", "current": "data", "correlation": "correlations"}.get(intent, "statistics")
    parts = [F.col("rows").alias(n) if n == section else F.lit(None).cast("string").alias(n) for n in ("data", "statistics", "correlations")]
    body = F.struct(
        F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["cell_id"]))).alias("cells"),
        F.array(*[F.lit(s) for s in sensors]).alias("sensors"),
        F.lit(time_range).alias("time_range"),
        F.lit(float(days)).alias("time_period_days"),
        F.lit(intent).alias("query_intent"),
        *parts,
    )
    return stats.agg(rows.alias("rows")).select(F.to_json(body).alias("envelope"))
