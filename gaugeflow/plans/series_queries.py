"""Time-series and dashboard queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.cells import SENSOR_ALIASES, normalize_cell_id
from gaugeflow.operators import dashboard as D
from gaugeflow.operators import series as S
from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import readings, readings_pair


def rounded(df, *names):
    """Rounds the named columns to 6 digits for comparison."""
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


STATS = ("mean_value", "stddev_value", "var_value", "min_value", "max_value", "sum_value")
SQL_STATS = """round(avg(reading), 6) AS mean_value, round(stddev_pop(reading), 6) AS stddev_value,
    round(var_pop(reading), 6) AS var_value, round(min(reading), 6) AS min_value, round(max(reading), 6) AS max_value,
    round(sum(reading), 6) AS sum_value, count(reading) AS data_point_count"""


@query("scan_series", "readings", sql="""SELECT cell_id, ts, subtopic, reading FROM readings WHERE cell_id IN ('cell_8', 'cell_46', 'cell_7')
    AND subtopic IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def _(spark, d):
    found = S.scan_series(readings(spark, d), ["cell_8", "cell_46", "cell_7"], ["click", "error"], "2024-01-05", "2024-01-20 12:00:00")
    return found.select("cell_id", "ts", "subtopic", "reading")


@query("list_cells", "readings", sql="SELECT DISTINCT cell_id FROM readings WHERE starts_with(cell_id, 'cell_')")
def _(spark, d):
    return S.list_cells(readings(spark, d))


@query("cell_sensors", "readings", sql="SELECT DISTINCT cell_id, subtopic, field_name, unit, sensor_type FROM readings")
def _(spark, d):
    return S.cell_sensors(readings(spark, d))


@query("describe_series", "readings", sql="""SELECT DISTINCT cell_id, subtopic, field_name, unit, sensor_type FROM readings
    WHERE cell_id IN ('cell_1', 'cell_2', 'cell_46')""")
def _(spark, d):
    return S.describe_series(readings(spark, d), "cell1, cell 2,46")[1]


@query("normalize_cell_id", "readings", sql="""SELECT raw, CASE WHEN starts_with(raw, 'cell_') OR NOT regexp_matches(raw, '[0-9]') THEN raw
    ELSE 'cell_' || regexp_extract(raw, '[0-9]+') END AS cell_id
    FROM (SELECT DISTINCT replace(trim(w), ' ', '_') AS raw FROM readings,
      unnest([cell_id, replace(cell_id, '_', ' '), replace(cell_id, '_', ''), substr(cell_id, 6), ' ' || subtopic || ' ']) u(w))""")
def _(spark, d):
    cell = F.col("cell_id")
    spellings = F.array(
        cell, F.replace(cell, F.lit("_"), F.lit(" ")), F.replace(cell, F.lit("_"), F.lit("")), F.substr(cell, F.lit(6)),
        F.concat(F.lit(" "), "subtopic", F.lit(" ")),
    )
    raw = F.replace(F.trim("w"), F.lit(" "), F.lit("_"))
    return readings(spark, d).select(F.explode(spellings).alias("w")).select(raw.alias("raw"), normalize_cell_id("w").alias("cell_id")).distinct()


@query("resolve_sensor", "readings", sql="""WITH a(alias, sub) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in SENSOR_ALIASES.items()) + """),
    asked AS (SELECT DISTINCT CASE subtopic WHEN 'click' THEN 'glucose' WHEN 'view' THEN 'oxygen' WHEN 'error' THEN 'ROS AU' ELSE subtopic END AS alias
      FROM readings) SELECT asked.alias, coalesce(a.sub, asked.alias) AS subtopic FROM asked LEFT JOIN a ON a.alias = asked.alias""")
def _(spark, d):
    alias = F.expr("CASE subtopic WHEN 'click' THEN 'glucose' WHEN 'view' THEN 'oxygen' WHEN 'error' THEN 'ROS AU' ELSE subtopic END")
    return S.resolve_sensors(readings(spark, d).select(alias.alias("alias")).distinct())


@query("time_range_relative", "readings", sql="""SELECT cell_id, count(*) AS n FROM readings
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def _(spark, d):
    return S.time_range_relative(readings(spark, d), "7d").groupBy("cell_id").agg(F.count("*").alias("n"))


@query("time_range_absolute", "readings", sql="""SELECT cell_id, count(*) AS n FROM readings
    WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-09 23:59:59' GROUP BY 1""")
def _(spark, d):
    return S.time_range_absolute(readings(spark, d), "2024-01-03", "2024-01-09").groupBy("cell_id").agg(F.count("*").alias("n"))


@query("time_range_points", "readings", sql="""WITH a AS (SELECT max(ts) AS t FROM events)
    SELECT 'today' AS point, count(*) AS n FROM readings, a WHERE ts >= date_trunc('day', t) AND ts <= t
    UNION ALL SELECT 'yesterday', count(*) FROM readings, a WHERE ts >= date_trunc('day', t) - INTERVAL 1 DAY AND ts < date_trunc('day', t)
    UNION ALL SELECT 'this week', count(*) FROM readings, a WHERE ts >= date_trunc('week', t) AND ts <= t
    UNION ALL SELECT 'this month', count(*) FROM readings, a WHERE ts >= date_trunc('month', t) AND ts <= t
    UNION ALL SELECT '3 days ago', count(*) FROM readings, a WHERE ts >= date_trunc('day', t) - INTERVAL 3 DAY AND ts < date_trunc('day', t) - INTERVAL 2 DAY""")
def _(spark, d):
    r = readings(spark, d)
    parts = [
        S.time_range_points(r, p).agg(F.count("*").alias("n")).select(F.lit(p).alias("point"), "n")
        for p in ("today", "yesterday", "this week", "this month", "3 days ago")
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@query("current_value", "readings", sql="""SELECT cell_id, subtopic, ts, reading, unit FROM readings WHERE cell_id = 'cell_46' AND subtopic = 'click'
    ORDER BY ts DESC, msg_id DESC LIMIT 1""")
def _(spark, d):
    return S.current_value(readings(spark, d), "cell_46", "click").select("cell_id", "subtopic", "ts", "reading", "unit")


@query("current_values", "readings", sql="""SELECT cell_id, subtopic, max(ts) AS ts, max(msg_id) AS msg_id, arg_max(reading, ts) AS reading,
    arg_max(unit, ts) AS unit FROM readings WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def _(spark, d):
    return S.current_values(readings(spark, d), within="1d")


@query("statistics", "readings", sql=f"SELECT cell_id, subtopic, {SQL_STATS}, round(median(reading), 6) AS median_value FROM readings GROUP BY ALL")
def _(spark, d):
    return rounded(S.statistics(readings(spark, d), median=True), *STATS, "median_value")


@query("percentile", "readings", sql="""SELECT subtopic, round(quantile_cont(reading, 0.95), 6) AS p95 FROM readings GROUP BY ALL""")
def _(spark, d):
    return rounded(S.percentile(readings(spark, d), 0.95, ["subtopic"], "p95"), "p95")


@query("first_last", "readings", sql="""SELECT cell_id, subtopic, arg_min(reading, ts) AS first_value, arg_max(reading, ts) AS last_value
    FROM readings WHERE reading IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return S.first_last(readings(spark, d))


TREND = ("mean_value", "min_value", "max_value")
SQL_TREND = """round(avg(reading), 6) AS mean_value, round(min(reading), 6) AS min_value, round(max(reading), 6) AS max_value,
    count(reading) AS data_point_count"""


@query("trend_hourly", "readings", sql=f"SELECT subtopic, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, {SQL_TREND} FROM readings GROUP BY ALL")
def _(spark, d):
    return rounded(S.trend(readings(spark, d), "1h", ["subtopic"]), *TREND)


@query("trend_weekly", "readings", sql=f"SELECT cell_id, date_trunc('week', ts)::TIMESTAMP AS bucket, {SQL_TREND} FROM readings GROUP BY ALL")
def _(spark, d):
    return rounded(S.trend(readings(spark, d), "1w", ["cell_id"]), *TREND)


@query("choose_interval", "readings", sql=f"""WITH m AS (SELECT max(ts) AS t FROM events)
    SELECT '24h' AS period, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, {SQL_TREND} FROM readings, m WHERE ts >= t - INTERVAL 24 HOUR GROUP BY ALL
    UNION ALL SELECT '7d', time_bucket(INTERVAL 1 HOUR, ts), {SQL_TREND} FROM readings, m WHERE ts >= t - INTERVAL 7 DAY GROUP BY ALL
    UNION ALL SELECT '30d', time_bucket(INTERVAL 1 DAY, ts), {SQL_TREND} FROM readings, m WHERE ts >= t - INTERVAL 30 DAY GROUP BY ALL""")
def _(spark, d):
    r = readings(spark, d)
    parts = [rounded(S.trend(S.time_range_relative(r, p), by=[], length=p), *TREND).withColumn("period", F.lit(p)) for p in ("24h", "7d", "30d")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("compare_cells", "readings", sql="""WITH r AS (SELECT * FROM readings WHERE subtopic = 'click')
    SELECT cell_id, round(avg(reading), 6) AS mean_value, round(stddev_pop(reading), 6) AS stddev_value, min(reading) AS min_value,
    max(reading) AS max_value, count(reading) AS data_point_count, round(avg(reading) - (SELECT avg(reading) FROM r), 6) AS diff_to_overall,
    round(avg(reading) - (SELECT avg(reading) FROM r WHERE cell_id = 'cell_46'), 6) AS diff_to_baseline FROM r GROUP BY ALL""")
def _(spark, d):
    result = S.compare_cells(readings(spark, d), "click", baseline="cell_46")
    return rounded(result, "mean_value", "stddev_value", "diff_to_overall", "diff_to_baseline")


@query("union_cells", "readings", sql="""SELECT cell_id, ts, reading FROM readings WHERE cell_id IN ('cell_8', 'cell_46')""")
def _(spark, d):
    r = readings(spark, d)
    return S.union_cells({c: r.filter(F.col("cell_id") == c).select("ts", "reading") for c in ("cell_8", "cell_46")})


@query("aligned_filter", "readings_pair", sql="""SELECT g.cell_id, g.ts, g.reading AS target_value, p.reading AS condition_value
    FROM readings_pair g JOIN readings_pair p ON g.ts = p.ts AND g.cell_id = p.cell_id
    WHERE g.subtopic = 'click' AND p.subtopic = 'k' AND p.reading > 70""")
def _(spark, d):
    return S.aligned_filter(readings_pair(spark, d), "click", "k", ">", 70.0)


@query("align_by_bucket", "readings", sql="""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket,
    round(avg(reading) FILTER (subtopic = 'click'), 6) AS x, round(avg(reading) FILTER (subtopic = 'view'), 6) AS y FROM readings GROUP BY ALL)
    WHERE x IS NOT NULL AND y IS NOT NULL""")
def _(spark, d):
    return rounded(S.align_by_bucket(readings(spark, d), "click", "view", "1h", []), "x", "y")


@query("correlation", "readings", sql="""WITH b AS (SELECT project_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, avg(reading) FILTER (subtopic = 'click') AS x,
    avg(reading) FILTER (subtopic = 'view') AS y FROM readings GROUP BY ALL)
    SELECT project_id, round(corr(x, y), 6) AS coefficient, round(covar_pop(x, y), 6) AS covariance, count(*) AS data_point_count
    FROM b WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return rounded(S.correlation(readings(spark, d), "click", "view", "1h", ["project_id"]), "coefficient", "covariance")


@query("regression_over_time", "readings", sql="""WITH f AS (SELECT *, epoch_us(ts - min(ts) OVER (PARTITION BY subtopic)) / 86400000000.0 AS x FROM readings)
    SELECT subtopic, round(regr_slope(reading, x), 5) AS slope_per_day, round(regr_intercept(reading, x), 5) AS intercept,
    round(regr_r2(reading, x), 6) AS r2, count(*) AS data_point_count FROM f GROUP BY ALL""")
def _(spark, d):
    result = S.regression_over_time(readings(spark, d), ["subtopic"])
    return rounded(result, "r2").withColumns({c: F.round(F.col(c), 5) for c in ("slope_per_day", "intercept")})


@query("value_filter", "readings", sql="SELECT cell_id, ts, subtopic, reading FROM readings WHERE reading > 200")
def _(spark, d):
    return S.value_filter(readings(spark, d), ">", 200.0).select("cell_id", "ts", "subtopic", "reading")


@query("matching_cells", "readings", sql="SELECT cell_id, count(*) AS data_point_count FROM readings WHERE subtopic = 'error' AND reading <= 10 GROUP BY ALL")
def _(spark, d):
    return S.matching_cells(readings(spark, d), "<=", 10.0, "error")


@query("expand_range_if_empty", "readings", sql="""WITH r AS (SELECT * FROM readings WHERE cell_id = 'cell_46' AND subtopic = 'click'),
    m AS (SELECT max(ts) + INTERVAL 3 DAY AS t FROM events),
    c AS (SELECT count(*) FILTER (ts >= t - INTERVAL 24 HOUR) AS n1, count(*) FILTER (ts >= t - INTERVAL 7 DAY) AS n2,
      count(*) FILTER (ts >= t - INTERVAL 30 DAY) AS n3, count(*) AS n4 FROM r, m)
    SELECT '24h' AS original, CASE WHEN n1 > 0 THEN '24h' WHEN n2 > 0 THEN '7d' WHEN n3 > 0 THEN '30d' WHEN n4 > 0 THEN 'all' END AS expanded,
    CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 ELSE n4 END AS data_point_count FROM c""")
def _(spark, d):
    r = readings(spark, d)
    as_of = r.agg(F.max("ts") + F.expr("interval 3 days")).scalar()
    return S.expand_range_if_empty(S.scan_series(r, ["cell_46"], ["click"]), "24h", as_of=as_of)


@query("result_envelope", "readings", sql="""SELECT to_json({'cells': (SELECT list(DISTINCT cell_id ORDER BY cell_id) FROM readings WHERE subtopic = 'click' AND cell_id IN ('cell_8', 'cell_46')), 'sensors': ['click'], 'time_range': 'all', 'time_period_days': 30.0::DOUBLE,
    'query_intent': 'statistical', 'statistics': (SELECT list(s ORDER BY s.cell_id) FROM (SELECT {'cell_id': cell_id, 'mean_value': round(avg(reading), 3),
      'data_point_count': count(*)} AS s FROM readings WHERE subtopic = 'click' AND cell_id IN ('cell_8', 'cell_46') GROUP BY cell_id))})::VARCHAR AS envelope""")
def _(spark, d):
    rows = S.scan_series(readings(spark, d), ["cell_8", "cell_46"], ["click"])
    stats = rows.groupBy("cell_id").agg(F.round(F.avg("reading"), 3).alias("mean_value"), F.count("*").alias("data_point_count"))
    return S.result_envelope(stats, ["click"], "all", 30, "statistical")


@query("trend_direction", "readings", sql="""WITH b AS (SELECT cell_id, subtopic, time_bucket(INTERVAL 1 DAY, ts) AS bucket, avg(reading) AS m FROM readings GROUP BY ALL),
    e AS (SELECT cell_id, subtopic, arg_min(m, bucket) AS f, arg_max(m, bucket) AS l, count(*) AS buckets FROM b GROUP BY ALL)
    SELECT cell_id, subtopic, round(f, 6) AS first_mean, round(l, 6) AS last_mean, buckets, round(l - f, 6) AS change,
    CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'flat' END AS direction FROM e""")
def _(spark, d):
    return rounded(S.trend_direction(readings(spark, d), "1d"), "first_mean", "last_mean", "change")


@query("trend_steps", "readings", sql="""WITH b AS (SELECT subtopic, time_bucket(INTERVAL 1 DAY, ts) AS bucket, avg(reading) AS m, count(*) AS data_point_count FROM readings GROUP BY ALL)
    SELECT subtopic, bucket, round(m, 6) AS mean_value, data_point_count, round(m - lag(m) OVER (PARTITION BY subtopic ORDER BY bucket), 6) AS step FROM b""")
def _(spark, d):
    steps = S.trend_steps(readings(spark, d), "1d", ["subtopic"])
    return rounded(steps, "mean_value", "step").drop("min_value", "max_value")


@query("recent_window", "readings", sql="""SELECT equipment_id, sensor_type, ts, value FROM readings r
    WHERE ts >= (SELECT max(ts) FROM readings q WHERE q.equipment_id = r.equipment_id) - INTERVAL 1 DAY""")
def _(spark, d):
    return D.recent_window(readings(spark, d), 86400).select("equipment_id", "sensor_type", "ts", "value")


SENSORS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_series", "readings", sql="""WITH w AS (SELECT *, epoch_us(ts) // 1000 AS t FROM readings r
      WHERE ts >= (SELECT max(ts) FROM readings q WHERE q.equipment_id = r.equipment_id) - INTERVAL 1 DAY),
    p AS (SELECT equipment_id, t, """ + ", ".join(f"arg_max(value, msg_id) FILTER (sensor_type = '{s}') AS {s}" for s in SENSORS) + """ FROM w GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY t) - 1 AS i FROM p""")
def _(spark, d):
    wide = D.pivot_series(D.recent_window(readings(spark, d), 86400), SENSORS)
    return wide.withColumn("i", F.col("i").cast("bigint"))


@query("available_features", "readings", sql="SELECT DISTINCT sensor_type FROM readings WHERE sensor_type IN ('view', 'error', 'absent')")
def _(spark, d):
    return D.available_features(readings(spark, d), ["view", "error", "absent"])


@query("history_series", "stored_messages", sql="""SELECT msg_id, ts, sensor_type, value FROM stored_messages WHERE project_id = 'p1' AND equipment_id = 'cell_46'
    ORDER BY msg_id DESC LIMIT 100""")
def _(spark, d):
    from gaugeflow.plans.standins import stored_messages

    return D.history_series(stored_messages(spark, d), "p1", "cell_46", 100).select("msg_id", "ts", "sensor_type", "value")
