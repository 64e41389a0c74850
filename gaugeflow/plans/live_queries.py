"""Discovery, live state and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.topics import equipment_type
from gaugeflow.operators import alerts as A
from gaugeflow.operators import live as L
from gaugeflow.operators import registry as G
from gaugeflow.operators.analysis import analyze_messages
from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import edges, layout, messages, readings, stored_messages, table, thresholds


def registry(spark, d):
    return G.sensor_registry(analyze_messages(messages(spark, d)))


def nodes(spark, d):
    return G.discovered_nodes(registry(spark, d))


SQL_NODES = """nodes AS (SELECT 'node_cell_' || user_id AS id, 'cell_' || user_id AS equipment_id, 'cell' AS equipment_type,
    list(DISTINCT 'cell/' || user_id || '/' || event_type ORDER BY 'cell/' || user_id || '/' || event_type) AS topics,
    count(DISTINCT event_type) AS sensor_count, count(*) AS message_count FROM events GROUP BY user_id)"""


@query("sensor_registry", "messages", sql="""SELECT 'cell_' || user_id AS equipment_id, event_type AS sensor_type, 'cell/' || user_id || '/' || event_type AS topic,
    max(ts) AS last_seen, count(*) AS message_count, arg_max(payload, msg_id) AS sample_data FROM events JOIN messages ON msg_id = event_id GROUP BY ALL""")
def _(spark, d):
    return registry(spark, d).drop("first_key")


@query("discovered_nodes", sql="WITH " + SQL_NODES + """, l AS (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY ALL)
    SELECT n.id, n.equipment_id, n.equipment_type, array_to_string(n.topics, ',') AS topics, n.sensor_count, n.message_count, min(l.t) AS first_seen, max(l.t) AS last_seen
    FROM nodes n JOIN l ON n.equipment_id = 'cell_' || l.user_id GROUP BY ALL""")
def _(spark, d):
    return nodes(spark, d).withColumn("topics", F.array_join("topics", ",")).drop("sample_data")


@query("node_sample", "messages", sql="""WITH f AS (SELECT topic, arg_min(project_id, msg_id) AS p, min(msg_id) AS first_id, arg_max(payload, msg_id) AS sample FROM messages GROUP BY topic)
    SELECT 'cell_' || string_split(topic, '/')[2] AS equipment_id, arg_min(sample, first_id) AS sample_data FROM f GROUP BY 1""")
def _(spark, d):
    return nodes(spark, d).select("equipment_id", "sample_data")


@query("equipment_type", "learned", sql="""SELECT DISTINCT equipment_id, topic, lower(CASE WHEN contains(equipment_id, '_') THEN string_split(equipment_id, '_')[1]
    ELSE parts[1] END) AS equipment_type FROM learned""")
def _(spark, d):
    from gaugeflow.plans.standins import mixed_messages

    rows = analyze_messages(mixed_messages(spark, d)).select("equipment_id", "topic").distinct()
    return rows.withColumn("equipment_type", equipment_type("equipment_id", "topic"))


@query("equipment_options", sql="SELECT DISTINCT 'cell_' || user_id AS equipment_id FROM events")
def _(spark, d):
    return G.equipment_options(nodes(spark, d))


@query("sensor_options", sql="SELECT DISTINCT 'cell_' || user_id AS equipment_id, event_type AS sensor FROM events")
def _(spark, d):
    return G.sensor_options(nodes(spark, d))


@query("available_nodes", "layout", sql="WITH " + SQL_NODES + """ SELECT id, equipment_id, equipment_type, message_count FROM nodes
    UNION ALL SELECT equipment_id, equipment_id, 'unknown', 0 FROM layout WHERE equipment_id NOT IN (SELECT equipment_id FROM nodes)""")
def _(spark, d):
    found = G.available_nodes(nodes(spark, d), layout(spark, d), F.lit("2024-02-01").cast("timestamp_ntz"))
    return found.select("id", "equipment_id", "equipment_type", "message_count")


@query("prune_inactive", "layout", sql="SELECT id, equipment_id, label FROM layout WHERE equipment_id IN (SELECT 'cell_' || user_id FROM events)")
def _(spark, d):
    return G.prune_inactive(layout(spark, d), nodes(spark, d)).select("id", "equipment_id", "label")


@query("valid_nodes", "layout", sql="SELECT id, equipment_id FROM (SELECT CASE WHEN label LIKE '%5' THEN '' WHEN label LIKE '%7' THEN NULL ELSE id END AS id, equipment_id FROM layout) WHERE id <> ''")
def _(spark, d):
    broken = F.when(F.col("label").endswith("5"), F.lit("")).when(~F.col("label").endswith("7"), F.col("id"))
    return L.valid_nodes(layout(spark, d).withColumn("id", broken)).select("id", "equipment_id")


@query("valid_edges", "edges", sql="SELECT id, source, target FROM edges WHERE target <> ''")
def _(spark, d):
    return L.valid_edges(edges(spark, d))


@query("latest_readings", "readings", sql="""SELECT equipment_id, sensor_type, max(ts) AS ts, max(msg_id) AS msg_id, arg_max(value, msg_id) AS value
    FROM readings GROUP BY ALL""")
def _(spark, d):
    r = readings(spark, d).select("equipment_id", "sensor_type", "ts", "msg_id", "value")
    return L.latest_readings(r)


def status(spark, d):
    newest = L.latest_readings(stored_messages(spark, d).select("equipment_id", "sensor_type", "ts", "msg_id", "value", "unit", "status"))
    return L.node_status(newest, layout(spark, d))


SQL_STATUS = """latest AS (SELECT equipment_id, sensor_type, max(ts) AS ts, arg_max(value, msg_id) AS value FROM readings GROUP BY ALL),
    states AS (SELECT l.id, l.equipment_id, string_agg(sensor_type || '=' || CAST(value AS VARCHAR), ';' ORDER BY sensor_type) AS sensors,
      CASE WHEN count(r.equipment_id) > 0 THEN 'active' ELSE 'idle' END AS node_status, max(r.ts) AS last_updated
      FROM layout l LEFT JOIN latest r ON r.equipment_id = l.equipment_id GROUP BY ALL)"""


@query("node_status", "readings", "layout", sql="WITH " + SQL_STATUS + " SELECT id, equipment_id, coalesce(sensors, '') AS sensors, node_status, last_updated FROM states")
def _(spark, d):
    printed = F.array_join(F.transform("sensors", lambda s: F.concat_ws("=", s["sensor_type"], s["value"].cast("string"))), ";")
    return status(spark, d).select("id", "equipment_id", printed.alias("sensors"), "node_status", "last_updated")


@query("graph_snapshot", "layout", "edges", sql="""SELECT 'node' AS part, id FROM layout UNION ALL SELECT 'edge', id FROM edges WHERE target <> ''""")
def _(spark, d):
    return L.graph_snapshot(status(spark, d), L.valid_edges(edges(spark, d))).filter(F.length("body") > 2).select("part", "id")


@query("snapshot_summary", "readings", "layout", "edges", sql="WITH " + SQL_STATUS + """ SELECT count(*) AS nodes, (SELECT count(*) FROM edges WHERE target <> '') AS edges,
    max(last_updated) AS last_updated, count(*) > 0 AS first_message FROM states""")
def _(spark, d):
    return L.snapshot_summary(status(spark, d), L.valid_edges(edges(spark, d)))


@query("throttle", "readings", sql="""WITH RECURSIVE passed AS (
      SELECT project_id, min(ts) AS ts FROM readings GROUP BY project_id
      UNION ALL
      SELECT project_id, nxt FROM (SELECT p.project_id, (SELECT min(r.ts) FROM readings r WHERE r.project_id = p.project_id AND r.ts >= p.ts + INTERVAL 90 MINUTE) AS nxt
        FROM passed p) WHERE nxt IS NOT NULL)
    SELECT p.project_id, p.ts, r.msg_id FROM passed p JOIN readings r ON r.project_id = p.project_id AND r.ts = p.ts""")
def _(spark, d):
    return L.throttle(readings(spark, d), 5400, "project_id", slice_seconds=86400)


# --- alerts ----------------------------------------------------------------


def episodes(spark, d):
    return A.alert_episodes(readings(spark, d), thresholds(spark, d))


@query("index_thresholds", "indexed", sql="SELECT project_id, topic_name, ord, sensor_type, min_value, max_value, enabled FROM indexed")
def _(spark, d):
    return A.index_thresholds(thresholds(spark, d)).drop("id")


@query("match_threshold", "evaluated", sql="SELECT msg_id, min_value, max_value FROM evaluated")
def _(spark, d):
    return A.match_threshold(readings(spark, d), thresholds(spark, d)).select("msg_id", "min_value", "max_value")


@query("evaluate_breach", "evaluated", sql="""SELECT msg_id, kind, CASE WHEN kind = 'min' THEN min_value WHEN kind = 'max' THEN max_value END AS threshold_value FROM evaluated""")
def _(spark, d):
    return A.evaluate_readings(readings(spark, d), thresholds(spark, d)).select("msg_id", "kind", "threshold_value")


@query("severity", "evaluated", sql="""SELECT msg_id, CASE WHEN abs(value - t) > t * 0.2::DOUBLE THEN 'critical' ELSE 'warning' END AS severity
    FROM (SELECT *, CASE WHEN kind = 'min' THEN min_value ELSE max_value END AS t FROM evaluated WHERE kind IS NOT NULL)""")
def _(spark, d):
    rows = A.evaluate_readings(readings(spark, d), thresholds(spark, d)).filter("kind is not null")
    return rows.select("msg_id", A.severity("value", "threshold_value").alias("severity"))


@query("alert_message", "evaluated", sql="""SELECT msg_id, upper(sensor_type[1]) || sensor_type[2:] || ' is ' || CASE WHEN kind = 'max' THEN 'above' ELSE 'below' END || ' threshold: '
    || printf('%.2f', value) || ' (threshold: ' || printf('%.2f', CASE WHEN kind = 'min' THEN min_value ELSE max_value END) || ')' AS message
    FROM evaluated WHERE kind IS NOT NULL""")
def _(spark, d):
    rows = A.evaluate_readings(readings(spark, d), thresholds(spark, d)).filter("kind is not null")
    return rows.select("msg_id", A.alert_message("sensor_type", "value", "threshold_value", "kind").alias("message"))


@query("alert_episodes", "episodes", sql="SELECT * FROM episodes")
def _(spark, d):
    return episodes(spark, d)


@query("active_alerts", "episodes", sql='SELECT alert_id, topic, "timestamp", current_value, severity FROM episodes WHERE NOT resolved')
def _(spark, d):
    return A.active_alerts(episodes(spark, d)).select("alert_id", "topic", "timestamp", "current_value", "severity")


@query("active_alerts_of_equipment", "episodes", sql="""SELECT alert_id, topic, "timestamp", current_value FROM episodes WHERE NOT resolved AND equipment_id = 'cell_8'""")
def _(spark, d):
    return A.active_alerts(episodes(spark, d), "cell_8").select("alert_id", "topic", "timestamp", "current_value")


HISTORY_ORDER = "ORDER BY resolved_at DESC, resolved_msg_id DESC, alert_id DESC, topic DESC"


@query("alert_history", "episodes", sql=f"""SELECT alert_id, resolved_at, opened_value FROM (SELECT * FROM episodes WHERE resolved {HISTORY_ORDER} LIMIT 200)
    WHERE equipment_id = 'cell_46'""")
def _(spark, d):
    return A.alert_history(episodes(spark, d), 200, "cell_46").select("alert_id", "resolved_at", "opened_value")


@query("cap_history", "episodes", sql=f"SELECT alert_id, resolved_at FROM episodes WHERE resolved {HISTORY_ORDER} LIMIT 1000")
def _(spark, d):
    return A.cap_history(episodes(spark, d)).select("alert_id", "resolved_at")


@query("clear_resolved", "episodes", sql="""SELECT alert_id, resolved_at FROM episodes WHERE resolved
    AND resolved_at > (SELECT max(resolved_at) FROM episodes) - INTERVAL 24 HOUR""")
def _(spark, d):
    return A.clear_resolved(episodes(spark, d), 24).select("alert_id", "resolved_at")


@query("alert_stats", "episodes", sql="""SELECT count(*) FILTER (NOT resolved) AS active_alerts, count(*) FILTER (resolved) AS historical_alerts,
    count(*) FILTER (NOT resolved AND severity = 'warning') AS warning, count(*) FILTER (NOT resolved AND severity = 'critical') AS critical,
    first(alert_id ORDER BY "timestamp" DESC, alert_id DESC) FILTER (NOT resolved) AS most_recent_alert FROM episodes""")
def _(spark, d):
    return A.alert_stats(episodes(spark, d))


def change_log(spark, d):
    """A change log over one threshold per user, from the events."""
    kind, v = F.col("event_type"), F.col("value")
    op = F.when(kind.isin("click", "signup", "purchase"), F.lit("update")).when((kind == "error") & (v > 150), F.lit("delete")).otherwise(F.lit("toggle"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"), op.alias("op"), F.lit("p0").alias("project_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("topic_name"),
        F.when(kind == "click", v - 10).alias("min_value"),
        F.when(kind == "click", v + 10).when(kind == "purchase", v).alias("max_value"),
        F.when(kind == "purchase", v < 50).alias("enabled"),
    )


def base_thresholds(spark, d):
    return table(spark, d, "events").select(F.col("user_id")).distinct().select(
        F.lit("p0").alias("project_id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.col("user_id").alias("ord"),
        F.concat(F.lit("cell/"), F.col("user_id").cast("string"), F.lit("/click")).alias("topic_name"), F.lit("click").alias("sensor_type"),
        F.lit(1.0).alias("min_value"), F.lit(None).cast("double").alias("max_value"), F.lit(True).alias("enabled"),
    )


SQL_LOG = """log AS (SELECT event_id AS ord, 't' || user_id AS id, CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'update'
      WHEN event_type = 'error' AND value > 150 THEN 'delete' ELSE 'toggle' END AS op, CASE WHEN event_type = 'click' THEN value - 10 END AS lo,
      CASE WHEN event_type = 'click' THEN value + 10 WHEN event_type = 'purchase' THEN value END AS hi, CASE WHEN event_type = 'purchase' THEN value < 50 END AS en FROM events),
    died AS (SELECT id, min(ord) AS at FROM log WHERE op = 'delete' GROUP BY id),
    checked AS (SELECT log.*, CASE WHEN log.ord > died.at THEN 'threshold not found' WHEN op = 'update' AND lo IS NULL AND hi IS NULL THEN 'a bound is required' ELSE 'ok' END AS outcome
      FROM log LEFT JOIN died ON died.id = log.id)"""


@query("apply_threshold_changes", sql="WITH " + SQL_LOG + """, a AS (SELECT * FROM checked WHERE outcome = 'ok'),
    ids AS (SELECT DISTINCT id FROM log WHERE id NOT IN (SELECT id FROM died)),
    u AS (SELECT id, last(lo ORDER BY ord) AS lo, last(hi ORDER BY ord) AS hi FROM a WHERE op = 'update' GROUP BY id),
    s AS (SELECT id, max(ord) AS at, last(en ORDER BY ord) AS en FROM a WHERE op = 'update' AND en IS NOT NULL GROUP BY id),
    g AS (SELECT a.id, count(*) AS n FROM a LEFT JOIN s ON s.id = a.id WHERE op = 'toggle' AND a.ord > coalesce(s.at, -1) GROUP BY a.id)
    SELECT ids.id, CASE WHEN u.id IS NULL THEN 1.0 ELSE lo END AS min_value, hi AS max_value,
      CASE WHEN coalesce(g.n, 0) % 2 = 1 THEN NOT coalesce(s.en, true) ELSE coalesce(s.en, true) END AS enabled
    FROM ids LEFT JOIN u ON u.id = ids.id LEFT JOIN s ON s.id = ids.id LEFT JOIN g ON g.id = ids.id""")
def _(spark, d):
    return A.apply_threshold_changes(base_thresholds(spark, d), change_log(spark, d))[0].select("id", "min_value", "max_value", "enabled")


@query("threshold_change_outcomes", sql="WITH " + SQL_LOG + " SELECT ord, id, op, outcome FROM checked")
def _(spark, d):
    return A.apply_threshold_changes(base_thresholds(spark, d), change_log(spark, d))[1].select("ord", "id", "op", "outcome")
