"""Recording, project and chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import chats as C
from gaugeflow.operators import storage as T
from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import stored_messages, table


def sessions(spark, d):
    """One start and one stop event per session; the newest session of a project stays open."""
    return T.session_table(session_events(spark, d))


def session_events(spark, d):
    bounds = stored_messages(spark, d).groupBy("project_id", "session_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    event = F.inline(
        F.array(
            F.struct(F.lit("start").alias("event"), F.col("a").alias("ts")),
            F.struct(F.when(~F.col("session_id").endswith("30"), F.lit("stop")).alias("event"), F.col("b").alias("ts")),
        )
    )
    return bounds.select("project_id", "session_id", F.concat(F.lit("Project "), "project_id").alias("project_name"), event).filter("event is not null")


SQL_SESSIONS = """sessions AS (SELECT project_id, session_id, 'Project ' || project_id AS project_name, min(ts) AS start_time,
    CASE WHEN NOT ends_with(session_id, '30') THEN max(ts) END AS end_time FROM stored_messages GROUP BY project_id, session_id)"""


@query("project_messages", "stored_messages", sql="SELECT msg_id, ts, equipment_id, value FROM stored_messages WHERE project_id = 'p1' ORDER BY ts DESC, msg_id DESC LIMIT 500")
def _(spark, d):
    return T.project_messages(stored_messages(spark, d), "p1", 500).select("msg_id", "ts", "equipment_id", "value")


@query("equipment_messages", "stored_messages", sql="""SELECT msg_id, ts, sensor_type, value FROM stored_messages WHERE project_id = 'p2' AND equipment_id = 'cell_8'
    ORDER BY ts DESC, msg_id DESC LIMIT 20""")
def _(spark, d):
    return T.equipment_messages(stored_messages(spark, d), "p2", "cell_8", 20).select("msg_id", "ts", "sensor_type", "value")


@query("delete_project", "stored_messages", sql="SELECT project_id, session_id, msg_id FROM stored_messages WHERE project_id <> 'p1'")
def _(spark, d):
    return T.without_project(stored_messages(spark, d), "p1").select("project_id", "session_id", "msg_id")


@query("session_table", "stored_messages", sql=f"WITH {SQL_SESSIONS} SELECT * FROM sessions")
def _(spark, d):
    return sessions(spark, d)


@query("session_stats", "stored_messages", sql="""SELECT project_id, session_id, count(*) AS total_messages,
    string_agg(DISTINCT equipment_id, ',' ORDER BY equipment_id) AS equipment_ids, string_agg(DISTINCT sensor_type, ',' ORDER BY sensor_type) AS sensor_types
    FROM stored_messages GROUP BY ALL""")
def _(spark, d):
    stats = T.session_stats(stored_messages(spark, d))
    return stats.withColumns({c: F.array_join(c, ",") for c in ("equipment_ids", "sensor_types")})


@query("retain_last", "stored_messages", sql="""SELECT project_id, msg_id, ts, value FROM stored_messages
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, msg_id DESC) <= 1500""")
def _(spark, d):
    return T.retain_last(stored_messages(spark, d), 1500).select("project_id", "msg_id", "ts", "value")


@query("retain_last_overall", "stored_messages", sql="SELECT msg_id, ts FROM stored_messages ORDER BY ts DESC, msg_id DESC LIMIT 5000")
def _(spark, d):
    return T.retain_last(stored_messages(spark, d), 5000, by=None).select("msg_id", "ts")


@query("projects_with_data", "stored_messages", sql="SELECT DISTINCT project_id FROM stored_messages")
def _(spark, d):
    return T.projects_with_data(stored_messages(spark, d), sessions(spark, d))


@query("project_sessions", "stored_messages", sql=f"WITH {SQL_SESSIONS} SELECT * FROM sessions WHERE project_id = 'p2'")
def _(spark, d):
    return T.project_sessions(sessions(spark, d), "p2")


@query("project_counts", "stored_messages", sql="""SELECT project_id, count(*) AS message_count, count(DISTINCT session_id) AS session_count FROM stored_messages GROUP BY ALL""")
def _(spark, d):
    return T.project_counts(stored_messages(spark, d), sessions(spark, d))


@query("storage_usage", "stored_messages", sql="SELECT count(*) AS total_messages, CAST(round(count(*) / 10000 * 100) AS BIGINT) AS usage_percentage FROM stored_messages")
def _(spark, d):
    return T.usage(stored_messages(spark, d))


@query("delete_session", "stored_messages", sql="SELECT session_id, count(*) AS n FROM stored_messages WHERE session_id <> 'p1_2024-01-05' GROUP BY ALL")
def _(spark, d):
    kept, _ = T.delete_session(stored_messages(spark, d), sessions(spark, d), "p1_2024-01-05")
    return kept.groupBy("session_id").agg(F.count("*").alias("n"))


@query("extract_references", sql="""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
    r AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '@([a-zA-Z0-9_\\s]+)', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM t)
    SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS "references" FROM r WHERE len(l) > 0""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    chats = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text"
    )
    return C.message_references(docs.unionByName(chats)).select("id", F.array_join("references", "|").alias("references"))


@query("chat_sessions", sql="""SELECT conv_id, count(*) - 1 AS messages, max(conv_id) AS last_updated FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 10""")
def _(spark, d):
    return C.chat_sessions(table(spark, d, "conversations"))
