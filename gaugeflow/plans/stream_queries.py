"""Streams run to their end over the stand-in tables, and what they wrote.

Files are read in arrival order with a limit per batch, results go to the
shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import edges, layout, messages, readings, table, thresholds
from gaugeflow.session import work_folder
from gaugeflow.sources.messages import write_messages
from gaugeflow.streaming import live as V
from gaugeflow.streaming.alerts import emit_alert_events
from gaugeflow.streaming.monitor import monitor

FILES_PER_BATCH = 64


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of readings."""
    schema = table(spark, sf_dir, "events").schema
    # a file stream takes a folder or a pattern, so a table that is one file is given as a pattern
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{sf_dir}/events.parque[t]")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("cell_"), user).alias("cell_id"),
        F.concat(F.lit("cell_"), user).alias("equipment_id"),
        kind.alias("subtopic"),
        kind.alias("sensor_type"),
        F.concat(F.lit("cell/"), user, F.lit("/"), kind).alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("msg_id"),
        "value",
        F.col("value").alias("reading"),
    )


def finished(query_handle) -> None:
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise query_handle.exception()


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """What an append-mode stream wrote to files."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    finished(q)
    return stream.sparkSession.read.parquet(f"{folder}/out")


def completed(stream: DataFrame, folder: str) -> DataFrame:
    """The last result of a complete-mode stream; every batch replaces the one before."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out")

    q = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    finished(q)
    return stream.sparkSession.read.parquet(f"{folder}/out")


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("alert_stream", "episodes", sql="""SELECT 'opened' AS event, alert_id, topic, opened_at, opened_value, threshold_value, severity, message, NULL::TIMESTAMP AS resolved_at FROM episodes
    UNION ALL SELECT 'resolved', alert_id, topic, opened_at, opened_value, threshold_value, severity, message, resolved_at FROM episodes WHERE resolved""")
def _(spark, d):
    folder = work_folder(spark, "alerts")
    finished(emit_alert_events(streamed(spark, d), thresholds(spark, d), f"{folder}/out", f"{folder}/cp"))
    events = ntz(spark.read.parquet(f"{folder}/out"), "opened_at", "resolved_at")
    return events.select("event", "alert_id", "topic", "opened_at", "opened_value", "threshold_value", "severity", "message", "resolved_at")


@query("latest_stream", "readings", sql="SELECT equipment_id, sensor_type, max(ts) AS ts, max(msg_id) AS msg_id, arg_max(value, msg_id) AS value FROM readings GROUP BY ALL")
def _(spark, d):
    s = streamed(spark, d).select("equipment_id", "sensor_type", "ts", "msg_id", "value")
    return ntz(completed(V.latest_stream(s), work_folder(spark, "latest")), "ts")


@query("registry_stream", "readings", sql="SELECT equipment_id, sensor_type, topic, max(ts) AS last_seen, count(*) AS message_count FROM readings GROUP BY ALL")
def _(spark, d):
    s = streamed(spark, d).withColumnRenamed("ts", "ingest_ts").withColumn("payload", F.col("value").cast("string"))
    rows = completed(V.registry_stream(s), work_folder(spark, "registry"))
    return ntz(rows, "last_seen").select("equipment_id", "sensor_type", "topic", "last_seen", "message_count")


@query("session_stream", "stored_messages", sql="""SELECT project_id, session_id, count(*) AS total_messages, count(DISTINCT equipment_id) AS equipment, count(DISTINCT sensor_type) AS sensors
    FROM stored_messages GROUP BY ALL""")
def _(spark, d):
    s = streamed(spark, d).withColumn("session_id", F.concat_ws("_", "project_id", F.date_format("ts", "yyyy-MM-dd")))
    rows = completed(V.session_stream(s), work_folder(spark, "sessions"))
    sizes = {"equipment": F.size("equipment_ids").cast("bigint"), "sensors": F.size("sensor_types").cast("bigint")}
    return rows.withColumns(sizes).drop("equipment_ids", "sensor_types")


@query("trend_stream", "readings", sql="""WITH b AS (SELECT subtopic, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(avg(reading), 6) AS mean_value, count(*) AS data_point_count FROM readings GROUP BY ALL)
    SELECT * FROM b WHERE bucket + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 2 HOUR""")
def _(spark, d):
    rows = appended(V.trend_stream(streamed(spark, d), "1 hour", "2 hours", ["subtopic"]), work_folder(spark, "trend"))
    return ntz(rows, "bucket").select("subtopic", "bucket", F.round("mean_value", 6).alias("mean_value"), "data_point_count")


@query("deduplicated_stream", sql="SELECT event_id AS msg_id, ts, value FROM events")
def _(spark, d):
    twice = streamed(spark, d).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = appended(V.deduplicated(twice, "1 hour"), work_folder(spark, "dedup"))
    return ntz(rows, "ts").select("msg_id", "ts", "value")


@query("graph_updates", "readings", "layout", "edges", sql="""SELECT 'node' AS part, id, count(r.equipment_id) > 0 AS active FROM layout l LEFT JOIN readings r ON r.equipment_id = l.equipment_id GROUP BY id
    UNION ALL SELECT 'edge', id, false FROM edges""")
def _(spark, d):
    folder = work_folder(spark, "graph")
    s = streamed(spark, d).select("equipment_id", "sensor_type", "ts", "msg_id", "value", F.lit("u").alias("unit"), F.lit("active").alias("status"))

    def push(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out")

    finished(V.emit_graph_updates(s, layout(spark, d), edges(spark, d), push, f"{folder}/cp", available_now=True))
    return spark.read.parquet(f"{folder}/out").select("part", "id", F.col("body").contains('"node_status":"active"').alias("active"))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The messages as JSON lines in a landing folder."""
    folder = work_folder(spark, "landing")
    m = messages(spark, sf_dir).withColumn("session_id", F.concat_ws("_", "project_id", F.date_format("ingest_ts", "yyyy-MM-dd")))
    m.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp")).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    return folder


@query("read_messages", "messages", sql="SELECT msg_id, project_id, topic, payload, ingest_ts FROM messages")
def _(spark, d):
    from gaugeflow.sources.messages import read_messages, split_undecodable

    good, _ = split_undecodable(read_messages(spark, landed(spark, d)))
    return ntz(good, "ingest_ts").select("msg_id", "project_id", "topic", "payload", "ingest_ts")


@query("write_messages", "stored_messages", sql="SELECT project_id, session_id, msg_id, ts, value FROM stored_messages")
def _(spark, d):
    from gaugeflow.plans.standins import stored_messages

    folder = work_folder(spark, "messages")
    write_messages(stored_messages(spark, d), folder)
    return spark.read.parquet(folder).select("project_id", F.col("session_id").cast("string"), "msg_id", "ts", "value")


@query("monitor", "messages", "episodes", sql="""SELECT 'stored' AS what, count(*) AS n FROM messages UNION ALL SELECT 'opened', count(*) FROM episodes
    UNION ALL SELECT 'resolved', count(*) FROM episodes WHERE resolved UNION ALL SELECT 'graph', (SELECT count(*) FROM supplier) * 2""")
def _(spark, d):
    folder = work_folder(spark, "monitor")

    def push(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/graph")

    # no limit below the file count of the landing folder: the order inside a batch is by time, between batches by arrival
    queries = monitor(spark, landed(spark, d), thresholds(spark, d), layout(spark, d), edges(spark, d), folder, f"{folder}/cp", push, available_now=True)
    for q in queries.values():
        finished(q)
    count = F.count(F.lit(1)).alias("n")
    stored = spark.read.parquet(f"{folder}/messages").agg(count).select(F.lit("stored").alias("what"), "n")
    alerts = spark.read.parquet(f"{folder}/alerts").groupBy(F.col("event").alias("what")).agg(count)
    graph = spark.read.parquet(f"{folder}/graph").agg(count).select(F.lit("graph").alias("what"), "n")
    return stored.unionByName(alerts).unionByName(graph)


@query("export_import_project", "stored_messages", sql="SELECT project_id, msg_id, value FROM stored_messages WHERE project_id <> 'p0' UNION ALL SELECT project_id, msg_id, value FROM stored_messages WHERE project_id = 'p0'")
def _(spark, d):
    from gaugeflow.operators.storage import session_stats
    from gaugeflow.plans.standins import stored_messages
    from gaugeflow.sources import bundles as B

    folder = work_folder(spark, "bundle")
    table_path, session_path = f"{folder}/messages", f"{folder}/sessions"
    stored = stored_messages(spark, d)
    sessions = session_stats(stored).select("project_id", "session_id", "total_messages")
    write_messages(stored, table_path)
    sessions.write.partitionBy("project_id").parquet(session_path)
    B.export_project(spark.read.parquet(table_path), spark.read.parquet(session_path), "p0", f"{folder}/export")
    schema = spark.read.parquet(table_path).schema
    B.import_project(spark, f"{folder}/export", table_path, session_path, schema, spark.read.parquet(session_path).schema)
    return spark.read.parquet(table_path).select("project_id", "msg_id", "value")


@query("import_session", "stored_messages", sql="""SELECT session_id, count(*) AS n, min(msg_id) AS first_id, max(msg_id) AS last_id FROM (SELECT session_id, msg_id FROM stored_messages
    UNION ALL SELECT 'imported_1', msg_id + (SELECT max(msg_id) FROM stored_messages) + 1 - (SELECT min(msg_id) FROM stored_messages WHERE session_id = 'p0_2024-01-05')
    FROM stored_messages WHERE session_id = 'p0_2024-01-05') GROUP BY session_id""")
def _(spark, d):
    from gaugeflow.operators.storage import session_stats
    from gaugeflow.plans.standins import stored_messages
    from gaugeflow.sources import bundles as B

    m = stored_messages(spark, d)
    s = session_stats(m)
    merged, _ = B.import_session(m, s, *B.export_session(m, s, "p0_2024-01-05"), "imported_1")
    return merged.groupBy("session_id").agg(F.count("*").alias("n"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"))


@query("storage_stats", "stored_messages", sql="SELECT project_id, count(*) AS message_count, count(DISTINCT session_id) AS session_count, true AS has_size FROM stored_messages GROUP BY ALL")
def _(spark, d):
    from gaugeflow.operators.storage import session_stats, storage_stats
    from gaugeflow.plans.standins import stored_messages

    folder = work_folder(spark, "stats")
    write_messages(stored_messages(spark, d), f"{folder}/messages")
    session_stats(stored_messages(spark, d)).select("project_id", "session_id").write.partitionBy("project_id").parquet(f"{folder}/sessions")
    stats = storage_stats(spark.read.parquet(f"{folder}/messages"), spark.read.parquet(f"{folder}/sessions"))
    return stats.select("project_id", "message_count", "session_count", (F.col("size_kb") > 0).alias("has_size"))


@query("read_thresholds_csv", sql="""SELECT 'cell/' || user_id || '/' || event_type AS topic_name, event_type AS sensor_type, min(value) AS min_value,
    CASE WHEN event_type <> 'view' THEN max(value) END AS max_value, true AS enabled FROM events GROUP BY user_id, event_type""")
def _(spark, d):
    from gaugeflow.sources.thresholds import read_thresholds_csv

    folder = work_folder(spark, "thresholds")
    bounds = readings(spark, d).groupBy("topic", "sensor_type").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    rows = bounds.select(F.col("topic").alias("topic_name"), "min_value", F.when(F.col("sensor_type") != "view", F.col("max_value")).alias("max_value"))
    rows.write.option("header", True).csv(folder)
    return read_thresholds_csv(spark, folder, "p").select("topic_name", "sensor_type", "min_value", "max_value", "enabled")


@query("project_summaries", "layout", sql="""SELECT n_name AS name, count(s_suppkey) AS node_count, CASE WHEN count(s_suppkey) > 0 THEN 'supplier' ELSE '' END AS equipment_types,
    false AS is_favorite, 'broker-' || n_nationkey AS broker_host FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def _(spark, d):
    from gaugeflow.operators.registry import project_summaries
    from gaugeflow.sources.projects import read_projects

    folder = work_folder(spark, "projects")
    node = F.struct(F.concat(F.lit("node_"), F.col("s_suppkey").cast("string")).alias("id"))
    found = F.struct(F.concat(F.lit("node_"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("equipment_type"))
    known = F.col("s_suppkey").isNotNull()
    docs = (
        table(spark, d, "nation")
        .join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .groupBy("n_nationkey", "n_name")
        .agg(F.collect_list(F.when(known, node)).alias("nodes"), F.collect_list(F.when(known, found)).alias("discovered_nodes"))
        .select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
            F.struct(F.concat(F.lit("broker-"), F.col("n_nationkey").cast("string")).alias("broker_host")).alias("mqtt_config"),
            F.struct("nodes").alias("graph_layout"), "discovered_nodes",
        )
    )
    # one document per file, as the project store keeps them
    docs.write.option("maxRecordsPerFile", 1).json(folder)
    s = project_summaries(read_projects(spark, folder))
    return s.select("name", F.col("node_count").cast("bigint").alias("node_count"), F.array_join("equipment_types", ",").alias("equipment_types"), "is_favorite", "broker_host")


@query("run_sql", "readings", sql="""SELECT '{"cell_id":"' || cell_id || '","n":' || count(*) || '}' AS "row" FROM readings GROUP BY cell_id""")
def _(spark, d):
    from gaugeflow.sources.sql import run_sql

    return run_sql(spark, "SELECT cell_id, count(*) AS n FROM gaugeflow_readings GROUP BY cell_id", {"gaugeflow_readings": readings(spark, d)}).rows


@query("read_documents", sql="SELECT md5(text || chr(10)) AS digest, count(*) AS n FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY ALL")
def _(spark, d):
    from gaugeflow.sources.documents import read_documents, write_documents

    folder = work_folder(spark, "documents")
    # one file per document, as uploads arrive
    write_documents(table(spark, d, "documents").select("text"), folder)
    return read_documents(spark, folder).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))
