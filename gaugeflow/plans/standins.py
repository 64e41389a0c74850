"""The library's tables derived from the shared test tables, for Spark and as SQL text.

``events`` stands in for sensor readings, ``supplier`` for the equipment
layout, ``embeddings`` with ``documents`` for indexed chunks. The SQL in
``SQL_VIEWS`` defines the same tables for the comparison database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("cell_"), user).alias("cell_id"),
        F.concat(F.lit("cell_"), user).alias("equipment_id"),
        kind.alias("subtopic"),
        kind.alias("sensor_type"),
        F.concat(kind, F.lit("_value")).alias("field_name"),
        F.expr("CASE event_type WHEN 'click' THEN 'mM' WHEN 'view' THEN 'mbar' WHEN 'error' THEN 'AU' ELSE 'pct' END").alias("unit"),
        F.col("value").alias("reading"),
        F.col("value"),
        "ts",
        F.col("event_id").alias("msg_id"),
        F.concat(F.lit("cell/"), user, F.lit("/"), kind).alias("topic"),
    )


def readings_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors at one timestamp: the event value and the ``k`` of its properties."""
    events = table(spark, sf_dir, "events")
    pair = F.array(
        F.struct(F.col("event_type").alias("subtopic"), F.col("value").alias("reading")),
        F.struct(F.lit("k").alias("subtopic"), F.get_json_object("props", "$.k").cast("double").alias("reading")),
    )
    return events.select(
        F.concat(F.lit("cell_"), F.col("user_id").cast("string")).alias("cell_id"), "ts", F.col("event_id").alias("msg_id"), F.inline(pair)
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages in the cell layout."""
    payload = F.concat(
        F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","value":'), F.col("value").cast("string"),
        F.lit(',"unit":"mM","sensor_type":"'), F.col("event_type"),
        F.lit('","cell_id":'), F.col("user_id").cast("string"),
        F.lit(',"field":"'), F.col("event_type"), F.lit('_mM","min_val":0,"max_val":500}'),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("cell/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("topic"),
        payload.alias("payload"),
        F.col("ts").alias("ingest_ts"),
    )


def mixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of five families, one per event type, with topics of every depth."""
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.col("event_type")

    def text(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    topic = (
        F.when(kind == "click", text("cell/", u, "/click"))
        .when(kind == "view", text("smr/core/loop", u, "/view"))
        .when(kind == "error", text("pump", u))
        .when(kind == "signup", text("building-controllers/room-temperature-", u))
        .otherwise(text("vehicle-telemetry-stream/position-of-truck-", u))
    )
    payload = (
        F.when(
            kind == "click",
            text('{"timestamp":"', stamp, '","value":', v, ',"unit":"mM","sensor_type":"metabolic","cell_id":', u,
                 ',"field":"click_mM","min_val":0,"max_val":500}'),
        )
        .when(
            kind == "view",
            text('{"timestamp":"', stamp, '","value":"', v, '","unit":"A","status":"normal","description":"heater current of the loop",'
                 '"raw_value":', v, ',"target_value":', k, "}"),
        )
        .when(kind == "error", text('{"device_id":"', u, '","reading":', v, ',"error_count":', k, "}"))
        .when(
            kind == "signup",
            text('{"machine_name":"machine_', u, '","operational_status":"running","production_rate":"', v,
                 '","maintenance_due":"True","field":"rate_pct"}'),
        )
        .otherwise(
            text('{"vehicle":{"plate":"', u, '","speed":', v, '},"tags":["a","b"],"temperature_high":', v, ',"idle_low":', k,
                 ',"note":null,"moving":true,"offset":-', v, "}")
        )
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), topic.alias("topic"), payload.alias("payload"), F.col("ts").alias("ingest_ts")
    )


# (ord, topic, sensor, min, max, enabled); the second definition of cell/8/click replaces the first.
THRESHOLD_ROWS = [
    (1, "cell/8/click", "click", 5.0, 60.0, True),
    (2, "cell/1/view", "view", None, 80.0, True),
    (3, "cell/2/error", "error", -10.0, 40.0, True),
    (4, "cell/3/signup", "signup", 2.0, None, False),
    (5, "cell/46/purchase", "purchase", 1.0, 100.0, True),
    (6, "cell/8/click", "click", 10.0, 120.0, True),
    (7, "cell/9/signup", "signup", 1.0, 50.0, True),
]
THRESHOLD_COLUMNS = "ord long, topic_name string, sensor_type string, min_value double, max_value double, enabled boolean"


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold rows for every project found in the readings; project p2 is stricter."""
    rows = F.array(*[
        F.struct(
            F.lit(o).cast("bigint").alias("ord"), F.lit(t).alias("topic_name"), F.lit(s).alias("sensor_type"),
            F.lit(lo).cast("double").alias("min_value"), F.lit(hi).cast("double").alias("max_value"), F.lit(e).alias("enabled"),
        )
        for o, t, s, lo, hi, e in THRESHOLD_ROWS
    ])
    strict = (F.col("project_id") == "p2") & (F.col("sensor_type") == "error")
    return (
        readings(spark, sf_dir).select("project_id").distinct()
        .select("project_id", F.inline(rows))
        .withColumn("max_value", F.when(strict, F.lit(-5.0)).otherwise(F.col("max_value")))
        .withColumn("id", F.concat_ws("_", F.replace(F.col("topic_name"), F.lit("/"), F.lit("_")), "ord"))
    )


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded messages with project and session."""
    session = F.concat(F.col("project_id"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd"))
    return readings(spark, sf_dir).select(
        "project_id", session.alias("session_id"), "msg_id", "ts", "equipment_id", "sensor_type", "value", "unit",
        F.when(F.col("value") > 0, F.lit("active")).otherwise(F.lit("idle")).alias("status"), "topic",
    )


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the equipment graph."""
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node_"), key).alias("id"), F.concat(F.lit("cell_"), key).alias("equipment_id"), F.col("s_name").alias("label")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each node to the node of its nation number; some have an empty end."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("edge_"), key).alias("id"),
        F.concat(F.lit("node_"), key).alias("source"),
        F.when(F.col("s_nationkey") == 0, F.lit("")).otherwise(F.concat(F.lit("node_"), nation)).alias("target"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed document chunks with vectors."""
    vec, label = F.col("vec_id"), F.col("label")
    doc = F.floor(vec / 5).cast("bigint").cast("string")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text"))
    return (
        table(spark, sf_dir, "embeddings")
        .join(texts, "vec_id", "left")
        .select(
            F.concat(doc, F.lit("_chunk_"), (vec % 5).cast("string")).alias("chunk_id"),
            doc.alias("doc_id"),
            F.concat(F.lit("p"), (F.floor(vec / 5) % 2).cast("string")).alias("project_id"),
            F.concat(F.lit("manual_"), doc, F.expr("CASE WHEN label % 2 = 0 THEN '.md' ELSE '.PDF' END")).alias("filename"),
            F.lit("general").alias("document_type"),
            (vec % 5).cast("bigint").alias("chunk_index"),
            F.lit(5).cast("bigint").alias("total_chunks"),
            F.when(label > 2, (label % 3).cast("bigint")).alias("page_number"),
            F.when(label < 4, F.concat(F.lit("cell_"), (label % 2).cast("string"))).alias("equipment_id"),
            F.when(label < 2, F.lit("click")).alias("sensor_type"),
            "text",
            "embedding",
        )
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Embedding of the first vector; a search takes its query as plain numbers."""
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


_THRESHOLD_VALUES = ", ".join(
    "({}, '{}', '{}', {}, {}, {})".format(
        o, t, s, "CAST(NULL AS DOUBLE)" if lo is None else f"{lo}::DOUBLE", "CAST(NULL AS DOUBLE)" if hi is None else f"{hi}::DOUBLE", e
    )
    for o, t, s, lo, hi, e in THRESHOLD_ROWS
)

SQL_VIEWS = {
    "readings": """SELECT 'p' || (user_id % 3) AS project_id, 'cell_' || user_id AS cell_id, 'cell_' || user_id AS equipment_id,
        event_type AS subtopic, event_type AS sensor_type, event_type || '_value' AS field_name,
        CASE event_type WHEN 'click' THEN 'mM' WHEN 'view' THEN 'mbar' WHEN 'error' THEN 'AU' ELSE 'pct' END AS unit,
        value AS reading, value, ts, event_id AS msg_id, 'cell/' || user_id || '/' || event_type AS topic FROM events""",
    "readings_pair": """SELECT 'cell_' || user_id AS cell_id, ts, event_id AS msg_id, event_type AS subtopic, value AS reading FROM events
        UNION ALL SELECT 'cell_' || user_id, ts, event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events""",
    "messages": """SELECT event_id AS msg_id, 'p' || (user_id % 3) AS project_id, 'cell/' || user_id || '/' || event_type AS topic,
        '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","value":' || CAST(value AS VARCHAR) || ',"unit":"mM","sensor_type":"'
        || event_type || '","cell_id":' || user_id || ',"field":"' || event_type || '_mM","min_val":0,"max_val":500}' AS payload,
        ts AS ingest_ts FROM events""",
    "mixed_messages": """SELECT event_id AS msg_id, ts AS ingest_ts,
        CASE event_type WHEN 'click' THEN 'cell/' || user_id || '/click' WHEN 'view' THEN 'smr/core/loop' || user_id || '/view'
          WHEN 'error' THEN 'pump' || user_id WHEN 'signup' THEN 'building-controllers/room-temperature-' || user_id
          ELSE 'vehicle-telemetry-stream/position-of-truck-' || user_id END AS topic,
        CASE event_type
          WHEN 'click' THEN '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","value":' || CAST(value AS VARCHAR)
            || ',"unit":"mM","sensor_type":"metabolic","cell_id":' || user_id || ',"field":"click_mM","min_val":0,"max_val":500}'
          WHEN 'view' THEN '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","value":"' || CAST(value AS VARCHAR)
            || '","unit":"A","status":"normal","description":"heater current of the loop","raw_value":' || CAST(value AS VARCHAR)
            || ',"target_value":' || json_extract_string(props, '$.k') || '}'
          WHEN 'error' THEN '{"device_id":"' || user_id || '","reading":' || CAST(value AS VARCHAR) || ',"error_count":'
            || json_extract_string(props, '$.k') || '}'
          WHEN 'signup' THEN '{"machine_name":"machine_' || user_id || '","operational_status":"running","production_rate":"'
            || CAST(value AS VARCHAR) || '","maintenance_due":"True","field":"rate_pct"}'
          ELSE '{"vehicle":{"plate":"' || user_id || '","speed":' || CAST(value AS VARCHAR) || '},"tags":["a","b"],"temperature_high":'
            || CAST(value AS VARCHAR) || ',"idle_low":' || json_extract_string(props, '$.k')
            || ',"note":null,"moving":true,"offset":-' || CAST(value AS VARCHAR) || '}' END AS payload FROM events""",
    "thresholds": f"""SELECT p.project_id, CAST(t.ord AS BIGINT) AS ord, t.topic_name, t.sensor_type, t.min_value,
        CASE WHEN p.project_id = 'p2' AND t.sensor_type = 'error' THEN -5.0::DOUBLE ELSE t.max_value END AS max_value, t.enabled,
        replace(t.topic_name, '/', '_') || '_' || t.ord AS id
        FROM (SELECT DISTINCT project_id FROM readings) p,
        (VALUES {_THRESHOLD_VALUES}) t(ord, topic_name, sensor_type, min_value, max_value, enabled)""",
    "stored_messages": """SELECT project_id, project_id || '_' || strftime(ts, '%Y-%m-%d') AS session_id, msg_id, ts, equipment_id, sensor_type,
        value, unit, CASE WHEN value > 0 THEN 'active' ELSE 'idle' END AS status, topic FROM readings""",
    "layout": "SELECT 'node_' || s_suppkey AS id, 'cell_' || s_suppkey AS equipment_id, s_name AS label FROM supplier",
    "edges": """SELECT 'edge_' || s_suppkey AS id, 'node_' || s_suppkey AS source,
        CASE WHEN s_nationkey = 0 THEN '' ELSE 'node_' || s_nationkey END AS target FROM supplier""",
    "chunks": """SELECT (vec_id // 5) || '_chunk_' || (vec_id % 5) AS chunk_id, CAST(vec_id // 5 AS VARCHAR) AS doc_id,
        'p' || ((vec_id // 5) % 2) AS project_id,
        'manual_' || (vec_id // 5) || CASE WHEN label % 2 = 0 THEN '.md' ELSE '.PDF' END AS filename, 'general' AS document_type,
        vec_id % 5 AS chunk_index, CAST(5 AS BIGINT) AS total_chunks, CASE WHEN label > 2 THEN CAST(label % 3 AS BIGINT) END AS page_number,
        CASE WHEN label < 4 THEN 'cell_' || (label % 2) END AS equipment_id, CASE WHEN label < 2 THEN 'click' END AS sensor_type,
        d.text, embedding FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
}

_NEEDS = {"thresholds": ["readings"], "stored_messages": ["readings"]}


def with_views(sql: str, *names: str) -> str:
    """SQL text with the named stand-in tables in front of it."""
    ordered: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    body = sql.strip()
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[len('WITH '):]}"
    return f"WITH {views} {body}"

# --- derived SQL tables: payload fields and alert episodes -------------------

SQL_VIEWS["fields"] = """SELECT *, CASE
      WHEN category = 'numeric' AND NOT regexp_matches(lower(key), 'id|time|stamp|date|count|index') THEN
        greatest(0.0::DOUBLE, 0.5::DOUBLE
          + CASE WHEN regexp_matches(lower(key), 'value|reading|measurement|level|amount|data|temperature|pressure|humidity|voltage|current|power|speed|flow|rate|count|percent|ratio|index|concentration|density|weight|mass|force|torque|ph|dissolved|viability|impedance|confluence') THEN 0.4::DOUBLE ELSE 0 END
          + CASE WHEN num BETWEEN -10000 AND 100000 THEN 0.2::DOUBLE ELSE 0 END
          + CASE WHEN num BETWEEN 0 AND 1000 THEN 0.1::DOUBLE ELSE 0 END
          - CASE WHEN regexp_matches(lower(key), 'id|time|stamp|date|version|count|index|key|hash') THEN 0.3::DOUBLE ELSE 0 END)
      WHEN category = 'identifier' THEN 0.3::DOUBLE
          + CASE WHEN regexp_matches(lower(key), 'id|device|equipment|node|unit|sensor|machine|name|label|tag|serial|address|handle|ref') THEN 0.5::DOUBLE ELSE 0 END
          + CASE WHEN length(str) <= 30 AND regexp_matches(regexp_replace(str, '[_-]', '', 'g'), '^[A-Za-z0-9]+$') THEN 0.3::DOUBLE ELSE 0 END
          + CASE WHEN regexp_matches(str, '[0-9]') THEN 0.2::DOUBLE ELSE 0 END
      WHEN category = 'description' THEN 0.2::DOUBLE + CASE WHEN regexp_matches(lower(key), 'type|kind|category|class|name') THEN 0.3::DOUBLE ELSE 0 END
      END AS score
    FROM (SELECT *, CASE WHEN num IS NOT NULL THEN 'numeric' WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'array'
        WHEN type = 'NULL' THEN NULL
        WHEN regexp_matches(lower(key), 'id|device|equipment|node|unit|machine')
          OR (length(str) <= 20 AND (regexp_matches(str, '^[A-Za-z0-9]+$') OR contains(str, '_'))) THEN 'identifier'
        WHEN length(str) > 10 AND regexp_matches(str, '[TZ:+-]') THEN 'datetime' ELSE 'description' END AS category
      FROM (SELECT m.msg_id, m.topic, m.ingest_ts, row_number() OVER (PARTITION BY m.msg_id ORDER BY j.id) - 1 AS pos, j.key, j.type,
          CASE WHEN j.type = 'BOOLEAN' THEN CASE WHEN CAST(j.value AS VARCHAR) = 'true' THEN 1.0 ELSE 0.0 END
               WHEN j.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(j.value AS VARCHAR) AS DOUBLE) END AS num,
          CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$' END AS str,
          CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$' WHEN j.type = 'NULL' THEN 'None' ELSE CAST(j.value AS VARCHAR) END AS text
        FROM mixed_messages m, json_each(m.payload) j))"""

SQL_VIEWS["picked"] = """SELECT msg_id, any_value(topic) AS topic, any_value(ingest_ts) AS ingest_ts, string_split(any_value(topic), '/') AS parts,
    count(*) AS n_fields,
    first(str ORDER BY score DESC, pos) FILTER (category = 'identifier') AS best_id,
    first(str ORDER BY score DESC, pos) FILTER (category = 'description') AS best_description,
    first(key ORDER BY score DESC, pos) FILTER (category = 'numeric' AND score IS NOT NULL) AS best_key,
    first(num ORDER BY score DESC, pos) FILTER (category = 'numeric' AND score IS NOT NULL) AS best_num,
    first(num ORDER BY pos) FILTER (category = 'numeric') AS any_num,
    first(str ORDER BY pos) FILTER (category = 'description') AS any_text,
    first(str ORDER BY pos) FILTER (str IS NOT NULL AND regexp_matches(lower(key), 'status|state|health|condition')) AS given_status,
    first(text ORDER BY pos) FILTER (regexp_matches(lower(key), 'unit|uom|dimension|scale')) AS unit_like,
    first(str ORDER BY pos) FILTER (str IS NOT NULL AND regexp_matches(lower(key), 'type|kind|category|class')) AS type_like,
    last(num ORDER BY pos) FILTER (num IS NOT NULL AND regexp_matches(lower(key), 'min|lower|low')) AS low,
    last(num ORDER BY pos) FILTER (num IS NOT NULL AND NOT regexp_matches(lower(key), 'min|lower|low') AND regexp_matches(lower(key), 'max|upper|high|limit')) AS high,
    first(str ORDER BY pos) FILTER (str IS NOT NULL AND regexp_matches(lower(key), 'time|stamp|date') AND length(str) > 10 AND regexp_matches(str, '[TZ:+-]')) AS time_text,
    any_value(str) FILTER (key = 'unit' AND str <> '') AS exact_unit, any_value(str) FILTER (key = 'field') AS field_name
    FROM fields GROUP BY msg_id"""

SQL_VIEWS["named"] = """SELECT *, len(parts) AS depth,
    list_filter(list_transform(range(1, len(parts)), lambda i: CASE WHEN regexp_matches(parts[i + 1], '^[0-9]+$')
      OR (length(parts[i + 1]) <= 10 AND regexp_matches(replace(parts[i + 1], '_', ''), '^[A-Za-z0-9]+$')) THEN parts[i] || '_' || parts[i + 1] END),
      lambda x: x IS NOT NULL)[1] AS pair,
    (regexp_matches(parts[-1], '^[0-9]+$') OR (length(parts[-1]) <= 10 AND regexp_matches(replace(parts[-1], '_', ''), '^[A-Za-z0-9]+$'))) AS leaf_is_id
    FROM picked"""

SQL_VIEWS["learned"] = """SELECT *, coalesce(best_num, any_num) AS value_num, CASE WHEN best_num IS NULL AND any_num IS NULL THEN any_text END AS value_str,
    CASE WHEN depth = 3 THEN parts[1] || '_' || parts[2] WHEN depth >= 2 AND pair IS NOT NULL THEN pair
      WHEN regexp_matches(best_id, '^[0-9]+$') THEN parts[1] || '_' || best_id WHEN best_id IS NOT NULL THEN best_id
      WHEN depth >= 2 THEN parts[1] || '_' || parts[2] ELSE parts[1] END AS equipment_id,
    CASE WHEN depth = 3 THEN parts[3] WHEN parts[-1] <> '' AND NOT leaf_is_id THEN parts[-1]
      WHEN leaf_is_id AND depth > 1 AND parts[-2] <> '' THEN parts[-2] ELSE coalesce(best_description, best_key, 'sensor') END AS sensor_type
    FROM named"""

SQL_VIEWS["indexed"] = """SELECT project_id, topic_name, min(ord) AS ord, last(sensor_type ORDER BY ord) AS sensor_type,
    last(min_value ORDER BY ord) AS min_value, last(max_value ORDER BY ord) AS max_value, last(enabled ORDER BY ord) AS enabled
    FROM thresholds GROUP BY project_id, topic_name"""

SQL_VIEWS["evaluated"] = """SELECT *, CASE WHEN value < min_value THEN 'min' WHEN value > max_value THEN 'max' END AS kind FROM (
    SELECT r.project_id, r.equipment_id, r.sensor_type, r.topic, r.ts, r.msg_id, r.value, t.min_value, t.max_value, t.enabled
    FROM readings r JOIN indexed t ON t.project_id = r.project_id AND (t.topic_name = r.topic OR ends_with(r.topic, '/' || t.sensor_type))
    QUALIFY row_number() OVER (PARTITION BY r.msg_id ORDER BY t.ord) = 1) WHERE enabled"""

SQL_VIEWS["episodes"] = """SELECT project_id, equipment_id, sensor_type, topic, kind AS threshold_type, breaches, opened_at, opened_value, threshold_value,
      "timestamp", current_value, resolved_at, resolved_msg_id,
      project_id || '_' || equipment_id || '_' || sensor_type || '_' || kind AS alert_id,
      CASE WHEN abs(opened_value - threshold_value) > threshold_value * 0.2::DOUBLE THEN 'critical' ELSE 'warning' END AS severity,
      upper(sensor_type[1]) || sensor_type[2:] || ' is ' || CASE WHEN kind = 'max' THEN 'above' ELSE 'below' END || ' threshold: '
        || printf('%.2f', opened_value) || ' (threshold: ' || printf('%.2f', threshold_value) || ')' AS message, resolved_at IS NOT NULL AS resolved
    FROM (SELECT project_id, equipment_id, sensor_type, topic, kind, count(*) AS breaches, min(ts) AS opened_at, arg_min(value, msg_id) AS opened_value,
        arg_min(CASE WHEN kind = 'min' THEN min_value ELSE max_value END, msg_id) AS threshold_value, max(ts) AS "timestamp",
        arg_max(value, msg_id) AS current_value, any_value(closing_ts) AS resolved_at, any_value(closing_id) AS resolved_msg_id
      FROM (SELECT *, min(ts) FILTER (kind IS NULL) OVER (PARTITION BY project_id, equipment_id, sensor_type, topic, run) AS closing_ts,
          min(msg_id) FILTER (kind IS NULL) OVER (PARTITION BY project_id, equipment_id, sensor_type, topic, run) AS closing_id
        FROM (SELECT *, coalesce(sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, equipment_id, sensor_type, topic
            ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM evaluated))
      WHERE kind IS NOT NULL GROUP BY project_id, equipment_id, sensor_type, topic, run, kind)"""

_NEEDS.update(
    fields=["mixed_messages"],
    picked=["mixed_messages", "fields"],
    named=["mixed_messages", "fields", "picked"],
    learned=["mixed_messages", "fields", "picked", "named"],
    indexed=["readings", "thresholds"],
    evaluated=["readings", "thresholds", "indexed"],
    episodes=["readings", "thresholds", "indexed", "evaluated"],
)
