"""Schema learning queries over mixed messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import fields as P
from gaugeflow.functions import readings as R
from gaugeflow.functions.text import text_stats
from gaugeflow.functions.topics import looks_like_topic_identifier, parse_topic
from gaugeflow.operators.analysis import analyze_messages, filter_topics, payload_fields, split_dead_letters, with_fields
from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import messages, mixed_messages, table


@query("split_dead_letters", sql="""SELECT event_id AS msg_id, 'dead' AS kind FROM events WHERE event_type IN ('error', 'view')
    UNION ALL SELECT event_id, 'good' FROM events WHERE event_type NOT IN ('error', 'view')""")
def _(spark, d):
    # properties of errors become bare numbers and those of views lose their end
    odd = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k")).when(
        F.col("event_type") == "view", F.regexp_replace("props", "}$", "")
    ).otherwise(F.col("props"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("msg_id"), odd.alias("payload"))
    good, dead = split_dead_letters(rows)
    return good.select("msg_id", F.lit("good").alias("kind")).unionByName(dead.select("msg_id", F.lit("dead").alias("kind")))


@query("filter_topics", "mixed_messages", sql="""SELECT 'cell/+/click' AS pattern, count(*) AS n FROM mixed_messages WHERE regexp_matches(topic, '^cell/[^/]*/click$')
    UNION ALL SELECT 'smr/#', count(*) FROM mixed_messages WHERE topic = 'smr' OR starts_with(topic, 'smr/')
    UNION ALL SELECT '/pump8/', count(*) FROM mixed_messages WHERE topic = 'pump8'
    UNION ALL SELECT '#', count(*) FROM mixed_messages""")
def _(spark, d):
    m = mixed_messages(spark, d)
    parts = [filter_topics(m, p).agg(F.count("*").alias("n")).select(F.lit(p).alias("pattern"), "n") for p in ("cell/+/click", "smr/#", "/pump8/", "#")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("parse_topic", "mixed_messages", sql="""SELECT topic, array_to_string(p, '|') AS parts, len(p) AS depth, p[1] AS root, p[-1] AS leaf,
    CASE WHEN len(p) > 1 THEN p[-2] END AS second_last, CASE WHEN len(p) > 1 THEN array_to_string(p[1:-2], '/') ELSE '' END AS hierarchy
    FROM (SELECT DISTINCT topic, string_split(topic, '/') AS p FROM mixed_messages)""")
def _(spark, d):
    rows = mixed_messages(spark, d).select("topic").distinct().withColumn("p", parse_topic("topic"))
    return rows.select("topic", "p.*").withColumn("parts", F.array_join("parts", "|")).withColumn("depth", F.col("depth").cast("bigint"))


@query("payload_fields", "fields", sql="SELECT msg_id, pos, key, category, num, str, round(score, 6) AS score FROM fields")
def _(spark, d):
    return payload_fields(mixed_messages(spark, d)).select(
        "msg_id", F.col("pos").cast("bigint").alias("pos"), "key", "category", "num", "str", F.round("score", 6).alias("score")
    )


@query("looks_like_identifier", "fields", sql="""SELECT key, str, regexp_matches(lower(key), 'id|device|equipment|node|unit|machine')
      OR (length(str) <= 20 AND (regexp_matches(str, '^[A-Za-z0-9]+$') OR contains(str, '_'))) AS is_id, count(*) AS n
    FROM fields WHERE str IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d)).filter("str is not null")
    return f.groupBy("key", "str", P.looks_like_identifier("key", "str").alias("is_id")).agg(F.count("*").alias("n"))


@query("looks_like_topic_identifier", "mixed_messages", sql="""SELECT part, regexp_matches(part, '^[0-9]+$')
      OR (length(part) <= 10 AND regexp_matches(replace(part, '_', ''), '^[A-Za-z0-9]+$')) AS is_id
    FROM (SELECT DISTINCT unnest(string_split(topic, '/')) AS part FROM mixed_messages)""")
def _(spark, d):
    parts = mixed_messages(spark, d).select(F.explode(F.split("topic", "/")).alias("part")).distinct()
    return parts.withColumn("is_id", looks_like_topic_identifier("part"))


@query("looks_like_datetime", "fields", sql="""SELECT key, length(str) > 10 AND regexp_matches(str, '[TZ:+-]') AS is_time, count(*) AS n
    FROM fields WHERE str IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d)).filter("str is not null")
    return f.groupBy("key", P.looks_like_datetime("str").alias("is_time")).agg(F.count("*").alias("n"))


@query("is_id_or_time_key", "fields", sql="""SELECT key, regexp_matches(lower(key), 'id|time|stamp|date|count|index') AS excluded, count(*) AS n
    FROM fields GROUP BY ALL""")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d))
    return f.groupBy("key", P.is_id_or_time_key("key").alias("excluded")).agg(F.count("*").alias("n"))


@query("main_value_score", "fields", sql="""SELECT key, round(score, 6) AS score, count(*) AS n FROM fields
    WHERE category = 'numeric' AND score IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d)).filter("category = 'numeric'").filter(~P.is_id_or_time_key("key"))
    return f.groupBy("key", F.round(P.main_value_score("key", "num"), 6).alias("score")).agg(F.count("*").alias("n"))


@query("identifier_score", "fields", sql="SELECT key, str, round(score, 6) AS score, count(*) AS n FROM fields WHERE category = 'identifier' GROUP BY ALL")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d)).filter("category = 'identifier'")
    return f.groupBy("key", "str", F.round(P.identifier_score("key", text="str"), 6).alias("score")).agg(F.count("*").alias("n"))


@query("description_score", "fields", sql="SELECT key, round(score, 6) AS score, count(*) AS n FROM fields WHERE category = 'description' GROUP BY ALL")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d)).filter("category = 'description'")
    return f.groupBy("key", F.round(P.description_score("key"), 6).alias("score")).agg(F.count("*").alias("n"))


@query("equipment_id", "learned", sql="SELECT msg_id, equipment_id FROM learned")
def _(spark, d):
    return with_fields(mixed_messages(spark, d)).select("msg_id", R.equipment_id("parts", "found").alias("equipment_id"))


@query("sensor_type", "learned", sql="SELECT msg_id, sensor_type FROM learned")
def _(spark, d):
    return with_fields(mixed_messages(spark, d)).select("msg_id", R.sensor_type("parts", "found").alias("sensor_type"))


@query("main_value", "learned", sql="SELECT msg_id, value_num, value_str FROM learned")
def _(spark, d):
    rows = with_fields(mixed_messages(spark, d)).select("msg_id", R.typed_value(R.main_value("fields", "found")).alias("v"))
    return rows.select("msg_id", F.col("v.num").alias("value_num"), F.col("v.str").alias("value_str"))


@query("infer_status", "learned", sql="""SELECT msg_id, coalesce(given_status, CASE WHEN value_num < 0 THEN 'error' WHEN value_num = 0 THEN 'idle'
    WHEN value_num > 0 THEN 'active' END, 'unknown') AS status FROM learned""")
def _(spark, d):
    rows = with_fields(mixed_messages(spark, d)).withColumn("v", R.typed_value(R.main_value("fields", "found")))
    return rows.select("msg_id", R.infer_status("found", "v.num").alias("status"))


@query("extract_metadata", "learned", sql="""SELECT msg_id, unit_like AS unit, low AS min_value, high AS max_value, type_like AS sensor_type,
    (SELECT string_agg(key || '=' || replace(text, '.0}', '}'), ';') FROM fields f WHERE f.msg_id = l.msg_id AND f.type = 'OBJECT') AS objects FROM learned l""")
def _(spark, d):
    rows = with_fields(mixed_messages(spark, d)).select("msg_id", R.extract_metadata("found", "objects").alias("m"))
    printed = F.array_join(F.transform(F.map_entries("m.objects"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("msg_id", "m.unit", "m.min_value", "m.max_value", "m.sensor_type", F.when(printed != "", printed).alias("objects"))


@query("payload_timestamp", "learned", sql="""SELECT msg_id, time_text AS timestamp_text, coalesce(strptime(time_text, '%Y-%m-%dT%H:%M:%SZ'), ingest_ts) AS event_ts
    FROM learned""")
def _(spark, d):
    return analyze_messages(mixed_messages(spark, d)).select("msg_id", "timestamp_text", "event_ts")


SQL_CONFIDENCE = """round(least(1.0::DOUBLE, greatest(0.1::DOUBLE, 0.5::DOUBLE + CASE WHEN depth >= 3 THEN 0.2::DOUBLE WHEN depth = 2 THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN n_fields >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN best_key IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN best_id IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN equipment_id = 'device_unknown' THEN 0.2::DOUBLE ELSE 0 END
    - CASE WHEN sensor_type = 'sensor' THEN 0.1::DOUBLE ELSE 0 END)), 6)"""


@query("confidence", "learned", sql=f"SELECT msg_id, {SQL_CONFIDENCE} AS confidence FROM learned")
def _(spark, d):
    return analyze_messages(mixed_messages(spark, d)).select("msg_id", "confidence")


@query("analyze_messages", "learned", sql=f"""SELECT msg_id, topic, equipment_id, sensor_type, value_num, value_str,
    coalesce(given_status, CASE WHEN value_num < 0 THEN 'error' WHEN value_num = 0 THEN 'idle' WHEN value_num > 0 THEN 'active' END, 'unknown') AS status,
    coalesce(unit_like, '') AS unit, {SQL_CONFIDENCE} AS confidence, equipment_id || ' ' || sensor_type AS display_name FROM learned""")
def _(spark, d):
    return analyze_messages(mixed_messages(spark, d)).select(
        "msg_id", "topic", "equipment_id", "sensor_type", "value_num", "value_str", "status", "unit", "confidence", "display_name"
    )


@query("reading_unit", "learned", sql="""SELECT msg_id, coalesce(exact_unit, CASE WHEN contains(field_name, '_') THEN string_split(field_name, '_')[-1] END, '') AS unit
    FROM learned""")
def _(spark, d):
    return with_fields(mixed_messages(spark, d)).select("msg_id", R.reading_unit("fields").alias("unit"))


@query("to_numeric", "fields", sql="""SELECT msg_id, key, coalesce(CASE WHEN type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN num
    WHEN type = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract(str, '^[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)
    WHEN key = 'vehicle' THEN CAST(json_extract_string(text, '$.speed') AS DOUBLE) END, 0.0::DOUBLE) AS value FROM fields""")
def _(spark, d):
    f = payload_fields(mixed_messages(spark, d))
    return f.select("msg_id", "key", R.to_numeric("kind", "num", "text").alias("value"))


@query("range_status", sql="""SELECT event_id, CASE WHEN value / 400 < 0.05::DOUBLE OR value / 400 > 0.95::DOUBLE THEN 'alarm'
    WHEN value / 400 < 0.15::DOUBLE OR value / 400 > 0.85::DOUBLE THEN 'warning' ELSE 'normal' END AS status FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", R.range_status("value", F.lit(0.0), F.lit(400.0)).alias("status"))


@query("text_stats", sql="""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS word_count,
    len(list_filter(string_split(text, '.'), lambda s: regexp_matches(s, '[^ \\t\\n\\x0B\\f\\r]'))) AS sentence_count, length(text) AS character_count,
    CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) > 0
      THEN round(length(text) / len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')), 2) ELSE 0.0::DOUBLE END AS average_word_length,
    CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview FROM documents""")
def _(spark, d):
    stats = table(spark, d, "documents").select("doc_id", text_stats("text").alias("s")).select("doc_id", "s.*")
    return stats.withColumns({c: F.col(c).cast("bigint") for c in ("word_count", "sentence_count", "character_count")})


@query("average_word_length", sql="""SELECT lang, round(avg(length(text) / len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))), 2) AS average_word_length
    FROM documents GROUP BY ALL""")
def _(spark, d):
    s = table(spark, d, "documents").select("lang", text_stats("text").alias("s"))
    return s.groupBy("lang").agg(F.round(F.avg(F.col("s.character_count") / F.col("s.word_count")), 2).alias("average_word_length"))


@query("analyze_cell_messages", "messages", sql="""SELECT msg_id, project_id, replace(regexp_extract(topic, '^[^/]*/[^/]*'), '/', '_') AS equipment_id,
    regexp_extract(topic, '[^/]*$') AS sensor_type, CAST(json_extract_string(payload, '$.value') AS DOUBLE) AS value_num, 'mM' AS unit, 1.0::DOUBLE AS confidence
    FROM messages""")
def _(spark, d):
    return analyze_messages(messages(spark, d)).select("msg_id", "project_id", "equipment_id", "sensor_type", "value_num", "unit", "confidence")
