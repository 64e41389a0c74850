from pyspark.sql import functions as F

from gaugeflow.functions.readings import range_status, to_numeric
from gaugeflow.functions.topics import topic_pattern_regex
from gaugeflow.operators.analysis import analyze_messages, filter_topics, payload_fields, split_dead_letters

EXPECTED = {
    1: ("lab_furnace", "temperature", 850.5, "heating", "celsius", 1.0),
    2: ("lab_melter", "temperature", 1200.0, "melting", "celsius", 1.0),
    3: ("lab_anvil", "force", 2500.0, "positioning", "newtons", 1.0),
    4: ("lab_conveyor", "speed", 1.5, "transporting", "m/s", 1.0),
    5: ("lab_conveyor", "position", 45.0, "transporting", "degrees", 1.0),
    6: ("cell_1", "glucose_mM", 9.98, "active", "mM", 1.0),
    7: ("smr_reactor_core", "heater_current", 25.4, "normal", "A", 1.0),
    8: ("sensors_building1", "temperature", "55.2", "unknown", "", 0.9),
    10: ("simple_data", "simple", None, "unknown", "", 0.6),
    11: ("factory_line1", "machine5", "75.2", "running", "", 0.9),
    12: ("pump7_7", "value", 3.0, "active", "", 0.7),
    13: ("a_b", "on", 1.0, "active", "", 0.8),
}


def test_fixture_messages(lab_messages):
    got = {}
    for r in analyze_messages(lab_messages).collect():
        value = r.value_num if r.value_num is not None else r.value_str
        got[r.msg_id] = (r.equipment_id, r.sensor_type, value, r.status, r.unit, r.confidence)
    assert got == EXPECTED


def test_dead_letters(lab_messages, spark):
    good, dead = split_dead_letters(lab_messages)
    assert [r.msg_id for r in dead.collect()] == [9]
    assert good.count() == 12
    odd = spark.createDataFrame([(1, "t", p) for p in ["[1]", "null", "oops", "", '{"a":1}']], "msg_id long, topic string, payload string")
    assert split_dead_letters(odd)[1].count() == 4


def test_repeated_key_keeps_last_value_at_first_place(spark):
    df = spark.createDataFrame([(1, "a/b/c", '{"x":1,"y":2,"x":3}')], "msg_id long, topic string, payload string")
    rows = [(r.pos, r.key, r.num) for r in payload_fields(df).orderBy("pos").collect()]
    assert rows == [(0, "x", 3.0), (1, "y", 2.0)]


def test_field_categories(spark):
    payload = '{"id":"7","when":"2024-01-01T10:00:00.000Z","note":"all is well today, sir","n":1,"b":true,"o":{"k":1},"l":[1],"z":null}'
    df = spark.createDataFrame([(1, "a/b/c", payload)], "msg_id long, topic string, payload string")
    rows = {r.key: r.category for r in payload_fields(df).collect()}
    assert rows == {
        "id": "identifier", "when": "datetime", "note": "datetime" if "-" in "all is well today, sir" else "description",
        "n": "numeric", "b": "numeric", "o": "object", "l": "array", "z": None,
    }


def test_metadata(spark):
    payload = '{"low":1,"flow":2,"limit":9,"kind":"k","unit":null,"unit_b":"x","pos":{"lat":1.5}}'
    df = spark.createDataFrame([(1, "a/b/c", payload, None)], "msg_id long, topic string, payload string, ingest_ts timestamp_ntz")
    m = analyze_messages(df).first().metadata
    assert (m.unit, m.min_value, m.max_value, m.sensor_type, m.objects) == ("None", 2.0, 9.0, "k", {"pos": '{"lat":1.5}'})


def test_topic_patterns(spark):
    topics = ["lab", "lab/a", "lab/a/b", "cell/1/x"]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")

    def matched(pattern):
        return sorted(r.topic for r in filter_topics(df, pattern).collect())

    assert matched("lab/#") == ["lab", "lab/a", "lab/a/b"]
    assert matched("/lab/+/") == ["lab/a"]
    assert matched("+/+/x") == ["cell/1/x"]
    assert matched(" ") == sorted(topics)
    assert topic_pattern_regex("a.b") == r"^a\.b$"


def test_to_numeric(spark):
    rows = [
        ("number", 2.5, "2.5", 2.5), ("boolean", 1.0, "True", 0.0), ("string", None, " 12.5abc", 12.5), ("string", None, "abc", 0.0),
        ("string", None, "-3e2x", -300.0), ("object", None, '{"a":"x","b":4,"c":5}', 4.0), ("array", None, '["x",7]', 7.0), ("null", None, "None", 0.0),
    ]
    df = spark.createDataFrame(rows, "kind string, num double, text string, want double")
    assert df.filter(to_numeric("kind", "num", "text") != F.col("want")).count() == 0


def test_range_status(spark):
    df = spark.createDataFrame([(v,) for v in [4.0, 5.0, 14.0, 50.0, 86.0, 96.0]], "v double")
    got = [r[0] for r in df.select(range_status("v", F.lit(0.0), F.lit(100.0))).collect()]
    assert got == ["alarm", "warning", "warning", "normal", "warning", "alarm"]
    assert df.select(range_status("v", F.lit(1.0), F.lit(1.0))).first()[0] is None
