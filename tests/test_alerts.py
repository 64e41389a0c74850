import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import alerts as A

READING = "project_id string, equipment_id string, sensor_type string, topic string, ts timestamp_ntz, msg_id long, value double"
THRESHOLD = "project_id string, id string, ord long, topic_name string, sensor_type string, min_value double, max_value double, enabled boolean"
START = datetime(2024, 1, 1)


def machine(rows, limits):
    """The alert rules row by row, as a plain model to compare with."""
    open_alerts, done = {}, []
    for project, equipment, sensor, topic, ts, _, value in sorted(rows, key=lambda r: (r[4], r[5])):
        limit = limits.get(topic)
        if limit is None:
            continue
        low, high = limit
        kind = "min" if low is not None and value < low else "max" if high is not None and value > high else None
        key = (project, equipment, sensor, topic)
        if kind is None:
            for k in ("min", "max"):
                if (key, k) in open_alerts:
                    done.append((*open_alerts.pop((key, k)), ts))
        elif (key, kind) in open_alerts:
            open_alerts[(key, kind)][3:] = [ts, value]
        else:
            open_alerts[(key, kind)] = [f"{project}_{equipment}_{sensor}_{kind}", ts, value, ts, value]
    return sorted(map(str, [(*a, None) for a in map(tuple, open_alerts.values())] + [tuple(d) for d in done]))


def episodes_of(df):
    cols = ["alert_id", "opened_at", "opened_value", "timestamp", "current_value", "resolved_at"]
    return sorted(str(tuple(r)) for r in df.select(*cols).collect())


def test_fixture_sequence(spark):
    values = [9.0, 13.0, 15.0, 10.0, 16.0, 3.0]
    rows = [("p", "cell_1", "glucose_mM", "cell/1/glucose_mM", START + timedelta(seconds=i), i, v) for i, v in enumerate(values)]
    thresholds = spark.createDataFrame([("p", "t", 1, "cell/1/glucose_mM", "glucose_mM", 4.0, 12.0, True)], THRESHOLD)
    got = {
        (r.threshold_type, r.opened_value): (r.current_value, r.severity, r.resolved, r.message)
        for r in A.alert_episodes(spark.createDataFrame(rows, READING), thresholds).collect()
    }
    assert got == {
        ("max", 13.0): (15.0, "warning", True, "Glucose Mm is above threshold: 13.00 (threshold: 12.00)"),
        ("max", 16.0): (16.0, "critical", False, "Glucose Mm is above threshold: 16.00 (threshold: 12.00)"),
        ("min", 3.0): (3.0, "critical", False, "Glucose Mm is below threshold: 3.00 (threshold: 4.00)"),
    }


@pytest.mark.parametrize("ranges,batch", [(1, "2000"), (3, "2000"), (5, "7"), (40, "1")])
def test_episodes_equal_plain_model(spark, ranges, batch):
    """One sensor holds most rows; any number of ranges and rows of a batch gives the same episodes."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rnd = random.Random(11)
    rows, limits = [], {}
    for i in range(900):
        cell = "1" if rnd.random() < 0.7 else str(rnd.randint(2, 6))
        rows.append(("p", f"cell_{cell}", "s", f"cell/{cell}/s", START + timedelta(seconds=i // 2), i, float(rnd.choice([1, 5, 6, 7, 20]))))
        limits[f"cell/{cell}/s"] = (2.0, 10.0)
    thresholds = spark.createDataFrame([("p", "t", 1, "other/s", "s", 2.0, 10.0, True)], THRESHOLD)
    got = A.alert_episodes(spark.createDataFrame(rows, READING), thresholds, ranges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert episodes_of(got) == machine(rows, limits)
    assert got.filter("resolved and resolved_at < opened_at").count() == 0
    assert got.filter("not resolved").groupBy("alert_id", "topic").count().filter("count > 1").count() == 0


def test_back_fill_of_one_instant(spark):
    """All readings of one sensor at one time are dealt over tasks, and the plan scans its readings at most twice."""
    rows = [("p", "e", "s", "a/s", START, i, float(5 if i % 10 < 7 else 20)) for i in range(2000)]
    thresholds = spark.createDataFrame([("p", "t", 1, "a/s", "s", None, 10.0, True)], THRESHOLD)
    readings = spark.createDataFrame(rows, READING)
    got = A.alert_episodes(readings, thresholds, 8)
    assert episodes_of(got) == machine(rows, {"a/s": (None, 10.0)})
    ranges = A.evaluate_readings(readings, thresholds).repartitionByRange(8, "topic", "ts", "msg_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 500


def test_first_match_even_if_disabled(spark):
    thresholds = spark.createDataFrame(
        [
            ("p", "a", 1, "x/s", "s", None, 1.0, False),  # first match of every topic that ends in /s
            ("p", "b", 2, "y/s", "s", None, 1.0, True),
            ("p", "c", 3, "lone", "lone", None, 1.0, True),
            ("p", "d", 4, "lone", "lone", None, 9.0, True),  # replaces c at its place
        ],
        THRESHOLD,
    )
    rows = [("p", "e", "s", t, START, i, 5.0) for i, t in enumerate(["x/s", "y/s", "s", "lone", "z/lone", "q/other"])]
    rows.append(("other", "e", "s", "lone", START, 9, 5.0))
    got = A.match_threshold(spark.createDataFrame(rows, READING), thresholds)
    assert sorted((r.topic, r.max_value) for r in got.collect()) == [("lone", 9.0), ("z/lone", 9.0)]


def test_text_values_are_not_evaluated(spark):
    thresholds = spark.createDataFrame([("p", "t", 1, "a/s", "s", 1.0, None, True)], THRESHOLD)
    rows = [("p", "e", "s", "a/s", START, 1, None)]
    assert A.alert_episodes(spark.createDataFrame(rows, READING), thresholds).count() == 0


def test_reports(spark):
    rows = [("p", f"cell_{i % 3}", "s", f"cell/{i % 3}/s", START + timedelta(hours=i), i, 20.0 if (i // 3) % 2 == 0 else 5.0) for i in range(30)]
    thresholds = spark.createDataFrame([("p", "t", 1, "x/s", "s", None, 10.0, True)], THRESHOLD)
    e = A.alert_episodes(spark.createDataFrame(rows, READING), thresholds)
    assert e.count() == 15 and A.active_alerts(e).count() == 0
    # the limit counts before the equipment filter
    assert A.alert_history(e, 6, "cell_1").count() == 2
    assert A.alert_history(e, 0).count() == 15
    assert A.cap_history(e, 4).agg(F.min("resolved_at")).first()[0] == START + timedelta(hours=23)
    assert A.clear_resolved(e, 6).count() == 3
    s = A.alert_stats(e).first()
    assert (s.active_alerts, s.historical_alerts, s.warning, s.critical, s.most_recent_alert) == (0, 15, 0, 0, None)


def test_threshold_changes(spark):
    base = spark.createDataFrame(
        [("p", "t1", 1, "a/x", "x", 1.0, None, True), ("p", "t2", 2, "a/y", "y", 1.0, 2.0, None), ("p", "t3", 3, "a/z", "z", 1.0, 2.0, True)], THRESHOLD
    )
    log = spark.createDataFrame(
        [
            (10, "create", "p", "n1", "b/w", None, 7.0, None),
            (11, "update", "p", "t1", None, 3.0, 4.0, None),
            (12, "toggle", "p", "t1", None, None, None, None),
            (13, "update", "p", "t1", None, None, None, True),  # no bound
            (14, "delete", "p", "t3", None, None, None, None),
            (15, "toggle", "p", "t3", None, None, None, None),  # gone
            (16, "update", "p", "t2", None, None, 9.0, False),
            (17, "toggle", "p", "t2", None, None, None, None),
            (18, "toggle", "p", "nope", None, None, None, None),
            (19, "create", "p", "n2", "", 1.0, None, None),
            (9, "toggle", "p", "n1", None, None, None, None),  # before it was created
        ],
        "ord long, op string, project_id string, id string, topic_name string, min_value double, max_value double, enabled boolean",
    )
    state, outcomes = A.apply_threshold_changes(base, log)
    got = [(r.id, r.sensor_type, r.min_value, r.max_value, r.enabled) for r in state.orderBy("place").collect()]
    assert got == [("t1", "x", 3.0, 4.0, False), ("t2", "y", None, 9.0, True), ("n1", "w", None, 7.0, True)]
    bad = {r.ord: r.outcome for r in outcomes.filter("outcome <> 'ok'").collect()}
    assert bad == {
        9: "threshold not found", 13: "a bound is required", 15: "threshold not found", 18: "threshold not found", 19: "topic_name is required",
    }
