import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.cells import normalize_cell_list, resolve_sensor
from gaugeflow.functions.timeranges import choose_interval, period
from gaugeflow.operators import dashboard as D
from gaugeflow.operators import live as L
from gaugeflow.operators import registry as G
from gaugeflow.operators import series as S
from gaugeflow.operators import storage as T
from gaugeflow.operators.analysis import analyze_messages

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 0.9999, 1.0])
def test_percentile_is_exact_on_a_busy_group(spark, p):
    """One group is far larger than the sketch resolution, others are tiny or hold ties only."""
    rng = np.random.default_rng(5)
    busy = rng.lognormal(size=60000)
    rows = spark.createDataFrame([("busy", float(v)) for v in busy] + [("tie", 2.0)] * 50 + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)], "g string, reading double")
    got = {r.g: r.p for r in S.percentile(rows.repartition(8), p, ["g"], "p").collect()}
    assert got["busy"] == pytest.approx(np.quantile(busy, p), rel=1e-12)
    assert (got["tie"], got["one"], got["two"]) == (2.0, 7.0, 1.0 + p)
    assert "none" not in got


def test_periods():
    assert period("24h") == timedelta(days=1) and period("1w") == timedelta(days=7) and period("30 days") == timedelta(days=30)
    assert [choose_interval(x) for x in ("1h", "24h", "7d", "1w", "30d")] == ["10m", "10m", "1h", "1h", "1d"]
    with pytest.raises(ValueError):
        period("soon")


def test_cells_and_aliases(spark):
    df = spark.createDataFrame([("cell1, cell 2,5,cell_6,none", "oxygen"), ("7", "odd")], "cells string, alias string")
    got = [tuple(r) for r in df.select(F.array_join(normalize_cell_list("cells"), ","), resolve_sensor("alias")).collect()]
    assert got == [("cell_1,cell_2,cell_5,cell_6,none", "o2_percent"), ("cell_7", "odd")]


def test_constant_sensor_has_no_coefficient(spark):
    rows = [("cell_1", s, START + timedelta(minutes=m), m, v) for m in range(5) for s, v in (("x", 1.0), ("y", float(m)))]
    r = spark.createDataFrame(rows, "cell_id string, subtopic string, ts timestamp_ntz, msg_id long, reading double")
    row = S.correlation(r, "x", "y", "1m").first()
    assert (row.coefficient, row.covariance, row.data_point_count) == (None, 0.0, 5)


def test_regression_of_short_and_constant_series(spark):
    rows = [("one", "s", START, 1, 5.0)] + [("flat", "s", START + timedelta(days=i), i, 4.0) for i in range(3)]
    rows += [("line", "s", START + timedelta(days=i), i, 1.0 + 2.0 * i) for i in range(4)]
    r = spark.createDataFrame(rows, "cell_id string, subtopic string, ts timestamp_ntz, msg_id long, reading double")
    got = {x.cell_id: x for x in S.regression_over_time(r).collect()}
    assert got["one"].slope_per_day is None
    assert got["flat"].slope_per_day == pytest.approx(0.0)
    assert (got["line"].slope_per_day, got["line"].intercept, got["line"].r2) == pytest.approx((2.0, 1.0, 1.0), abs=1e-6)


def test_expand_range(spark):
    r = spark.createDataFrame([("cell_1", START, 1.0)], "cell_id string, ts timestamp_ntz, reading double")

    def expanded(days):
        return S.expand_range_if_empty(r, as_of=F.lit(START + timedelta(days=days)).cast("timestamp_ntz")).first().expanded

    assert [expanded(d) for d in (0.5, 3, 20, 90)] == ["24h", "7d", "30d", "all"]
    assert S.expand_range_if_empty(r.filter("false")).first().expanded is None


@pytest.mark.parametrize("interval,slice_seconds,bits", [(0.5, 5, 6), (0.5, 1, 1), (3.0, 2, 2), (1.0, 600, 6)])
def test_throttle_equals_greedy_choice(spark, monkeypatch, interval, slice_seconds, bits):
    """A tree of any width gives the greedy choice; with two children a group, its depth is the logarithm of the slices."""
    monkeypatch.setattr(L, "FAN_BITS", bits)
    rnd = random.Random(2)
    rows, t = [], 0
    for i in range(1200):
        t += rnd.choice([0, 10_000, 90_000, 400_000, 700_000]) if i % 100 else 20_000_000
        rows.append(("a" if rnd.random() < 0.8 else rnd.choice(["b", None]), START + timedelta(microseconds=t), i))
    rows += [("old", START - timedelta(days=20_000, seconds=s), -s) for s in range(5, 0, -1)]
    want, last = [], {}
    for k, ts, i in rows:
        if k not in last or ts - last[k] >= timedelta(seconds=interval):
            last[k] = ts
            want.append((k, ts, i))
    df = spark.createDataFrame(rows, "project_id string, ts timestamp_ntz, msg_id long")
    got = [tuple(r) for r in L.throttle(df, interval, slice_seconds=slice_seconds).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_throttle_of_nothing(spark):
    assert L.throttle(spark.createDataFrame([], "project_id string, ts timestamp_ntz, msg_id long")).count() == 0


def test_recent_window_and_pivot(spark):
    rows = [("e", "a", START, 1, 1.0), ("e", "a", START + timedelta(seconds=5), 2, 2.0), ("e", "b", START + timedelta(seconds=5), 3, 3.0),
            ("e", "a", START + timedelta(seconds=5), 4, 4.0), ("e", "b", START + timedelta(seconds=35), 5, 5.0), ("f", "a", START, 6, 6.0)]
    r = spark.createDataFrame(rows, "equipment_id string, sensor_type string, ts timestamp_ntz, msg_id long, value double")
    wide = D.pivot_series(D.recent_window(r, 30), ["a", "b"]).orderBy("equipment_id", "i").collect()
    assert [(w.equipment_id, w.i, w.a, w.b) for w in wide] == [("e", 0, 4.0, 3.0), ("e", 1, None, 5.0), ("f", 0, 6.0, None)]


def test_discovery_of_lab_messages(lab_messages):
    nodes = G.discovered_nodes(G.sensor_registry(analyze_messages(lab_messages.filter("msg_id <= 5"))))
    got = {r.equipment_id: (r.id, r.equipment_type, r.topics, r.sensor_count, r.message_count) for r in nodes.collect()}
    assert sorted(got) == ["lab_anvil", "lab_conveyor", "lab_furnace", "lab_melter"]
    assert got["lab_conveyor"] == ("node_lab_conveyor", "lab", ["lab/conveyor/position", "lab/conveyor/speed"], 2, 2)


def test_node_status_and_snapshot(spark):
    latest = spark.createDataFrame([("e1", "b", 2.0, "u", START, "active"), ("e1", "a", 1.0, "u", START, "idle"), ("zz", "a", 1.0, "u", START, "idle")],
                                   "equipment_id string, sensor_type string, value double, unit string, ts timestamp_ntz, status string")
    layout = spark.createDataFrame([("n1", "e1"), ("n2", "e2")], "id string, equipment_id string")
    nodes = L.node_status(latest, layout)
    got = {r.id: ([s.sensor_type for s in r.sensors], r.node_status, r.last_updated) for r in nodes.collect()}
    assert got == {"n1": (["a", "b"], "active", START), "n2": ([], "idle", None)}
    edges = spark.createDataFrame([("e", "n1", "n2"), ("", "n1", "n2"), ("f", None, "n2")], "id string, source string, target string")
    assert [r.id for r in L.valid_edges(edges).collect()] == ["e"]
    assert L.graph_snapshot(nodes, edges.limit(1)).count() == 3
    s = L.snapshot_summary(nodes, L.valid_edges(edges)).first()
    assert (s.nodes, s.edges, s.last_updated, s.first_message) == (2, 1, START, True)


@pytest.mark.parametrize("slice_seconds", [1, 30, 10000])
def test_retain_last_with_a_busy_project(spark, slice_seconds):
    rows = [("busy" if i % 4 else "calm", START + timedelta(seconds=i // 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "project_id string, ts timestamp_ntz, msg_id long")
    got = sorted((r.project_id, r.msg_id) for r in T.retain_last(df, 37, slice_seconds=slice_seconds).collect())
    want = []
    for p in ("busy", "calm"):
        want += [(p, i) for _, i in sorted((ts, i) for q, ts, i in rows if q == p)[-37:]]
    assert got == sorted(want)
    assert T.retain_last(df, 50, by=None, slice_seconds=slice_seconds).agg(F.min("msg_id")).first()[0] == 350


@pytest.mark.parametrize("rows_in_order,bits", [(5, 3), (40, 10)])
def test_retain_last_of_one_instant_and_far_ids(spark, monkeypatch, rows_in_order, bits):
    """Brackets go down to one instant, then to ranges of ids of any sign, without ordering a whole project."""
    monkeypatch.setattr(T, "BRACKET_ROWS", rows_in_order)
    monkeypatch.setattr(T, "BRACKET_BITS", bits)
    ids = [-(1 << 63), -5, -1, 0, 1, 7, 1 << 40, (1 << 62) + 3, (1 << 63) - 1, *range(100, 400)]
    rows = [("one", START, i) for i in ids] + [("two", START + timedelta(microseconds=i // 4), i) for i in range(200)] + [(None, START, i) for i in range(30)] + [("few", START, 1)]
    df = spark.createDataFrame(rows, "project_id string, ts timestamp_ntz, msg_id long").repartition(3)
    for n in (1, 3, 60, 303):
        want = []
        for p in ("one", "two", None, "few"):
            want += [(str(p), i) for _, i in sorted((ts, i) for q, ts, i in rows if q == p)[-n:]]
        assert sorted((str(r.project_id), r.msg_id) for r in T.retain_last(df, n).collect()) == sorted(want)
    assert T.retain_last(df, 5, by=None).count() == 5


def test_sessions(spark):
    events = spark.createDataFrame(
        [("p", "s1", "P", "start", START), ("p", "s1", None, "stop", START + timedelta(hours=1)), ("p", "s2", "P", "start", START), ("p", "s3", None, "stop", START)],
        "project_id string, session_id string, project_name string, event string, ts timestamp_ntz",
    )
    got = {r.session_id: (r.project_name, r.end_time) for r in T.session_table(events).collect()}
    assert got == {"s1": ("P", START + timedelta(hours=1)), "s2": ("P", None)}
