"""Streams give what the batch operators give, for any cut into micro-batches."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.alerts import alert_episodes
from gaugeflow.operators.live import latest_readings
from gaugeflow.operators.storage import session_stats
from gaugeflow.streaming import live
from gaugeflow.streaming import alerts
from gaugeflow.streaming.alerts import emit_alert_events
from gaugeflow.streaming.monitor import landed_keys, monitor, monitored

READING = "project_id string, equipment_id string, sensor_type string, topic string, ts timestamp, msg_id long, value double"
START = datetime(2024, 1, 1)


def make_readings(n=240, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = rnd.choice(["cell_1", "cell_1", "cell_2"])
        s = rnd.choice(["glucose", "pH"])
        rows.append(("p", e, s, f"cell/{e[-1]}/{s}", START + timedelta(seconds=20 * i), i, float(rnd.choice([1, 3, 5, 9, 13, 15]))))
    return rows


@pytest.fixture(scope="module")
def thresholds(spark):
    rows = [
        ("p", 1, "cell/1/glucose", "glucose", 4.0, 12.0, True),
        ("p", 2, "x/pH", "pH", None, 8.0, True),
    ]
    return spark.createDataFrame(rows, "project_id string, ord long, topic_name string, sensor_type string, min_value double, max_value double, enabled boolean")


def write_batches(spark, rows, folder, parts, schema=READING):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, folder, schema=READING):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_alert_stream_equals_batch(spark, thresholds, tmp_path, parts):
    rows = make_readings()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, rows, folder, parts)
    q = emit_alert_events(streamed(spark, folder), thresholds, out, str(tmp_path / "cp"))
    assert q.awaitTermination(300) and q.exception() is None
    events = spark.read.parquet(out)
    batch = alert_episodes(spark.createDataFrame(rows, READING), thresholds)
    cols = ["alert_id", "topic", "opened_at", "opened_value", "threshold_value", "severity", "message"]
    assert as_set(events.filter("event = 'opened'"), *cols) == as_set(batch, *cols)
    closed = [*cols, "timestamp", "current_value", "resolved_at"]
    assert as_set(events.filter("event = 'resolved'"), *closed) == as_set(batch.filter("resolved"), *closed)
    # a restart from the checkpoint adds nothing, new data goes on from the kept state
    before = events.count()
    q = emit_alert_events(streamed(spark, folder), thresholds, out, str(tmp_path / "cp"))
    assert q.awaitTermination(300) and spark.read.parquet(out).count() == before


def run_once(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


def test_state_streams_equal_batch(spark, tmp_path):
    rows = [(*r, f"s{r[5] % 2}") for r in make_readings(60)]
    schema = READING + ", session_id string"
    folder = str(tmp_path / "in")
    write_batches(spark, rows, folder, 3, schema)
    batch = spark.createDataFrame(rows, schema)
    run_once(live.latest_stream(streamed(spark, folder, schema)), "complete", "latest_out", tmp_path)
    cols = ["equipment_id", "sensor_type", "ts", "msg_id", "value"]
    assert as_set(spark.table("latest_out"), *cols) == as_set(latest_readings(batch), *cols)
    run_once(live.session_stream(streamed(spark, folder, schema)), "complete", "session_out", tmp_path)
    cols = ["session_id", "total_messages", "equipment_ids", "sensor_types"]
    assert as_set(spark.table("session_out"), *cols) == as_set(session_stats(batch), *cols)


def test_trend_and_duplicates(spark, tmp_path):
    rows = [("cell_1", "pH", START + timedelta(minutes=m), m, float(m)) for m in range(0, 60)]
    rows += rows[:5]  # delivered twice
    schema = "cell_id string, subtopic string, ts timestamp, msg_id long, reading double"
    folder = str(tmp_path / "in")
    write_batches(spark, rows[:40], folder, 1, schema)
    write_batches(spark, rows[40:], folder, 1, schema)
    clean = live.deduplicated(streamed(spark, folder, schema), "2 hours")
    run_once(clean, "append", "clean_out", tmp_path)
    assert spark.table("clean_out").count() == 60
    run_once(live.trend_stream(streamed(spark, folder, schema), "10 minutes", "10 minutes"), "append", "trend_out", tmp_path)
    got = {str(r.bucket)[11:16]: (r.mean_value, r.data_point_count) for r in spark.table("trend_out").collect()}
    # only windows that end before the watermark (last reading minus ten minutes) have come out
    assert "00:40" not in got and "00:50" not in got
    assert got["00:10"] == (14.5, 10)


def test_monitor(spark, thresholds, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    lines = []
    for i, v in enumerate([9, 13, 15, 10, 16, 3]):
        payload = json.dumps({"value": v, "unit": "mM", "field": "glucose_mM"})
        lines.append(json.dumps({"msg_id": i, "topic": "cell/1/glucose", "payload": payload, "ingest_ts": f"2024-01-01T00:00:0{i}", "project_id": "p", "session_id": "s"}))
    lines += ["not json", json.dumps({"msg_id": 9, "topic": "t", "payload": "[1]", "project_id": "p"})]
    (landing / "a.json").write_text("\n".join(lines[:4] + lines[6:]))
    (landing / "b.json").write_text("\n".join(lines[4:6]))
    layout = spark.createDataFrame([("n1", "cell_1"), ("n2", "cell_2")], "id string, equipment_id string")
    edges = spark.createDataFrame([("e", "n1", "n2")], "id string, source string, target string")
    pushed = []
    queries = monitor(
        spark, str(landing), thresholds, layout, edges, str(tmp_path / "out"), str(tmp_path / "cp"),
        lambda df, batch: pushed.append(sorted(r.body for r in df.collect())), available_now=True,
    )
    for q in queries.values():
        assert q.awaitTermination(300) and q.exception() is None
    stored = spark.read.parquet(str(tmp_path / "out" / "messages"))
    assert [r.value for r in stored.orderBy("msg_id").collect()] == [9, 13, 15, 10, 16, 3]
    dead = spark.read.parquet(str(tmp_path / "out" / "dead_letters")).collect()
    assert sorted(r.reason for r in dead) == ["line is not a message", "payload is not a JSON object"] and all(r.ingest_ts for r in dead)
    assert stored.filter("unit = 'mM' and project_id = 'p' and session_id = 's'").count() == 6
    events = spark.read.parquet(str(tmp_path / "out" / "alerts"))
    got = sorted((r.event, r.threshold_type, r.opened_value, r.severity, r.current_value) for r in events.collect())
    assert got == [
        ("opened", "max", 13.0, "warning", 13.0), ("opened", "max", 16.0, "critical", 16.0),
        ("opened", "min", 3.0, "critical", 3.0), ("resolved", "max", 13.0, "warning", 15.0),
    ]
    assert any('"value":3.0' in body and '"node_status":"active"' in body for body in pushed[-1])
    assert any('"node_status":"idle"' in body for body in pushed[-1])


def test_monitor_scans_a_payload_once(spark, tmp_path, capsys):
    """Filters on what was read from a payload don't read it again, and keys that landed are looked up."""
    payload = json.dumps({"value": 3, "unit": "mM"})
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"msg_id": i, "topic": f"cell/{i}/pH", "payload": payload}) for i in range(3)))
    assert set(landed_keys(spark, str(tmp_path))) == {"value", "unit"} and landed_keys(spark, str(tmp_path / "none")) == {}
    rows = monitored(spark, str(tmp_path)).filter(F.col("value").isNotNull())
    rows.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("aggregate(") == 1 and "keys: [unit,value]" in plan


def test_keys_of_a_bucket_keep_their_own_alerts(monkeypatch):
    """Keys that share a state give the events that each gives alone, over several batches."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

    rnd = np.random.default_rng(5)
    shared, alone = State(), {name: State() for name in "abcdefgh"}
    for n in (40, 1, 200, 3, 60):
        kind = rnd.choice([0, 0, 0, 1, 2], n)
        rows = pd.DataFrame({
            "packed": rnd.choice(list(alone), n), "at": rnd.integers(0, 20, n), "msg_id": rnd.permutation(n), "value": rnd.random(n),
            "kind": kind, "threshold_value": np.where(kind > 0, kind / 2, np.nan),
        })
        together = [e for frame in alerts.update_alerts((0,), iter([rows[: n // 2], rows[n // 2 :]]), shared) for e in frame.values.tolist()]
        each = [e for name, state in alone.items() for frame in alerts.update_alerts((0,), iter([rows[rows.packed == name]]), state) for e in frame.values.tolist()]
        assert sorted(together, key=str) == sorted(each, key=str) and (n < 10 or together)
        assert set(json.loads(shared.get[0]) if shared.exists else {}) == {name for name, state in alone.items() if state.exists}


def test_few_rows_of_a_key_give_what_many_do(monkeypatch):
    """Row by row and by runs: the same events and open alerts; a key without breach and state makes no frame."""
    rnd = np.random.default_rng(3)

    class State:
        exists = False

    for n in [0, 1, *rnd.integers(2, 40, 60)]:
        kind = rnd.integers(0, 3, n)
        columns = {"kind": kind, "at": np.sort(rnd.integers(0, 20, n)), "value": rnd.random(n), "threshold_value": np.where(kind > 0, kind / 2, np.nan)}
        carried = {1: [1, 0.5, 0.25, 2, 0.75] if n % 2 else None, 2: [0, 3.0, 2.0, 1, 4.0] if n % 3 == 0 else None}
        monkeypatch.setattr(alerts, "FEW_ROWS", -1)
        by_run = alerts.advance(columns, dict(carried))
        monkeypatch.setattr(alerts, "FEW_ROWS", 100)
        assert alerts.advance(columns, dict(carried)) == by_run
        calm = pd.DataFrame({**columns, "kind": 0 * kind, "msg_id": np.arange(n)})
        monkeypatch.setattr(alerts, "advance", None)
        assert list(alerts.update_alerts(("k",), iter([calm]), State())) == []
        monkeypatch.undo()
