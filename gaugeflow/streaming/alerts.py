"""Alert state machine on a stream of readings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.functions.topics import topic_leaf
from gaugeflow.operators.alerts import ALERT_KEY, evaluate_breach, finish_alerts, index_thresholds

KINDS = ("min", "max")
# Only numbers and one packed key cross to Python: times are microseconds and kinds are 0 (normal), 1 (min), 2 (max).
NAMES = ("opened_at", "opened_value", "threshold_value", "timestamp", "current_value")
SLOTS = ("opened_at long", "opened_value double", "threshold_value double", "timestamp long", "current_value double")
#: Keys share a state by their hash, as a call for each key costs far more than its rows do. A checkpoint is bound to this number.
BUCKETS = 4096
#: The open alerts of a bucket's keys as JSON, for each key a list of slots by kind.
STATE_SCHEMA = "open string"
#: Rows of a key that are taken one by one, which costs less than array operations on so few.
FEW_ROWS = 100
EVENT_SCHEMA = f"packed string, kind int, {', '.join(SLOTS)}, resolved_at long"
KEY_SCHEMA = ", ".join(f"{name} string" for name in ALERT_KEY)


def evaluate_stream(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Streamed readings under an enabled threshold with ``kind`` and ``threshold_value``.

    Exact topics and topic ends are two stream-static equi joins; the static
    side is read again in every batch, so changed thresholds take effect.
    """
    chosen = F.struct("ord", "min_value", "max_value", "enabled")
    indexed = index_thresholds(thresholds)
    exact = indexed.select("project_id", F.col("topic_name").alias("topic"), chosen.alias("exact"))
    suffix = indexed.groupBy("project_id", F.col("sensor_type").alias("leaf")).agg(F.min(chosen).alias("suffix"))
    leaf = F.when(F.col("topic").contains("/"), topic_leaf("topic"))
    matched = (
        readings.filter(F.col("value").isNotNull())
        .select(*ALERT_KEY, F.col("ts").cast("timestamp").alias("ts"), "msg_id", "value", leaf.alias("leaf"))
        .join(exact, ["project_id", "topic"], "left")
        .join(suffix, ["project_id", "leaf"], "left")
        .withColumn("t", F.least("exact", "suffix"))
        .filter(F.coalesce("t.enabled", F.col("t").isNotNull()))
        .withColumn("kind", evaluate_breach("value", "t.min_value", "t.max_value"))
    )
    bound = F.when(F.col("kind") == "min", F.col("t.min_value")).when(F.col("kind") == "max", F.col("t.max_value"))
    return matched.select(*ALERT_KEY, "ts", "msg_id", "value", "kind", bound.alias("threshold_value"))


def update_alerts(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Opened and resolved events of the keys of one bucket; their open alerts are the state.

    The rows of each key in a batch are put in time order; the batch size is
    bounded by the limits of the source.
    """
    rows = [r for r in parts if len(r)]
    if not rows or (not state.exists and not any(r["kind"].to_numpy().any() for r in rows)):
        return
    columns = {c: np.concatenate([r[c].to_numpy() for r in rows]) for c in ("at", "msg_id", "value", "kind", "threshold_value")}
    codes, names = pd.factorize(np.concatenate([r["packed"].to_numpy() for r in rows]))
    order = np.lexsort((columns["msg_id"], columns["at"], codes))
    codes, columns = codes[order], {c: v[order] for c, v in columns.items()}
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    ends, breached = np.append(starts[1:], len(codes)), np.maximum.reduceat(columns["kind"], starts) > 0
    opened, events = json.loads(state.get[0]) if state.exists else {}, []
    for name, a, e, any_breach in zip(names, starts.tolist(), ends.tolist(), breached.tolist()):
        held = opened.pop(name, None)
        if not any_breach and held is None:
            continue
        found, left = advance({c: v[a:e] for c, v in columns.items()}, dict(enumerate(held or [None] * len(KINDS), 1)))
        events += [[name, *event] for event in found]
        if any(left.values()):
            opened[name] = list(left.values())
    if opened:
        state.update((json.dumps(opened),))
    elif state.exists:
        state.remove()
    if events:
        # one frame of a single block, which takes far less time to make than typed columns
        out = np.empty((len(events), 2 + len(NAMES) + 1), object)
        out[:] = events
        yield pd.DataFrame(out, columns=["packed", "kind", *NAMES, "resolved_at"])


def advance(columns: dict, carried: dict) -> tuple[list, dict]:
    """Events of one key's ordered rows and the alerts left open after them.

    Many rows are taken by runs between normal readings, a few row by row. An
    event with a closing time is a resolution, one without is an opening.
    """
    if len(columns["kind"]) <= FEW_ROWS:
        return _advance_by_row(columns, carried)
    kind, at, value, bound = (columns[c] for c in ("kind", "at", "value", "threshold_value"))
    normal = kind == 0
    run = np.cumsum(normal) - normal
    closings = np.flatnonzero(normal)
    events, left = [], {}
    for k in carried:
        open_runs = {0: carried[k]} if carried[k] else {}
        hits = np.flatnonzero(kind == k)
        if len(hits):
            numbers, first = np.unique(run[hits], return_index=True)
            final = np.append(first[1:], len(hits)) - 1
            for r, a, e in zip(numbers.tolist(), hits[first].tolist(), hits[final].tolist()):
                slot = open_runs.get(r)
                if slot is None:
                    slot = [int(at[a]), float(value[a]), float(bound[a])]
                    events.append((a, [k, *slot, int(at[a]), float(value[a]), None]))
                open_runs[r] = [*slot[:3], int(at[e]), float(value[e])]
        for r, slot in open_runs.items():
            if r < len(closings):
                closing = int(closings[r])
                events.append((closing, [k, *slot, int(at[closing])]))
            else:
                left[k] = slot
    events.sort(key=lambda e: e[0])
    return [e for _, e in events], {k: left.get(k) for k in carried}


def _advance_by_row(columns: dict, carried: dict) -> tuple[list, dict]:
    left, events = dict(carried), []
    for kind, at, value, bound in zip(*(columns[c].tolist() for c in ("kind", "at", "value", "threshold_value"))):
        if kind == 0:
            events += [[k, *slot, int(at)] for k, slot in left.items() if slot]
            left = dict.fromkeys(left)
        elif left[kind]:
            left[kind] = [*left[kind][:3], int(at), value]
        else:
            left[kind] = [int(at), value, bound, int(at), value]
            events.append([kind, *left[kind], None])
    return events, left


def alert_stream(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Opened and resolved alert events of a stream of readings (append mode).

    The rows of a batch in a key's bucket meet in one task, so give the source a limit
    (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
    """
    kind = F.when(F.col("kind") == "min", 1).when(F.col("kind") == "max", 2).otherwise(0)
    numeric = evaluate_stream(readings, thresholds).select(
        F.to_json(F.struct(*ALERT_KEY)).alias("packed"), F.unix_micros("ts").alias("at"), "msg_id", "value", kind.alias("kind"), "threshold_value"
    )
    bucketed = numeric.withColumn("bucket", F.pmod(F.xxhash64("packed"), F.lit(BUCKETS)))
    events = bucketed.groupBy("bucket").applyInPandasWithState(update_alerts, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    times = ("opened_at", "timestamp", "resolved_at")
    return finish_alerts(
        events.select(
            F.from_json("packed", KEY_SCHEMA).alias("key"),
            F.when(F.col("resolved_at").isNull(), F.lit("opened")).otherwise(F.lit("resolved")).alias("event"),
            F.when(F.col("kind") == 1, F.lit("min")).otherwise(F.lit("max")).alias("threshold_type"),
            *[F.timestamp_micros(n).alias(n) if n in times else F.col(n) for n in (*NAMES, "resolved_at")],
        ).select("key.*", "event", "threshold_type", *NAMES, "resolved_at")
    )


def emit_alert_events(readings: DataFrame, thresholds: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes each alert event once, as soon as its batch is done; never throttled."""
    writer = alert_stream(readings, thresholds).writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
