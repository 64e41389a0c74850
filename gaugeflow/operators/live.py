"""Latest values, node status, graph snapshots and update throttling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.joins import join_keys
from gaugeflow.functions.timeranges import time_slice
from gaugeflow.session import work_folder


def latest_readings(readings: DataFrame) -> DataFrame:
    """Newest reading per equipment and sensor.

    ``max_by`` combines before the shuffle, so one row per key and task moves.
    Works on streams as well (update or complete mode).
    """
    rest = [c for c in readings.columns if c not in ("equipment_id", "sensor_type")]
    return (
        readings.groupBy("equipment_id", "sensor_type")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "msg_id")).alias("r"))
        .select("equipment_id", "sensor_type", "r.*")
    )


def node_status(latest: DataFrame, layout: DataFrame) -> DataFrame:
    """Layout nodes with their sensors, ``active`` if there is any, else ``idle``.

    Equipment outside the layout is left out. ``latest`` has one row per
    equipment and sensor.
    """
    sensor = F.struct("sensor_type", "value", "unit", F.col("ts").alias("timestamp"), "status")
    grouped = latest.groupBy("equipment_id").agg(F.array_sort(F.collect_list(sensor)).alias("sensors"), F.max("ts").alias("last_updated"))
    none = F.array().cast(grouped.schema["sensors"].dataType)
    return layout.join(grouped, "equipment_id", "left").select(
        *layout.columns,
        F.coalesce("sensors", none).alias("sensors"),
        F.when(F.col("sensors").isNotNull(), F.lit("active")).otherwise(F.lit("idle")).alias("node_status"),
        "last_updated",
    )


def valid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.coalesce("id", F.lit("")) != "")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with id, source and target; empty texts do not count."""
    condition = F.lit(True)
    for name in ("id", "source", "target"):
        condition = condition & (F.coalesce(name, F.lit("")) != "")
    return edges.filter(condition)


def graph_snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of the graph as JSON, one row per node or edge.

    The parts of a snapshot stay rows; only a writer that pushes a layout to
    one client puts them together.
    """
    n = nodes.select(F.lit("node").alias("part"), "id", F.to_json(F.struct(*nodes.columns)).alias("body"))
    e = edges.select(F.lit("edge").alias("part"), "id", F.to_json(F.struct(*edges.columns)).alias("body"))
    return n.unionByName(e)


def snapshot_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, last update and the flag for a non-empty graph."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max("last_updated").alias("last_updated"))
    return n.select(
        "nodes", edges.agg(F.count(F.lit(1))).scalar().alias("edges"), "last_updated", (F.col("nodes") > 0).alias("first_message")
    )


# --- throttling ------------------------------------------------------------


def _next_allowed(times: np.ndarray, interval: int) -> np.ndarray:
    """Index of the first update at least ``interval`` after each one."""
    return np.searchsorted(times, times + interval, side="left")


def _exits(times: np.ndarray, interval: int) -> np.ndarray:
    """Last passing time of the chain that starts at each update, by pointer doubling."""
    n = len(times)
    jump = np.append(_next_allowed(times, interval), n)
    last = np.arange(n + 1)
    step = jump.copy()
    while (step[:n] < n).any():
        last = np.where(step < n, last[np.minimum(step, n)], last)
        step = step[step]
    return times[last[:n]]


#: Slices of one group are so many children of the tree: 1 << FAN_BITS.
FAN_BITS = 6


def _follow(allowed: int, starts: list[np.ndarray], leaves: list[np.ndarray], interval: int) -> tuple[list[int], int | None]:
    """The entry time of each of some neighbouring step functions, and the last passing time, None if nothing passes."""
    entries, last = [], None
    for start, leave in zip(starts, leaves):
        entries.append(allowed)
        at = int(np.searchsorted(start, allowed, side="left"))
        if at < len(start):
            last = int(leave[at])
            allowed = last + interval
    return entries, last


def _children(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Slice numbers and step functions of one group in order."""
    pdf = pdf.sort_values(["slice", "start"])
    slices, firsts = np.unique(pdf["slice"].to_numpy(), return_index=True)
    return slices, np.split(pdf["start"].to_numpy(), firsts[1:]), np.split(pdf["leave"].to_numpy(), firsts[1:])


def throttle(updates: DataFrame, interval_seconds: float = 0.5, by: str = "project_id", slice_seconds: int = 600) -> DataFrame:
    """Updates that pass when each one must come ``interval_seconds`` after the last that passed.

    The choice is greedy, so it depends on everything before. Each time slice
    is reduced to a step function from "earliest allowed time" to "last passing
    time"; chains merge fast, so it has few steps. Composing neighbours gives
    such a function again, with at most one step more than the first of them,
    so functions are put together as a tree: groups of neighbouring slices,
    then groups of groups. Walking down again, each group hands its children
    their entry times, and at last all slices pick their updates
    independently. No task sees more than one group of children, or one
    slice's updates. Returns ``by, ts, msg_id``.
    """
    interval = int(round(interval_seconds * 1_000_000))
    if interval > slice_seconds * 1_000_000:
        slice_seconds = int(np.ceil(interval_seconds))
    width = slice_seconds * 1_000_000
    rows = updates.select(
        F.col(by).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "msg_id", time_slice("ts", slice_seconds).alias("slice")
    )
    key_type = rows.schema["k"].dataType.simpleString()
    function = f"k {key_type}, slice long, start long, leave long"

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["t"].to_numpy())
        limit = int(pdf["slice"].iloc[0]) * width + interval
        entries = min(int(np.searchsorted(times, limit, side="left")) + 1, len(times))
        exits = _exits(times, interval)[:entries]
        # "first update at or after x" is a step function of x: keep the last time of equal exits
        keep = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame(
            {"k": pdf["k"].iloc[0], "slice": pdf["slice"].iloc[0], "start": times[:entries][keep], "leave": exits[keep]}
        )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        _, starts, leaves = _children(pdf)
        # who comes too late for the first child meets the next one before its first update
        at = [*starts[0].tolist(), *[int(x[0]) for x in starts[1:2]]]
        through = []
        for leave in leaves[0].tolist():
            further = _follow(leave + interval, starts[1:], leaves[1:], interval)[1]
            through.append(leave if further is None else further)
        through += [_follow(int(x[0]), starts[1:], leaves[1:], interval)[1] for x in starts[1:2]]
        keep = np.append(np.array(through[1:]) != np.array(through[:-1]), True)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "slice": pdf["parent"].iloc[0], "start": np.array(at)[keep], "leave": np.array(through)[keep]})

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        slices, starts, leaves = _children(pdf)
        entries, _ = _follow(int(pdf["entry"].iloc[0]), starts, leaves, interval)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "slice": slices, "entry": entries})

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "msg_id"])
        times = pdf["t"].to_numpy()
        follow = _next_allowed(times, interval)
        at, chosen = int(np.searchsorted(times, pdf["entry"].iloc[0], side="left")), []
        while at < len(times):
            chosen.append(at)
            at = int(follow[at])
        return pdf.iloc[chosen][["k", "t", "msg_id"]]

    leaf = _staged(rows.groupBy("k", "slice").applyInPandas(summarize, function))
    first, last = leaf.agg(F.coalesce(F.min("slice"), F.lit(0)), F.coalesce(F.max("slice"), F.lit(0))).first()
    levels, span = [leaf.withColumn("slice", F.col("slice") - first)], (last - first) >> FAN_BITS
    parent = F.shiftright("slice", FAN_BITS)
    while span:
        levels.append(_staged(levels[-1].withColumn("parent", parent).groupBy("k", "parent").applyInPandas(compose, function)))
        span >>= FAN_BITS
    # one group of children is left for each key
    entries = levels[-1].select("k").distinct().select("k", F.lit(0).cast("long").alias("slice"), F.lit(int(np.iinfo(np.int64).min)).alias("entry"))
    for children in reversed(levels):
        met = join_keys(children.withColumn("parent", parent), entries.withColumnRenamed("slice", "parent"), ["k", "parent"])
        entries = met.groupBy("k", "parent").applyInPandas(hand_down, f"k {key_type}, slice long, entry long")
    passed = (
        join_keys(rows, entries.withColumn("slice", F.col("slice") + first), ["k", "slice"])
        .groupBy("k", "slice")
        .applyInPandas(pick, f"k {key_type}, t long, msg_id {rows.schema['msg_id'].dataType.simpleString()}")
    )
    return passed.select(F.col("k").alias(by), F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "msg_id")


def _staged(steps: DataFrame) -> DataFrame:
    """Step functions from files: going up and going down both read them."""
    path = work_folder(steps.sparkSession, "steps")
    steps.write.parquet(path)
    return steps.sparkSession.read.schema(steps.schema).parquet(path)
