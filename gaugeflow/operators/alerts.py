"""Threshold alerts in batch: matching, breaches, episodes and their reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.joins import join_keys
from gaugeflow.functions.timeranges import latest
from gaugeflow.functions.topics import as_col, topic_leaf
from gaugeflow.session import work_folder

ALERT_KEY = ["project_id", "equipment_id", "sensor_type", "topic"]
KINDS = ("min", "max")
HISTORY_LIMIT = 1000


# --- single readings -------------------------------------------------------


def evaluate_breach(value, low, high) -> Column:
    """``min``, ``max`` or NULL; bounds are strict and a NULL bound is ignored."""
    value, low, high = as_col(value), as_col(low), as_col(high)
    return F.when(value < low, F.lit("min")).when(value > high, F.lit("max"))


def severity(value, threshold) -> Column:
    """``critical`` beyond 20 % of the threshold; a negative threshold is always critical."""
    value, threshold = as_col(value), as_col(threshold)
    return F.when(F.abs(value - threshold) > threshold * F.lit(0.2), F.lit("critical")).otherwise(F.lit("warning"))


def alert_message(sensor, value, threshold, kind) -> Column:
    title = F.initcap(F.replace(as_col(sensor), F.lit("_"), F.lit(" ")))
    side = F.when(as_col(kind) == "max", F.lit("above")).otherwise(F.lit("below"))
    return F.format_string("%s is %s threshold: %.2f (threshold: %.2f)", title, side, as_col(value), as_col(threshold))


# --- thresholds ------------------------------------------------------------


def index_thresholds(thresholds: DataFrame) -> DataFrame:
    """One threshold per project and topic: the last definition, at the position of the first."""
    rest = [c for c in thresholds.columns if c not in ("project_id", "topic_name", "ord")]
    return (
        thresholds.groupBy("project_id", "topic_name")
        .agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("t"))
        .select("project_id", "topic_name", "ord", "t.*")
    )


def with_threshold(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``_t``, the first matching threshold of each row's project and topic, NULL if none matches.

    A threshold matches its exact topic, or any topic that ends in ``/`` and
    its sensor type. Of all suffix matches only the first in order can win, so
    both rules are equi joins with a small table, and the rows are read once.
    """
    chosen = F.struct("ord", "sensor_type", "min_value", "max_value", "enabled")
    indexed = index_thresholds(thresholds)
    exact = indexed.select("project_id", F.col("topic_name").alias("topic"), chosen.alias("_exact"))
    suffix = indexed.groupBy("project_id", F.col("sensor_type").alias("_leaf")).agg(F.min(chosen).alias("_suffix"))
    leaf = F.when(F.col("topic").contains("/"), topic_leaf("topic"))
    return (
        rows.withColumn("_leaf", leaf)
        .join(exact, ["project_id", "topic"], "left")
        .join(suffix, ["project_id", "_leaf"], "left")
        .select(*rows.columns, F.least("_exact", "_suffix").alias("_t"))
    )


def match_threshold(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings with their threshold, as long as it is enabled."""
    matched = with_threshold(readings, thresholds).filter(F.coalesce("_t.enabled", F.col("_t").isNotNull()))
    return matched.select(*readings.columns, "_t.ord", "_t.min_value", "_t.max_value")


def evaluate_readings(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Numeric readings under an enabled threshold with ``kind`` and ``threshold_value``."""
    numeric = readings.filter(F.col("value").isNotNull()).select(*ALERT_KEY, "ts", "msg_id", "value")
    kind = evaluate_breach("value", "min_value", "max_value")
    return (
        match_threshold(numeric, thresholds)
        .withColumn("kind", kind)
        .withColumn("threshold_value", F.when(F.col("kind") == "min", F.col("min_value")).when(F.col("kind") == "max", F.col("max_value")))
        .drop("min_value", "max_value", "ord")
    )


# --- episodes --------------------------------------------------------------


def _runs_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range of the readings in order of key and time, and the normal readings of each key in it.

    A run ends with a normal reading; its number is that of the normal
    readings of its key before it in this range. Runs without a breach are left
    out, but for the first of a batch, which may close one that began earlier.
    """
    part, last, carried = TaskContext.get().partitionId(), None, 0

    def total(packed: list, normals: list) -> pa.RecordBatch:
        size = len(packed)
        columns = {"packed": pa.array(packed, pa.string()), "part": pa.array([part] * size, pa.int32()), "normals": pa.array(normals, pa.int64())}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    schema = None
    for batch in batches:
        n = len(batch)
        if schema is None:
            at, number, value = (batch.schema.field(c).type for c in ("at", "msg_id", "value"))
            opening = [("at", at), ("id", number), ("value", value), ("threshold", value)]
            slots = [(f"{k}_open_{x}", t) for k in KINDS for x, t in opening] + [(f"{k}_last_{x}", t) for k in KINDS for x, t in opening[:3]]
            schema = pa.schema([("packed", pa.string()), ("part", pa.int32()), ("normals", pa.int64()), ("run", pa.int64()), *slots, *[(f"{k}_n", pa.int64()) for k in KINDS], ("closing_at", at), ("closing_id", number)])
        if not n:
            continue
        keys = batch.column("packed").dictionary_encode()
        code, names = keys.indices.to_numpy(), keys.dictionary
        kind = batch.column("kind").to_numpy()
        new = np.append(True, code[1:] != code[:-1])
        firsts, group = np.flatnonzero(new), np.cumsum(new) - 1
        first_name = names[int(code[0])].as_py()
        if last is not None and first_name != last:
            yield total([last], [carried])
            carried = 0
        normal = kind == 0
        before = np.cumsum(normal) - normal
        run = before - before[firsts][group] + np.where(group == 0, carried, 0)
        ended = run[np.append(firsts[1:] - 1, n - 1)] + normal[np.append(firsts[1:] - 1, n - 1)]
        if len(firsts) > 1:
            yield total(names.take(pa.array(code[firsts[:-1]])).to_pylist(), ended[:-1].tolist())
        last, carried = names[int(code[-1])].as_py(), int(ended[-1])

        starts = np.flatnonzero(new | np.append(True, normal[:-1]))
        ends = np.append(starts[1:], n) - 1
        place = np.arange(n)
        found = {}
        for k, name in enumerate(KINDS, 1):
            hit = kind == k
            found[name] = (np.minimum.reduceat(np.where(hit, place, n), starts), np.maximum.reduceat(np.where(hit, place, -1), starts), np.add.reduceat(hit.astype(np.int64), starts))
        keep = np.flatnonzero((np.sum([f[2] for f in found.values()], axis=0) > 0) | (starts == 0))

        def taken(column: str, rows: np.ndarray, there: np.ndarray) -> pa.Array:
            return batch.column(column).take(pa.array(np.where(there, rows, 0), pa.int64(), mask=~there))

        columns = {"packed": batch.column("packed").take(pa.array(starts[keep])), "part": pa.array(np.full(len(keep), part), pa.int32()), "normals": pa.nulls(len(keep), pa.int64()), "run": pa.array(run[starts[keep]], pa.int64())}
        for name, (opened, newest, count) in found.items():
            there = count[keep] > 0
            for slot, column in (("at", "at"), ("id", "msg_id"), ("value", "value"), ("threshold", "threshold_value")):
                columns[f"{name}_open_{slot}"] = taken(column, opened[keep], there)
                columns[f"{name}_last_{slot}"] = taken(column, newest[keep], there)
            columns[f"{name}_n"] = pa.array(count[keep], pa.int64())
        for slot, column in (("at", "at"), ("id", "msg_id")):
            columns[f"closing_{slot}"] = taken(column, ends[keep], normal[ends[keep]])
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
    if last is not None:
        yield total([last], [carried])


def alert_episodes(readings: DataFrame, thresholds: DataFrame, partitions: int | None = None) -> DataFrame:
    """Alert episodes of every project, equipment, sensor and topic.

    The first breach of a kind opens an episode, further ones update its time
    and value, and the next normal reading closes all open ones. A run is
    numbered by the normal readings before it, by a prefix sum on two levels:
    the readings are dealt into ranges of key, time and message of about equal
    rows, so that neither a busy key nor many readings of one instant stand in
    one task; each range is walked once and gives its runs and the normal
    readings of each key; sums of these, one for each key and range, shift the
    ranges' numbers, and runs that cross ranges meet in an aggregation.
    ``partitions`` is the number of ranges, else the session decides.
    """
    rows = evaluate_readings(readings, thresholds)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    number = F.coalesce(F.when(F.col("kind") == "min", 1).when(F.col("kind") == "max", 2), F.lit(0))
    packed = rows.select(F.to_json(F.struct(*ALERT_KEY)).alias("packed"), micros.alias("at"), "msg_id", "value", number.alias("kind"), "threshold_value")
    order = ["packed", "at", "msg_id"]
    ranges = packed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    ids, numbers = rows.schema["msg_id"].dataType.simpleString(), rows.schema["value"].dataType.simpleString()
    opening = f"at long, id {ids}, value {numbers}, threshold {numbers}".split(", ")
    slots = [f"{k}_open_{x}" for k in KINDS for x in opening] + [f"{k}_last_{x}" for k in KINDS for x in opening[:3]]
    layout = f"packed string, part int, normals long, run long, {', '.join(slots)}, {', '.join(f'{k}_n long' for k in KINDS)}, closing_at long, closing_id {ids}"
    staged = work_folder(readings.sparkSession, "runs")
    ranges.mapInArrow(_runs_in_order, layout).write.parquet(staged)
    pieces = readings.sparkSession.read.schema(layout).parquet(staged)

    # One row for each key and range that holds it.
    before = W.partitionBy("packed").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.filter("normals IS NOT NULL").select("packed", "part", F.coalesce(F.sum("normals").over(before), F.lit(0)).alias("shift"))
    opened = {k: F.when(F.col(f"{k}_n") > 0, F.struct(*[F.col(f"{k}_open_{x}").alias(x) for x in ("at", "id", "value", "threshold")])) for k in KINDS}
    newest = {k: F.when(F.col(f"{k}_n") > 0, F.struct(*[F.col(f"{k}_last_{x}").alias(x) for x in ("at", "id", "value")])) for k in KINDS}
    closing = F.when(F.col("closing_at").isNotNull(), F.struct(F.col("closing_at").alias("at"), F.col("closing_id").alias("id")))
    runs = (
        pieces.filter("normals IS NULL")
        .join(shifts, ["packed", "part"])
        .groupBy("packed", (F.col("run") + F.col("shift")).alias("run"))
        .agg(
            *[F.min(opened[k]).alias(f"{k}_open") for k in KINDS],
            *[F.max(newest[k]).alias(f"{k}_last") for k in KINDS],
            *[F.sum(f"{k}_n").alias(f"{k}_n") for k in KINDS],
            F.min(closing).alias("closing"),
        )
        .withColumn("key", F.from_json("packed", ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ALERT_KEY)))
        .select("key.*", *[f"{k}_{x}" for k in KINDS for x in ("open", "last", "n")], "closing")
    )
    episode = F.explode(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(k).alias("threshold_type"), F.col(f"{k}_open").alias("o"), F.col(f"{k}_last").alias("l"), F.col(f"{k}_n").alias("breaches"))
                    for k in ("min", "max")
                ]
            ),
            lambda e: e["o"].isNotNull(),
        )
    )
    kept = rows.schema["ts"].dataType.simpleString()
    instant = lambda c: F.timestamp_micros(c).cast(kept)
    return finish_alerts(
        runs.select(*ALERT_KEY, "closing", episode.alias("e")).select(
            *ALERT_KEY,
            "e.threshold_type",
            "e.breaches",
            instant("e.o.at").alias("opened_at"),
            F.col("e.o.value").alias("opened_value"),
            F.col("e.o.threshold").alias("threshold_value"),
            instant("e.l.at").alias("timestamp"),
            F.col("e.l.value").alias("current_value"),
            instant("closing.at").alias("resolved_at"),
            F.col("closing.id").alias("resolved_msg_id"),
        )
    )


def finish_alerts(episodes: DataFrame) -> DataFrame:
    """Adds id, severity, message and the resolved flag to bare episodes."""
    return (
        episodes.withColumn("alert_id", F.concat_ws("_", "project_id", "equipment_id", "sensor_type", "threshold_type"))
        .withColumn("severity", severity("opened_value", "threshold_value"))
        .withColumn("message", alert_message("sensor_type", "opened_value", "threshold_value", "threshold_type"))
        .withColumn("resolved", F.col("resolved_at").isNotNull())
    )


# --- reports ---------------------------------------------------------------


def active_alerts(episodes: DataFrame, equipment: str | None = None) -> DataFrame:
    rows = episodes.filter(~F.col("resolved"))
    rows = rows if equipment is None else rows.filter(F.col("equipment_id") == equipment)
    return rows.orderBy(F.desc("timestamp"), "alert_id", "topic")


def newest_resolved(episodes: DataFrame, n: int) -> DataFrame:
    """The last ``n`` resolved alerts in the order they were resolved."""
    order = [F.desc("resolved_at"), F.desc("resolved_msg_id"), F.desc("alert_id"), F.desc("topic")]
    return episodes.filter("resolved").orderBy(*order).limit(n)


def cap_history(episodes: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    return newest_resolved(episodes, n)


def alert_history(episodes: DataFrame, limit: int = 50, equipment: str | None = None) -> DataFrame:
    """Last ``limit`` resolved alerts (all for 0 or less), then the equipment filter."""
    rows = newest_resolved(episodes, limit) if limit > 0 else episodes.filter("resolved")
    rows = rows if equipment is None else rows.filter(F.col("equipment_id") == equipment)
    return rows.orderBy(F.desc("resolved_at"), "alert_id", "topic")


def clear_resolved(episodes: DataFrame, older_than_hours: int = 24, as_of: Column | None = None) -> DataFrame:
    """History that is kept: resolved after the cut-off."""
    history = episodes.filter("resolved")
    as_of = latest(episodes, "resolved_at") if as_of is None else as_of
    return history.filter(F.coalesce("resolved_at", "timestamp") > as_of - F.make_dt_interval(hours=F.lit(older_than_hours)))


def alert_stats(episodes: DataFrame) -> DataFrame:
    """Active and resolved counts, active ones by severity and the most recent active alert."""
    active = ~F.col("resolved")
    newest = F.max_by(F.when(active, F.col("alert_id")), F.when(active, F.struct("timestamp", "alert_id", "topic")))
    return episodes.agg(
        F.count_if(active).alias("active_alerts"),
        F.count_if(F.col("resolved")).alias("historical_alerts"),
        F.count_if(active & (F.col("severity") == "warning")).alias("warning"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical"),
        newest.alias("most_recent_alert"),
    )


# --- threshold changes -----------------------------------------------------


#: Order numbers of created thresholds begin behind those of the table.
CREATED_FROM = 1 << 40


def apply_threshold_changes(thresholds: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thresholds after an ordered change log, and the outcome of every change.

    ``log`` has ``ord, op, project_id, id, topic_name, min_value, max_value,
    enabled`` with op create, update, toggle or delete. An id lives from an
    accepted create, or from the start, to the next delete, and may be created
    again. Changes to an id that doesn't live, creates of one that does, and
    updates without a bound are rejected. The state of a life follows from
    aggregates (last accepted bounds, last explicit switch and the number of
    toggles after it). The first table has the layout of ``thresholds``;
    created thresholds come behind the ones that were there, by ``place`` and
    by ``ord``.
    """
    key, lives = ["project_id", "id"], ["project_id", "id", "life"]
    start = F.lit(-1).cast("bigint")
    creates, deletes = F.col("op") == "create", F.col("op") == "delete"
    named = F.coalesce("topic_name", F.lit("")) != ""
    before = W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    alive = F.coalesce(F.last(F.when(creates & named, True).when(deletes, False), ignorenulls=True).over(before), "_there", F.lit(False))
    outcome = (
        F.when(creates & ~named, F.lit("topic_name is required"))
        .when(creates & F.col("_alive"), F.lit("threshold exists"))
        .when(creates, F.lit("ok"))
        .when(~F.col("_alive"), F.lit("threshold not found"))
        .when((F.col("op") == "update") & F.col("min_value").isNull() & F.col("max_value").isNull(), F.lit("a bound is required"))
        .otherwise(F.lit("ok"))
    )
    there = thresholds.select(*key).distinct().withColumn("_there", F.lit(True))
    checked = join_keys(log, there, key, "left").withColumn("_alive", alive).withColumn("outcome", outcome)
    born = F.count_if(creates & (F.col("outcome") == "ok")).over(before.rowsBetween(W.unboundedPreceding, 0))
    accepted = checked.withColumn("life", born).filter("outcome = 'ok'")

    columns = [*lives, "ord", "place", "topic_name", "sensor_type", "min_value", "max_value", F.coalesce("enabled", F.lit(True)).alias("enabled")]

    def placed(rows, part):
        return rows.withColumn("place", F.struct(F.lit(part).alias("part"), F.col("ord").alias("at")))

    created = placed(accepted.filter(creates).withColumn("sensor_type", topic_leaf("topic_name")), 1)
    created = created.withColumn("ord", F.lit(CREATED_FROM) + F.col("ord"))
    initial = placed(thresholds.withColumn("life", F.lit(0).cast("bigint")), 0).select(*columns).unionByName(created.select(*columns))
    is_set = (F.col("op") == "update") & F.col("enabled").isNotNull()
    updates = accepted.groupBy(*lives).agg(
        F.max_by(F.when(F.col("op") == "update", F.struct("min_value", "max_value")), F.when(F.col("op") == "update", F.col("ord"))).alias("bounds"),
        F.max_by(F.when(is_set, F.col("enabled")), F.when(is_set, F.col("ord"))).alias("switch"),
        F.max(F.when(is_set, F.col("ord"))).alias("switched_at"),
        F.coalesce(F.bool_or(deletes), F.lit(False)).alias("ended"),
    )
    toggles = (
        join_keys(accepted.filter("op = 'toggle'"), updates.select(*lives, "switched_at"), lives)
        .filter(F.col("ord") > F.coalesce("switched_at", start))
        .groupBy(*lives)
        .agg(F.count(F.lit(1)).alias("toggles"))
    )
    state = join_keys(join_keys(initial, updates, lives, "left"), toggles, lives, "left")
    state = state.filter(~F.coalesce("ended", F.lit(False)))
    switched = F.coalesce("switch", "enabled")
    odd = F.coalesce(F.col("toggles"), F.lit(0)) % 2 == 1
    result = state.select(
        *key,
        "ord",
        "place",
        "topic_name",
        "sensor_type",
        F.when(F.col("bounds").isNull(), F.col("min_value")).otherwise(F.col("bounds.min_value")).alias("min_value"),
        F.when(F.col("bounds").isNull(), F.col("max_value")).otherwise(F.col("bounds.max_value")).alias("max_value"),
        F.when(odd, ~switched).otherwise(switched).alias("enabled"),
    )
    return result, checked.select(*log.columns, "outcome")
