"""Recorded messages, sessions and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.joins import join_keys
from gaugeflow.session import work_folder

MESSAGES_PER_PROJECT = 5000
MESSAGES_OVERALL = 10000


def _last(rows: DataFrame, limit: int | None) -> DataFrame:
    if not limit:
        return rows.orderBy("ts", "msg_id")
    return rows.orderBy(F.desc("ts"), F.desc("msg_id")).limit(limit).orderBy("ts", "msg_id")


def project_messages(messages: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    """Messages of a project in arrival order, optionally the last ones only."""
    return _last(messages.filter(F.col("project_id") == project), limit)


def equipment_messages(messages: DataFrame, project: str, equipment: str, limit: int | None = None) -> DataFrame:
    """Messages of an equipment; the limit counts after the equipment filter."""
    return _last(messages.filter((F.col("project_id") == project) & (F.col("equipment_id") == equipment)), limit)


def without_project(table: DataFrame, project: str) -> DataFrame:
    """The table after a project was removed."""
    return table.filter(~F.col("project_id").eqNullSafe(project))


def session_table(events: DataFrame) -> DataFrame:
    """Sessions from start and stop events; an open session has no end."""
    return events.groupBy("project_id", "session_id").agg(
        F.max_by("project_name", F.when(F.col("event") == "start", F.col("ts"))).alias("project_name"),
        F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("start_time"),
        F.max(F.when(F.col("event") == "stop", F.col("ts"))).alias("end_time"),
    ).filter(F.col("start_time").isNotNull())


def session_stats(messages: DataFrame) -> DataFrame:
    """Message count and distinct equipment and sensors per session, in batch or streaming."""
    return messages.groupBy("project_id", "session_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.array_sort(F.collect_set("equipment_id")).alias("equipment_ids"),
        F.array_sort(F.collect_set("sensor_type")).alias("sensor_types"),
    )


#: Rows of a key that one task may put in order; where a bracket holds more it is cut into 1 << BRACKET_BITS parts.
BRACKET_ROWS, BRACKET_BITS = 10_000, 10
LEAST_ID, LARGEST_ID = -(1 << 63), (1 << 63) - 1


def _brackets(counts: DataFrame) -> DataFrame:
    """_key, part, size and left: the part (counted from the newest) with the last row to keep, its rows, and how many of them to keep.

    ``counts`` has ``_key, _part, _n`` and how many rows of a key to keep. A key
    has few parts, which one aggregate puts together. Keys that may keep all
    their rows are left out.
    """
    start = F.struct(F.first("_keep").alias("left"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["part"].isNotNull()
        here = ~done & (x["_n"] >= acc["left"])
        return F.struct(
            F.when(done | here, acc["left"]).otherwise(acc["left"] - x["_n"]).alias("left"),
            F.when(here, x["_part"]).otherwise(acc["part"]).alias("part"),
            F.when(here, x["_n"]).otherwise(acc["size"]).alias("size"),
        )

    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("_part", "_n"))))
    return counts.groupBy("_key").agg(F.aggregate(newest_first, start, step).alias("b")).select("_key", "b.*").filter("part IS NOT NULL")


def _staged(df: DataFrame) -> DataFrame:
    """One narrow row for each key, from files: several steps read them."""
    path = work_folder(df.sparkSession, "brackets")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def retain_last(messages: DataFrame, n: int = MESSAGES_PER_PROJECT, by: str | None = "project_id", slice_seconds: int = 4300) -> DataFrame:
    """The newest ``n`` messages per project, or overall with ``by=None``.

    A selection, no sort: counts per time slice show in which slice the last
    message to keep lies. Where that slice holds more than BRACKET_ROWS
    messages of a project they are counted in finer slices, down to one
    instant, and then by ranges of ``msg_id``. All newer messages stay, and
    only those in the bracket, a bounded number, are put in order. Counts are
    combined before they are shuffled. ``slice_seconds`` is the width of the
    first slices, rounded down to a power of two microseconds; ``msg_id`` is a
    whole number.
    """
    rows = messages.withColumns(
        {"_key": F.lit("all") if by is None else F.col(by), "_at": F.unix_micros(F.col("ts").cast("timestamp")), "_id": F.col("msg_id").cast("long")}
    )
    narrow, bits = rows.select("_key", "_at", "_id"), (slice_seconds * 1_000_000).bit_length() - 1
    levels = [("_at", max(0, bits - down)) for down in range(BRACKET_BITS, bits + BRACKET_BITS, BRACKET_BITS)]
    levels += [("_id", max(0, 64 - down)) for down in range(BRACKET_BITS, 64 + BRACKET_BITS, BRACKET_BITS)]

    def times(part: Column, width: int) -> list[Column]:
        low = F.shiftleft(part, width)
        return [low.alias("_low"), (low + ((1 << width) - 1)).alias("_high"), F.lit(LEAST_ID).alias("_from"), F.lit(LARGEST_ID).alias("_to")]

    def counted(inside: DataFrame, column: str, width: int) -> DataFrame:
        return inside.groupBy("_key", F.shiftright(column, width).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.first("_keep").alias("_keep"))

    first = _brackets(counted(narrow.withColumn("_keep", F.lit(n).cast("long")), "_at", bits))
    state = _staged(first.select("_key", "left", "size", *times(F.col("part"), bits)))
    here = F.col("_at").between(F.col("_low"), F.col("_high")) & F.col("_id").between(F.col("_from"), F.col("_to"))
    for column, width in levels:
        large = state.filter((F.col("size") > BRACKET_ROWS) & (F.col("left") < F.col("size")))
        if not large.limit(1).count():
            break
        inside = join_keys(narrow, large.withColumnRenamed("left", "_keep"), ["_key"]).filter(here)
        found = join_keys(_brackets(counted(inside, column, width)), large.select("_key", "_low", "_high"), ["_key"])
        ids = F.shiftleft("part", width)
        cut = times(F.col("part"), width) if column == "_at" else ["_low", "_high", ids.alias("_from"), (ids + ((1 << width) - 1)).alias("_to")]
        state = _staged(join_keys(state, large.select("_key"), ["_key"], "left_anti").unionByName(found.select("_key", "left", "size", *cut)))

    placed = join_keys(rows, state, ["_key"], "left")
    newer = (F.col("_at") > F.col("_high")) | ((F.col("_at") >= F.col("_low")) & (F.col("_id") > F.col("_to")))
    settled = F.col("size").isNull() | newer | (here & (F.col("left") == F.col("size")))
    order = W.partitionBy("_key", "_low", "_from").orderBy(F.desc("ts"), F.desc("msg_id"))
    last = placed.filter(here & (F.col("left") < F.col("size"))).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("left"))
    return placed.filter(settled).select(*messages.columns).unionByName(last.select(*messages.columns))


def projects_with_data(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects that have messages or sessions; each side is made distinct first."""
    return messages.select("project_id").distinct().union(sessions.select("project_id").distinct()).distinct()


def project_sessions(sessions: DataFrame, project: str) -> DataFrame:
    return sessions.filter(F.col("project_id") == project)


def delete_session(messages: DataFrame, sessions: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session."""
    keep = ~F.col("session_id").eqNullSafe(session)
    return messages.filter(keep), sessions.filter(keep)


def project_counts(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Message and session counts of every project that has either."""
    m = messages.groupBy("project_id").agg(F.count(F.lit(1)).alias("message_count"))
    s = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("session_count"))
    return m.join(s, "project_id", "full_outer").na.fill(0, ["message_count", "session_count"])


def file_sizes(table: DataFrame) -> DataFrame:
    """Bytes per project of a table read from files, each file counted once."""
    return (
        table.select("project_id", "_metadata.file_path", "_metadata.file_size")
        .groupBy("project_id", "file_path")
        .agg(F.max("file_size").alias("bytes"))
        .groupBy("project_id")
        .agg(F.sum("bytes").alias("bytes"))
    )


def storage_stats(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Size in KB and counts per project; both tables must be read straight from files."""
    sizes = file_sizes(messages).union(file_sizes(sessions)).groupBy("project_id").agg(F.sum("bytes").alias("bytes"))
    return project_counts(messages, sessions).join(sizes, "project_id", "left").select(
        "project_id", F.round(F.coalesce("bytes", F.lit(0)) / 1024, 2).alias("size_kb"), "message_count", "session_count"
    )


def storage_totals(stats: DataFrame) -> DataFrame:
    """Number of projects and their storage in MB, from ``storage_stats``."""
    return stats.agg(F.count(F.lit(1)).alias("total_projects"), F.round(F.coalesce(F.sum("size_kb"), F.lit(0.0)) / 1024, 2).alias("total_storage_mb"))


def usage(messages: DataFrame, cap: int = MESSAGES_OVERALL) -> DataFrame:
    """Message count and its share of the cap in percent."""
    return messages.agg(F.count(F.lit(1)).alias("total_messages")).withColumn(
        "usage_percentage", F.round(F.col("total_messages") / cap * 100).cast("bigint")
    )
