"""Export and import of projects and sessions.

A bundle is a folder with ``messages``, ``sessions`` and a one-row
``manifest`` as JSON lines, so that it can be written and read in parallel.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.sources.messages import write_messages


class BundleError(ValueError):
    """A bundle that cannot be imported."""


def export_project(messages: DataFrame, sessions: DataFrame, project: str, path: str) -> None:
    """Writes the messages and sessions of a project and a manifest."""
    m = messages.filter(F.col("project_id") == project)
    m.write.mode("overwrite").json(f"{path}/messages")
    sessions.filter(F.col("project_id") == project).write.mode("overwrite").json(f"{path}/sessions")
    manifest = m.agg(F.count(F.lit(1)).alias("total_messages")).select(
        F.lit(project).alias("project_id"), F.current_timestamp().alias("exported_at"), "total_messages"
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def partition_folder(project: str) -> str:
    """The folder name that the writer gives a project's partition; one path element, whatever the id holds."""
    if not project or project in (".", ".."):
        raise BundleError(f"project id {project!r} names no partition")
    # The characters that the writer escapes.
    special = set('"#%\'*/:=?\\\x7f{[]^')
    return "project_id=" + "".join(f"%{ord(c):02X}" if c in special or ord(c) < 32 else c for c in project)


class _Folders:
    """Folders of a store that Spark reads: whether one is there, renaming and removing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        store, target = self._at(path)
        return store.exists(target)

    def remove(self, path: str) -> bool:
        store, target = self._at(path)
        return store.delete(target, True)

    def rename(self, old: str, new: str) -> None:
        store, source = self._at(old)
        target = self._at(new)[1]
        store.mkdirs(target.getParent())
        if not store.rename(source, target):
            raise BundleError(f"{old} can't be renamed to {new}")


def read_bundle(spark: SparkSession, path: str, message_schema, session_schema) -> tuple[DataFrame, DataFrame, str]:
    """Messages, sessions and project id of a bundle."""
    folders = _Folders(spark)
    missing = [p for p in ("messages", "sessions", "manifest") if not folders.exists(f"{path}/{p}")]
    if missing:
        raise BundleError(f"bundle lacks {', '.join(missing)}")
    head = spark.read.schema("project_id string, total_messages long").json(f"{path}/manifest").first()
    if head is None or head.project_id is None:
        raise BundleError("bundle names no project")
    return (
        spark.read.schema(message_schema).json(f"{path}/messages"),
        spark.read.schema(session_schema).json(f"{path}/sessions"),
        head.project_id,
    )


def drop_project(spark: SparkSession, table_path: str, project: str) -> bool:
    """Removes the partition of a project from a table on storage."""
    return _Folders(spark).remove(f"{table_path}/{partition_folder(project)}")


def _switch(spark: SparkSession, table_path: str, staged: str, replaced: str, project: str) -> None:
    """Puts the staged partition of a project, or none, where the old one was; the old one moves to ``replaced``."""
    folders, own = _Folders(spark), partition_folder(project)
    if folders.exists(f"{table_path}/{own}"):
        folders.rename(f"{table_path}/{own}", f"{replaced}/{own}")
    try:
        if folders.exists(f"{staged}/{own}"):
            folders.rename(f"{staged}/{own}", f"{table_path}/{own}")
    except Exception:
        if folders.exists(f"{replaced}/{own}"):
            folders.rename(f"{replaced}/{own}", f"{table_path}/{own}")
        raise


def import_project(spark: SparkSession, path: str, messages_path: str, sessions_path: str, message_schema, session_schema) -> str:
    """Replaces the data of the bundle's project; running it again gives the same result.

    The new rows are written beside each table, in a folder that readers skip,
    and both are complete before anything changes. Then each partition is
    switched by renames. Whatever fails before leaves the project as it was; a
    switch that fails puts the old partition back.
    """
    messages, sessions, project = read_bundle(spark, path, message_schema, session_schema)
    partition_folder(project)
    name = os.urandom(6).hex()
    beside = [(table, f"{table.rstrip('/')}/_import-{name}", f"{table.rstrip('/')}/_replaced-{name}") for table in (messages_path, sessions_path)]
    folders = _Folders(spark)
    try:
        write_messages(messages.withColumn("project_id", F.lit(project)), beside[0][1])
        sessions.withColumn("project_id", F.lit(project)).write.partitionBy("project_id").parquet(beside[1][1])
        done = []
        try:
            for table, staged, replaced in beside:
                _switch(spark, table, staged, replaced, project)
                done.append((table, staged, replaced))
        except Exception:
            for table, staged, replaced in done:  # both tables change, or none
                _switch(spark, table, replaced, staged, project)
            raise
        for _, _, replaced in beside:
            folders.remove(replaced)
    finally:
        for _, staged, replaced in beside:
            folders.remove(staged)
            if not folders.exists(f"{replaced}/{partition_folder(project)}"):
                folders.remove(replaced)
    return project


def import_session(messages: DataFrame, sessions: DataFrame, bundle_messages: DataFrame, bundle_sessions: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a bundled session added under a fresh session id.

    Its messages get fresh ids: ``msg_id`` goes on behind the largest one of
    the table, in the order that the bundle's had, so that no message of the
    table shares it and ties in time keep their order.
    """
    for df, needed in ((bundle_messages, "msg_id"), (bundle_sessions, "session_id")):
        if needed not in df.columns:
            raise BundleError(f"bundle lacks {needed}")
    last = F.coalesce(messages.agg(F.max("msg_id")).scalar(), F.lit(-1))
    shift = last + 1 - bundle_messages.agg(F.min("msg_id")).scalar()
    fresh = bundle_messages.withColumns({"session_id": F.lit(session), "msg_id": F.col("msg_id") + shift})
    if "id" in fresh.columns:
        fresh = fresh.withColumn("id", F.concat(F.lit("msg_"), F.sha2(F.concat_ws("|", F.lit(session), "id"), 256)))
    renamed = bundle_sessions.withColumn("session_id", F.lit(session))
    return messages.unionByName(fresh.select(*messages.columns)), sessions.unionByName(renamed.select(*sessions.columns))


def export_session(messages: DataFrame, sessions: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Messages and session row of one session."""
    return tuple(df.filter(F.col("session_id") == session) for df in (messages, sessions))
