"""Text documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

ENDINGS = "*.{[tT][xX][tT],[mM][dD]}"
#: The same endings as a regular expression.
NAMES = re.compile(r".*\.([tT][xX][tT]|[mM][dD])", re.DOTALL)
#: Bytes and files that leave a task at once, and files of a folder that is written.
BATCH_BYTES, BATCH_FILES, FOLDER_FILES = 8 << 20, 1000, 1000
#: Read tasks for each core, as documents differ in size.
TASKS_PER_CORE = 8


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it lies in the local file system and is no pattern, else NULL."""
    if re.search(r"[{}\[\]*?\\]", path):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(target).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _is_seen(name: str, folder: bool) -> bool:
    """Whether Spark's file sources read a file, or look into a folder, of that name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the documents at or below the given folders; with ``deep`` false only of those right in them."""

    def packed(paths: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], ["path"])

    found = []
    for batch in batches:
        folders = [(r["path"], r["deep"]) for r in batch.to_pylist()]
        while folders:
            folder, deep = folders.pop()
            with os.scandir(folder) as entries:
                for e in entries:
                    name = os.fsdecode(e.name)
                    if e.is_dir():
                        folders += [(e.path, True)] if deep and _is_seen(name, True) else []
                    elif NAMES.fullmatch(name) and _is_seen(name, False) and e.is_file():
                        found.append(e.path)
                        if len(found) == BATCH_FILES:
                            yield packed(found)
                            found = []
    yield packed(found)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and bytes of the files, a bounded number of bytes at once."""

    def packed(paths: list, contents: list) -> pa.RecordBatch:
        columns = [pa.array(paths, pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["path", "length", "content"])

    paths, contents, size = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                content = f.read()
            if paths and size + len(content) > BATCH_BYTES or len(paths) == BATCH_FILES:
                yield packed(paths, contents)
                paths, contents, size = [], [], 0
            paths.append(os.fsdecode(path).encode(errors="replace").decode())
            contents.append(content)
            size += len(content)
    yield packed(paths, contents)


def _local_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, content`` of the documents below a folder that all tasks can open.

    Tasks list the folders, and the paths are dealt out by hash. Spark's own
    source keeps every file's status on the driver and plans a task for a few
    files each, which doesn't fit millions of small documents.
    """
    with os.scandir(folder) as entries:
        below = [os.fsencode(e.path) for e in entries if e.is_dir() and _is_seen(e.name, True)]
    cores = spark.sparkContext.defaultParallelism
    rows = [(os.fsencode(folder), False), *((path, True) for path in below)]
    folders = spark.createDataFrame(rows, "path binary, deep boolean").repartition(min(len(rows), cores * TASKS_PER_CORE), "path")
    paths = folders.mapInArrow(_walk, "path binary").repartition(cores * TASKS_PER_CORE, "path")
    return paths.mapInArrow(_contents, "path string, length long, content binary")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``.txt`` and ``.md`` files as one text element each.

    Bytes are UTF-8, or Latin-1 where they are not valid UTF-8. Files without
    any text give no element.
    """
    folder = local_folder(spark, path)
    if folder is not None and os.path.isdir(folder):
        files = _local_files(spark, folder)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", ENDINGS).option("recursiveFileLookup", True).load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size"),
        text.alias("text"),
        F.lit(0).alias("element_no"),
        F.lit("NarrativeText").alias("element_type"),
        F.lit(None).cast("int").alias("page_number"),
    ).filter(F.col("text").rlike(r"\S"))


def write_documents(texts: DataFrame, path: str) -> None:
    """Writes each text of a one-column table as a ``.txt`` file that ends with a newline, as uploads arrive.

    On a local file system tasks write the files themselves, in folders of
    bounded size, and a task's folder gets its name when it is complete.
    Elsewhere Spark's writer does.
    """
    folder = local_folder(texts.sparkSession, path)
    if folder is None:
        files = texts.write.option("maxRecordsPerFile", 1)
        files.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        begun, n = f"{folder}/_begun-{uuid4().hex}", 0
        for batch in batches:
            for text in batch.column(0):
                if n % FOLDER_FILES == 0:
                    os.makedirs(into := f"{begun}/{n // FOLDER_FILES:06d}")
                with open(f"{into}/{n:09d}.txt", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
        if n:
            try:
                os.rename(begun, final)
            except OSError:
                # another attempt of this task has finished; what begins with _ is not read
                if not os.path.isdir(final):
                    raise
        yield pa.RecordBatch.from_pydict({"n": [n]})

    os.makedirs(folder)
    texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
