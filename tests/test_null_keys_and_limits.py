"""Rows with NULL keys stay, whole days are whole, and odd ids and files are handled."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.dashboard import recent_window
from gaugeflow.operators.knowledge import chunk_documents, chunk_file_types, index_chunks
from gaugeflow.operators.series import percentile, statistics, time_range_absolute
from gaugeflow.operators.storage import retain_last
from gaugeflow.session import work_folder
from gaugeflow.sources.bundles import BundleError, drop_project, partition_folder
from gaugeflow.sources.documents import read_documents
from gaugeflow.sources.thresholds import ThresholdFileError, read_thresholds_csv


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None, "s", i, float(i), f"2024-01-0{1 + i % 2} 23:59:59.5") for i in range(4)] + [("c", "s", 9, 5.0, "2024-01-02 00:00:00")]
    return spark.createDataFrame(data, "cell_id string, subtopic string, msg_id long, reading double, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))


def test_null_groups_have_percentiles(rows):
    assert {r[0]: r[-1] for r in percentile(rows, 0.5).collect()} == {None: 1.5, "c": 5.0}
    assert {r["cell_id"]: r["median_value"] for r in statistics(rows, median=True).collect()} == {None: 1.5, "c": 5.0}


def test_null_projects_are_retained(rows):
    kept = retain_last(rows.withColumnRenamed("cell_id", "project_id"), n=3)
    assert sorted((r["project_id"] or "", r["msg_id"]) for r in kept.collect()) == [("", 1), ("", 2), ("", 3), ("c", 9)]


def test_null_equipment_has_a_window(rows):
    assert recent_window(rows.withColumnRenamed("cell_id", "equipment_id")).where("equipment_id is null").count() == 2


def test_null_documents_are_chunked_and_indexed_once(spark):
    elements = spark.createDataFrame([(None, 0, "one"), (None, 1, "two"), ("d", 0, "three")], "doc_id string, element_no int, text string")
    assert sorted((r["doc_id"] or "", r["chunk_index"], r["text"]) for r in chunk_documents(elements).collect()) == [("", 0, "one"), ("", 1, "two"), ("d", 0, "three")]
    index = spark.createDataFrame([(None, "a"), ("p", "b")], "project_id string, chunk_id string")
    assert index_chunks(index, index).count() == 2


def test_a_day_ends_with_its_last_fraction(rows):
    assert time_range_absolute(rows, "2024-01-01", "2024-01-01").count() == 2
    assert time_range_absolute(rows, "2024-01-01", "2024-01-02").count() == 5


def test_long_extensions_stay_whole(spark):
    ext = "x" * 30
    assert chunk_file_types(spark.createDataFrame([("p", f"a.{ext}")], "project_id string, filename string")).first()["file_type"] == ext


def test_any_spelling_of_the_endings(spark, tmp_path):
    for name in ("a.txt", "b.Md", "c.TXT", "d.tXt", "e.pdf"):
        (tmp_path / name).write_text("text")
    assert {r["filename"] for r in read_documents(spark, str(tmp_path)).collect()} == {"a.txt", "b.Md", "c.TXT", "d.tXt"}


@pytest.mark.parametrize("row", ["t,1d,2", "t,1f,", " ,1,2"])
def test_bad_threshold_rows(spark, tmp_path, row):
    (tmp_path / "t.csv").write_text(f"topic_name,min_value,max_value\n{row}\n")
    with pytest.raises(ThresholdFileError):
        read_thresholds_csv(spark, str(tmp_path / "t.csv"), "p")


@pytest.mark.parametrize("project", ["a:b", "a=b", "a b", "a%b", "x/../../other", "é*"])
def test_only_the_projects_own_partition_goes(spark, tmp_path, project):
    table, other = tmp_path / "deep" / "table", tmp_path / "other"
    other.mkdir()
    spark.createDataFrame([(project, 1), ("kept", 2)], "project_id string, v int").write.partitionBy("project_id").parquet(str(table))
    assert (table / partition_folder(project)).is_dir()
    assert drop_project(spark, str(table), project)
    assert [r["v"] for r in spark.read.parquet(str(table)).collect()] == [2] and other.is_dir()


@pytest.mark.parametrize("project", ["", ".."])
def test_ids_that_name_no_partition(project):
    with pytest.raises(BundleError):
        partition_folder(project)


def test_work_folders_on_a_cluster_need_the_shared_one():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        work_folder(Cluster, "x")


def test_thresholds_live_again(spark):
    from gaugeflow.operators import alerts as A

    base = spark.createDataFrame([("p", "t", 1, "a/x", "x", 1.0, None, True)], "project_id string, id string, ord long, topic_name string, sensor_type string, min_value double, max_value double, enabled boolean")
    changes = [
        (1, "create", "n", "", None, 1.0), (2, "update", "n", None, None, 2.0), (3, "create", "n", "b/y", None, 3.0), (4, "create", "n", "b/z", None, 4.0),
        (5, "delete", "t", None, None, None), (6, "update", "t", None, 9.0, None), (7, "create", "t", "c/z", 5.0, None), (8, "toggle", "t", None, None, None),
        (9, "delete", "n", None, None, None), (10, "delete", "n", None, None, None), (11, "create", "n", "d/q", None, 6.0), (12, "update", "n", None, 0.5, 7.0),
    ]
    log = spark.createDataFrame([(o, op, "p", i, t, lo, hi, None) for o, op, i, t, lo, hi in changes], "ord long, op string, project_id string, id string, topic_name string, min_value double, max_value double, enabled boolean")
    state, outcomes = A.apply_threshold_changes(base, log)
    assert {r.ord: r.outcome for r in outcomes.collect() if r.outcome != "ok"} == {
        1: "topic_name is required", 2: "threshold not found", 4: "threshold exists", 6: "threshold not found", 10: "threshold not found",
    }
    assert [(r.id, r.topic_name, r.min_value, r.max_value, r.enabled) for r in state.orderBy("ord").collect()] == [("t", "c/z", 5.0, None, False), ("n", "d/q", 0.5, 7.0, True)]
    assert A.index_thresholds(state)
