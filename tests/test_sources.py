import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import storage as T
from gaugeflow.operators.registry import project_summaries
from gaugeflow.sources import bundles as B
from gaugeflow.sources import documents, messages, projects, sql, thresholds

STORED = "project_id string, session_id string, msg_id long, ts timestamp, value double"
SESSION = "project_id string, session_id string, project_name string"


def csv(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_thresholds_csv(spark, tmp_path):
    path = csv(tmp_path, "topic_name,min_value,max_value\ncell/1/glucose_mM,4,12\n cell/1/pH ,,7.5\n")
    rows = thresholds.read_thresholds_csv(spark, path, "p").orderBy("ord").collect()
    assert [(r.topic_name, r.sensor_type, r.min_value, r.max_value, r.ord, r.enabled) for r in rows] == [
        ("cell/1/glucose_mM", "glucose_mM", 4.0, 12.0, 2, True), ("cell/1/pH", "pH", None, 7.5, 3, True),
    ]
    assert rows[0].id.startswith("cell_1_glucose_mM_2_")


@pytest.mark.parametrize(
    "text,message",
    [
        ("topic_name,min_value,max_value\na,1,\nb,,\n", "Row 3: At least one"),
        ("topic_name,min_value,max_value\na,x,1\n", "Row 2: Invalid numeric"),
        ("topic,min_value,max_value\na,1,1\n", "must contain columns"),
        ("topic_name,min_value,max_value\n", "No valid"),
    ],
)
def test_bad_threshold_files(spark, tmp_path, text, message):
    with pytest.raises(thresholds.ThresholdFileError, match=message):
        thresholds.read_thresholds_csv(spark, csv(tmp_path, text), "p")


def test_row_numbers_across_splits(spark, tmp_path):
    path = csv(tmp_path, "topic_name,min_value,max_value\n" + "".join(f"a/b/c{i:05d},{i},\n" for i in range(3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        rows = thresholds.threshold_rows(spark, path)
        assert rows.select(F.spark_partition_id()).distinct().count() > 0
        assert rows.filter(F.col("row_number") != F.col("min_value") + 2).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def stored(spark):
    rows = [(f"p{i % 2}", f"s{i % 3}", i, datetime(2024, 1, 1, 0, 0, i), float(i)) for i in range(12)]
    return spark.createDataFrame(rows, STORED)


def test_write_export_import_replace(spark, tmp_path):
    m_path, s_path, bundle = (str(tmp_path / n) for n in ("messages", "sessions", "bundle"))
    messages.write_messages(stored(spark), m_path)
    sessions = spark.createDataFrame([("p0", "s0", "P"), ("p1", "s1", "P")], SESSION)
    sessions.write.partitionBy("project_id").parquet(s_path)
    table = spark.read.parquet(m_path)
    assert table.count() == 12
    B.export_project(table, spark.read.parquet(s_path), "p0", bundle)
    manifest = spark.read.json(f"{bundle}/manifest").first()
    assert (manifest.project_id, manifest.total_messages) == ("p0", 6)
    # newer messages of the project vanish with the import, the other project stays
    extra = spark.createDataFrame([("p0", "s9", 99, datetime(2024, 1, 2), 1.0)], STORED)
    messages.write_messages(extra, m_path)
    for _ in range(2):  # repeating an import changes nothing
        assert B.import_project(spark, bundle, m_path, s_path, STORED, SESSION) == "p0"
        spark.catalog.refreshByPath(m_path)
        ids = sorted(r.msg_id for r in spark.read.parquet(m_path).collect())
        assert ids == list(range(12))
        assert spark.read.parquet(s_path).count() == 2
    assert B.drop_project(spark, m_path, "p1")
    assert {r.project_id for r in spark.read.parquet(m_path).select("project_id").distinct().collect()} == {"p0"}
    with pytest.raises(B.BundleError):
        B.read_bundle(spark, str(tmp_path / "nothing"), STORED, SESSION)


@pytest.mark.parametrize("broken", ["messages", "switch"])
def test_failed_import_leaves_the_old_rows(spark, tmp_path, monkeypatch, broken):
    m_path, s_path, bundle = (str(tmp_path / n) for n in ("messages", "sessions", "bundle"))
    messages.write_messages(stored(spark), m_path)
    sessions = spark.createDataFrame([("p0", "s0", "P"), ("p1", "s1", "P")], SESSION)
    sessions.write.partitionBy("project_id").parquet(s_path)
    B.export_project(stored(spark).withColumn("value", F.col("value") + 100), sessions, "p0", bundle)
    before = sorted(map(str, spark.read.parquet(m_path).collect())), sorted(map(str, spark.read.parquet(s_path).collect()))

    if broken == "messages":
        monkeypatch.setattr(B, "write_messages", lambda df, path: df.withColumn("value", F.raise_error(F.lit("disk full")).cast("double")).write.partitionBy("project_id", "session_id").parquet(path))
    else:
        rename, calls = B._Folders.rename, []

        def failing(self, old, new):
            calls.append(old)
            if len(calls) == 4:  # the new sessions, after the messages were switched
                raise B.BundleError("no rename")
            rename(self, old, new)

        monkeypatch.setattr(B._Folders, "rename", failing)
    with pytest.raises(Exception):
        B.import_project(spark, bundle, m_path, s_path, STORED, SESSION)
    monkeypatch.undo()
    for path in (m_path, s_path):
        spark.catalog.refreshByPath(path)
    assert (sorted(map(str, spark.read.parquet(m_path).collect())), sorted(map(str, spark.read.parquet(s_path).collect()))) == before
    # the same import goes through once nothing is broken
    B.import_project(spark, bundle, m_path, s_path, STORED, SESSION)
    spark.catalog.refreshByPath(m_path)
    assert spark.read.parquet(m_path).filter("project_id = 'p0'").agg(F.min("value")).first()[0] >= 100
    assert not [f for f in (tmp_path / "messages").iterdir() if f.name.startswith(("_import", "_replaced"))]


def test_storage_totals(spark):
    sizes = spark.createDataFrame([("a", 1024.0, 5, 1), ("b", 2560.5, 1, 0), ("c", 0.0, 0, 0)], "project_id string, size_kb double, message_count long, session_count long")
    assert tuple(T.storage_totals(sizes).first()) == (3, 3.5)
    assert tuple(T.storage_totals(sizes.limit(0)).first()) == (0, 0.0)


def test_storage_stats_counts_each_file_once(spark, tmp_path):
    import os

    m_path, s_path = str(tmp_path / "messages"), str(tmp_path / "sessions")
    messages.write_messages(stored(spark), m_path)
    spark.createDataFrame([("p0", "s0", "P"), ("p2", "s1", "P")], SESSION).write.partitionBy("project_id").parquet(s_path)
    rows = {r.project_id: r for r in T.storage_stats(spark.read.parquet(m_path), spark.read.parquet(s_path)).collect()}
    size = sum(
        os.path.getsize(os.path.join(d, f)) for base in (m_path, s_path) for d, _, fs in os.walk(base) if "project_id=p0" in d for f in fs if f.endswith(".parquet")
    )
    assert rows["p0"].size_kb == pytest.approx(size / 1024, abs=0.006)
    assert [(p, rows[p].message_count, rows[p].session_count) for p in sorted(rows)] == [("p0", 6, 1), ("p1", 6, 0), ("p2", 0, 1)]


def test_import_session(spark):
    m = stored(spark)
    s = spark.createDataFrame([("p0", "s0", "P")], SESSION)
    bundle_m, bundle_s = B.export_session(m, s, "s0")
    all_m, all_s = B.import_session(m, s, bundle_m, bundle_s, "imported_1")
    assert all_m.filter("session_id = 'imported_1'").count() == 4 and all_m.count() == 16
    assert all_m.select("msg_id").distinct().count() == 16
    old, new = ([r.msg_id for r in all_m.filter(f"session_id = '{x}'").orderBy("msg_id").collect()] for x in ("s0", "imported_1"))
    assert new == [i + 12 - old[0] for i in old]
    empty, _ = B.import_session(m.limit(0), s, bundle_m, bundle_s, "imported_2")
    assert sorted(r.msg_id for r in empty.collect()) == [i - old[0] for i in old]
    assert sorted(r.session_id for r in all_s.collect()) == ["imported_1", "s0"]
    with pytest.raises(B.BundleError):
        B.import_session(m, s, bundle_s, bundle_s, "x")


def test_projects(spark, tmp_path):
    full = {
        "id": "a", "name": "A", "is_favorite": True, "mqtt_config": {"broker_host": "h", "broker_port": 1, "topic": "#"},
        "discovered_nodes": [{"id": "n", "equipment_type": "lab"}, {"id": "m", "equipment_type": "lab"}, {"id": "o", "equipment_type": "cell"}],
        "graph_layout": {"nodes": [{"id": "n1", "data": {"equipment_id": "e1"}}], "edges": [{"id": "x", "source": "n1", "target": "n1"}]},
        "alert_thresholds": [{"id": "t", "topic_name": "a/b", "sensor_type": "b", "min_value": 1.0}],
    }
    (tmp_path / "a.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "b.json").write_text('{"id": "b", "mqtt_config": {"broker_host": "k"}}')
    p = projects.read_projects(spark, str(tmp_path))
    rows = {r.id: r for r in project_summaries(p).collect()}
    assert (rows["a"].node_count, rows["a"].equipment_types, rows["a"].is_favorite, rows["a"].broker_host) == (1, ["lab", "cell"], True, "h")
    assert (rows["b"].node_count, rows["b"].equipment_types, rows["b"].is_favorite, rows["b"].description) == (0, [], False, None)
    assert projects.project_nodes(p).first().equipment_id == "e1"
    assert projects.project_edges(p).count() == 1
    t = projects.project_thresholds(p).first()
    assert (t.project_id, t.topic_name, t.min_value, t.max_value, t.enabled) == ("a", "a/b", 1.0, None, True)


def test_documents(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("häuser".encode())
    (tmp_path / "l.md").write_bytes("häuser".encode("latin-1"))
    (tmp_path / "blank.txt").write_text(" \n ")
    (tmp_path / "x.bin").write_bytes(b"no")
    got = {r.filename: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": "häuser", "l.md": "häuser"}


def test_documents_are_listed_by_tasks(spark, tmp_path, capsys):
    """The same files as Spark's own source finds, at a number of tasks that doesn't grow with the files."""
    names = ["a.txt", "_a.txt", ".b.md", "_c=1.txt", "d e%20.MD", "x.csv", "g._COPYING_", "_metadata.txt", "up/a.txt", "up/on/b.md", "_off/c.txt", ".off/c.txt", "k=1/d.txt", "dir.txt/e.md", "_metadata/f.txt"]
    for i, name in enumerate([*names, *(f"many/{i}.txt" for i in range(300))]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if i == 3 else f"häuser {i}\r\n".encode("latin-1" if i % 2 else "utf-8"))
    rows = documents.read_documents(spark, f"file://{tmp_path}")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}")
    by_spark = documents.read_documents(spark, "viewfs://docs/in")
    assert sorted(rows.collect()) == sorted(by_spark.collect()) and rows.schema == by_spark.schema and rows.count() == 307
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "broken.txt").symlink_to(tmp_path / "none")
    by_spark = spark.read.format("binaryFile").option("pathGlobFilter", documents.ENDINGS).option("recursiveFileLookup", True).load(str(tmp_path))
    found = [r.filename for r in documents.read_documents(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(r.path.split("/")[-1] for r in by_spark.filter("length > 0").collect())
    rows.explain()
    assert "Scan binaryFile" not in capsys.readouterr().out
    single = documents.read_documents(spark, str(tmp_path / "a.txt"))
    assert [(r.filename, r.file_size) for r in single.collect()] == [("a.txt", 11)]
    assert documents.read_documents(spark, f"{tmp_path}/u*").count() == 2


@pytest.mark.parametrize("store", ["", "viewfs://out"])
def test_each_text_becomes_a_file(spark, tmp_path, store, monkeypatch):
    monkeypatch.setattr(documents, "FOLDER_FILES", 3)
    texts = ["a\nb", "", None, " \n", "ö", *["copy"] * 5]
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.out.link./to", f"file://{tmp_path}")
    path = f"{store}/to/docs" if store else str(tmp_path / "docs")
    documents.write_documents(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), path)
    files = [f for f in (tmp_path / "docs").rglob("*.txt")]
    assert sorted(f.read_text() for f in files) == sorted((t or "") + "\n" for t in texts)
    assert store or {len(list(f.parent.iterdir())) for f in files} <= {1, 2, 3}
    assert sorted(r.text for r in documents.read_documents(spark, path).collect()) == sorted(["a\nb\n", "ö\n", *["copy\n"] * 5])


def test_undecodable_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"msg_id":1,"topic":"a","payload":"{}"}\noops\n{"msg_id":2}\n')
    good, bad = messages.split_undecodable(messages.read_messages(spark, str(tmp_path)))
    assert [r.msg_id for r in good.collect()] == [1]
    assert bad.count() == 2


def test_run_sql(spark):
    ok = sql.run_sql(spark, "SELECT msg_id, value FROM m WHERE msg_id < 2 ORDER BY msg_id", {"m": stored(spark)})
    assert [r.row for r in ok.rows.collect()] == ['{"msg_id":0,"value":0.0}', '{"msg_id":1,"value":1.0}']
    head = ok.envelope().first()
    assert (head.status, head.columns, head.row_count) == ("success", ["msg_id", "value"], 2)
    bad = sql.run_sql(spark, "SELECT nothing FROM m")
    assert bad.status == "error" and "nothing" in bad.error and bad.rows is None
