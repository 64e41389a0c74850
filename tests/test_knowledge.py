import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import documents as D
from gaugeflow.functions.documents import file_extension, markdown_table, split_text, tables_to_markdown
from gaugeflow.functions.text import extract_references, text_stats
from gaugeflow.operators import knowledge as K
from gaugeflow.operators import vector_index as I

CHUNK = "chunk_id string, doc_id string, project_id string, filename string, document_type string, chunk_index long, total_chunks long, page_number long, equipment_id string, sensor_type string, text string, embedding array<float>"


def test_split_text_keeps_size_and_content():
    rnd = random.Random(4)
    for n in (0, 10, 999, 1000, 1001, 5000, 20000):
        for seps in (" ", "\n ", "\n\n \n", "", "\n\n"):
            words = []
            while sum(map(len, words)) < n:
                words.append("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 12))) + (rnd.choice(seps) if seps else ""))
            text = "".join(words)
            chunks = split_text(text, 1000, 200)
            assert all(0 < len(c) <= 1000 for c in chunks)
            # every non-blank character is covered, in order
            at = 0
            for c in chunks:
                start = text.find(c, max(0, at - 1200))
                assert start >= 0 and not text[at:start].strip()
                at = max(at, start + len(c))
            assert not text[at:].strip()


def test_overlap_and_separators():
    text = "\n\n".join(f"paragraph {i} " + "x" * 80 for i in range(40))
    chunks = split_text(text, 1000, 200)
    assert all(c.startswith("paragraph") for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        shared = next((k for k in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:k])), 0)
        assert 0 < shared <= 200


def test_chunk_documents_numbers_elements(spark):
    rows = [("d", 0, "short", 1), ("d", 1, "word " * 500, 2), ("d", 2, "end", 2), ("e", 0, "y" * 1500, None)]
    df = spark.createDataFrame(rows, "doc_id string, element_no int, text string, page_number int")
    got = K.chunk_documents(df).orderBy("doc_id", "chunk_index").collect()
    d = [r for r in got if r.doc_id == "d"]
    assert [r.chunk_index for r in d] == list(range(len(d))) and {r.total_chunks for r in d} == {len(d)}
    assert d[0].text == "short" and d[-1].text == "end" and d[0].chunk_id == "d_chunk_0"
    assert d[1].text == split_text("word " * 500)[0]
    single = K.chunk_texts_of(df.filter("doc_id = 'e'")).collect()
    assert [r.text for r in single] == split_text("y" * 1500)


def test_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 &amp; <b>3</b></td></tr></table>"
    assert markdown_table(html) == "| a | b |\n| --- | --- |\n| 1 | 2 & 3 |"
    df = spark.createDataFrame([(html,), ("<p>no table</p>",), (None,)], "h string")
    got = [r[0] for r in df.select(tables_to_markdown("h")).collect()]
    assert got == [markdown_table(html), "<p>no table</p>", None]


@pytest.mark.parametrize("html,rows", [
    ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", [["a", "b"], ["c", "d"]]),  # all end tags left out
    ("<TABLE><tr><td>a</td><td>b</td><tr><td>c</td></tr>", [["a", "b"], ["c"]]),  # one row and the table not ended
    ("<table><thead><tr><th>h<tbody><tr><td>x</tbody><tfoot><tr><td>f</table>", [["h"], ["x"], ["f"]]),
    ("<table><tr><td>out<table><tr><td>in</table>er</td><td>z</td></tr></table>", [["in"], ["outer", "z"]]),
    ("<table><tr></tr><td>no row", [["no row"]]),
    ("<tr><td>no table", [["no table"]]),
    ("<table><tr><td>two\n  lines<br>here</td></tr></table>", [["two lines here"]]),
    ("</table></table><table><tr><td>late</table></td></tr>", [["late"]]),
    ("<table><tr><td></td><td>x</td></tr></table>", [["", "x"]]),
])
def test_tables_with_implied_ends(spark, html, rows):
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
    assert markdown_table(html) == "\n".join(lines)
    assert spark.createDataFrame([(html,)], "h string").select(tables_to_markdown("h")).first()[0] == "\n".join(lines)


def test_chunks_alike_on_both_sides_of_the_size(spark):
    texts = [None, "", "  \n", " a ", "x" * 10, "   " + "x" * 9, " " * 30, "b " * 8, "\u00a0c\u00a0"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: [] for r in df.collect()}
    for r in K.chunk_texts_of(df, 10, 2).orderBy("chunk_index").collect():
        got[r.doc_id].append(r.text)
    assert got == {str(i): split_text(t or "", 10, 2) for i, t in enumerate(texts)}


def test_embedding_default_and_model(spark):
    df = spark.createDataFrame([("c1", "pump pressure high"), ("c2", "")], "chunk_id string, text string")
    rows = {r.chunk_id: r.embedding for r in K.embed_chunks(df, dimensions=32).collect()}
    assert len(rows["c1"]) == 32 and sum(x * x for x in rows["c1"]) == pytest.approx(1.0, abs=1e-5)
    got = K.embed_chunks(df, model=lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r.embedding for r in got] == [[18.0], [0.0]]


def index(spark):
    rows = []
    for i in range(40):
        equipment = None if i % 2 else f"e{i % 3}"
        sensor = "s" if equipment and i % 4 == 0 else None
        rows.append((f"c{i:02d}", f"d{i // 4}", "p", "f.md", "general", i % 4, 4, None, equipment, sensor, "t" * 600, [float(i), 0.0]))
    return spark.createDataFrame(rows, CHUNK)


def staged(rows, equipment, sensor, k):
    """The staged search in plain Python."""
    rows = sorted(rows, key=lambda r: (r.embedding[0] ** 2, r.chunk_id))
    levels = []
    if equipment and sensor:
        levels.append(("sensor", lambda r: r.equipment_id == equipment and r.sensor_type == sensor))
    if equipment:
        levels.append(("equipment", lambda r: r.equipment_id == equipment and r.sensor_type is None))
        levels.append(("general", lambda r: r.equipment_id is None and r.sensor_type is None))
    found = []
    for name, rule in levels:
        if len(found) < k:
            found += [(name, r.chunk_id) for r in rows if rule(r)][:k]
    if not found:
        found = [("sensor" if r.sensor_type else "equipment" if r.equipment_id else "general", r.chunk_id) for r in rows[:k]]
        found.sort(key=lambda f: ["sensor", "equipment", "general"].index(f[0]))
    return found[:k]


@pytest.mark.parametrize("equipment,sensor", [("e0", "s"), ("e1", None), ("e9", "s"), (None, None), (None, "s")])
@pytest.mark.parametrize("k", [2, 6, 50])
def test_hierarchical_search(spark, equipment, sensor, k):
    df = index(spark)
    got = [(r.affiliation_level, r.chunk_id) for r in K.hierarchical_search(df, [0.0, 0.0], "p", equipment, sensor, k).collect()]
    assert got == staged(df.collect(), equipment, sensor, k)


def test_broad_search_when_nothing_matches(spark):
    df = index(spark).filter("equipment_id is not null")
    got = [r.chunk_id for r in K.hierarchical_search(df, [0.0, 0.0], "p", "e9", None, 3).collect()]
    assert sorted(got) == ["c00", "c02", "c04"]


def test_approximate_search_recall(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"c{i}", "d", "p", "f", "g", i, 1, None, None, None, "t", [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, CHUNK)
    query = rows[0][-1]
    exact = {r.chunk_id for r in K.vector_topk(df, query, "p", 10).collect()}
    index = I.build_vector_index(df, f"{tmp_path}/index")
    near = {r.chunk_id for r in I.approx_vector_topk(index, query, 10).collect()}
    assert len(exact & near) >= 8


def test_grouping_and_index(spark):
    df = index(spark)
    found = K.hierarchical_search(df, [0.0, 0.0], "p", None, None, 6)
    docs = K.group_by_document(found).collect()
    assert docs[0].affiliation_level == "sensor"
    assert all(len(c.content) == 503 for d in docs for c in d.chunks)
    for d in docs:
        assert [c.similarity_score for c in d.chunks] == sorted((c.similarity_score for c in d.chunks), reverse=True)
    assert K.index_chunks(df, df).count() == 40
    kept, removed = K.delete_document(df, "p", "d1")
    assert (kept.count(), removed.first().removed) == (36, 4)
    s = K.chunk_stats(df).first()
    assert s.total_chunks == 40 and s.unique_documents == 10
    assert s.general_documents == 10 - s.equipment_specific_documents - s.sensor_specific_documents


def test_uploads(spark):
    rows = [("a.pdf", 1, None), ("b.MD", 10 * 1024 * 1024, None), ("c.exe", 1, "Unsupported file type: .exe"), ("d.txt", 10 * 1024 * 1024 + 1, "File too large"), (".md", 1, "Unsupported file type: ")]
    df = spark.createDataFrame(rows, "filename string, size long, want string")
    assert K.validate_uploads(df).filter(~F.col("error").eqNullSafe(F.col("want"))).count() == 0
    assert df.select(file_extension("filename")).first()[0] == ".pdf"


def test_text_functions(spark):
    df = spark.createDataFrame([("@pH and @glucose mM, now @pH and",), ("a b. c.  . d",), ("",)], "t string")
    refs = [r[0] for r in df.select(extract_references("t")).collect()]
    assert refs == [["pH and", "glucose mM"], [], []]
    s = [r[0] for r in df.select(text_stats("t")).collect()][1]
    assert (s.word_count, s.sentence_count, s.character_count, s.average_word_length) == (5, 3, 12, 2.4)
    assert re.fullmatch(r"a b.*", s.text_preview)


def clustered(rnd, n):
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((f"c{i:04d}", f"p{i % 3}", "t" * 50, [x + rnd.gauss(0, 0.4) for x in c]))
    return rows


def exact(rows, query, k, project=None):
    near = sorted((sum((a - b) ** 2 for a, b in zip(v, query)), c) for c, p, _, v in rows if project in (None, p))
    return [c for _, c in near[:k]]


INDEXED = "chunk_id string, project_id string, text string, embedding array<double>"


def test_vector_index_near_and_far(spark, tmp_path):
    rnd = random.Random(6)
    rows = clustered(rnd, 1500)
    odd = [("n1", "p0", "", None), ("n2", "p0", "", []), ("n3", "p0", "", [1.0]), ("n4", "p0", "", [float("nan")] * 16)]
    index = I.build_vector_index(spark.createDataFrame(rows + odd, INDEXED).repartition(4), f"{tmp_path}/index")
    hits = 0
    for i in range(12):
        query = [x + rnd.gauss(0, 0.2) for x in rows[i * 100][3]]
        got = [r.chunk_id for r in I.approx_vector_topk(index, query, 10).collect()]
        assert len(got) == 10
        hits += len(set(got) & set(exact(rows, query, 10)))
        if i % 4 == 0:
            found = I.indexed_vector_topk(index, query, 10, "p1").collect()
            assert [r.chunk_id for r in found] == exact(rows, query, 10, "p1") and {r.project_id for r in found} == {"p1"}
    assert hits >= 0.9 * 120
    far = [1000.0] * 16
    assert I.approx_vector_topk(index, far, 5, probes=1).count() == 5
    assert [r.chunk_id for r in I.indexed_vector_topk(index, far, 5).collect()] == exact(rows, far, 5)
    # more rows than one cell has, and more than there are
    assert I.approx_vector_topk(index, far, 700, probes=1).count() == 700
    assert I.approx_vector_topk(index, far, 5000).count() == 1500
    assert I.approx_vector_topk(index, far, 5, "nobody").count() == 0 and I.indexed_vector_topk(index, far, 5, "nobody").count() == 0


def test_vector_index_reads_only_probed_partitions(spark, tmp_path, capsys):
    rows = clustered(random.Random(7), 800)
    index = I.build_vector_index(spark.createDataFrame(rows, INDEXED), f"{tmp_path}/index")
    cells = I.chosen_cells(index, rows[0][3], 5, probes=2)
    assert len(cells) == 2
    assert len(index.cells()) > 10
    I.approx_vector_topk(index, rows[0][3], 5, probes=2).explain("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]", capsys.readouterr().out)[1]
    assert set(re.findall(r"IN \(([-\d,]+)\)", filters)[0].split(",")) == {str(c) for c in cells}


def test_vector_index_additions(spark, tmp_path):
    rnd = random.Random(8)
    rows = clustered(rnd, 600)
    index = I.build_vector_index(spark.createDataFrame(rows[:400], INDEXED), f"{tmp_path}/index")
    I.add_to_index(index, spark.createDataFrame(rows[300:] + [("n1", "p0", "", None)], INDEXED))
    assert index.chunks().count() == 601 and sum(n for n, _ in index.cells().values()) == 600
    for query in (rows[599][3], [50.0] * 16):
        assert [r.chunk_id for r in I.indexed_vector_topk(index, query, 7).collect()] == exact(rows, query, 7)
    before = index.cells()
    I.refresh_cells(index)
    assert index.cells() == before


def test_vector_index_of_many_queries(spark, tmp_path):
    rows = clustered(random.Random(9), 500)
    index = I.build_vector_index(spark.createDataFrame(rows, INDEXED), f"{tmp_path}/index")
    queries = spark.createDataFrame([(i, rows[i * 20][3]) for i in range(20)] + [(99, None)], "query_id long, embedding array<double>")
    got = {}
    for r in I.search_index(index, queries, 5, probes=I.CELLS).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    assert got == {i: list(enumerate(exact(rows, rows[i * 20][3], 5), 1)) for i in range(20)}
    near = I.search_index(index, queries, 5)
    assert near.count() == 100 and near.filter("distance = 0 AND rank = 1").count() == 20
    none = I.build_vector_index(spark.createDataFrame([("n1", "p0", "", None)], INDEXED), f"{tmp_path}/none")
    assert I.search_index(none, queries, 5).count() == 0 and I.approx_vector_topk(none, rows[0][3], 5).count() == 0


def test_search_of_an_empty_affiliation(spark):
    rows = index(spark).collect()
    blank = spark.createDataFrame([tuple("" if n in ("equipment_id", "sensor_type") and v is None else v for n, v in r.asDict().items()) for r in rows], CHUNK)
    for equipment, sensor, k in (("e0", "s", 30), ("e0", "", 5), ("e1", None, 30), ("", None, 4), ("gone", "s", 6)):
        want = [(r.chunk_id, r.affiliation_level) for r in K.hierarchical_search(index(spark), [7.2, 0.0], "p", equipment or None, sensor or None, k).collect()]
        got = [(r.chunk_id, r.affiliation_level) for r in K.hierarchical_search(blank, [7.2, 0.0], "p", equipment, sensor, k).collect()]
        assert got == want and want
    assert K.affiliation_search(blank, [0.0, 0.0], "p", "equipment", "e0", k=3).count() == 3
    assert K.affiliation_search(blank, [0.0, 0.0], "p", "sensor", "e0", "", k=3).count() == 3


@pytest.mark.parametrize("probes", [None, 3, I.CELLS])
def test_search_in_tiles_equals_brute_force(spark, tmp_path, monkeypatch, probes):
    """Tiles of a few rows, cells larger than a tile, copies, repeated and NULL ids: rows, ranks and distances as by the formula."""
    rnd = random.Random(5)
    monkeypatch.setattr(I, "TILE", 4 * 7)
    monkeypatch.setattr(I, "AT_ONCE", 20)
    rows = [(None if i == 3 else f"c{i % 90}", f"p{i % 2}", [float(x) for x in rnd.choices(range(-9, 9), k=4)] if i % 4 else [1.0, 2.0, 3.0, 4.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "chunk_id string, project_id string, embedding array<double>")
    index = I.build_vector_index(df, f"{tmp_path}/index")
    asked = [("a", rows[1][2]), ("b", [1.0, 2.0, 3.0, 4.0]), ("b", [1e200, 0.0, 0.0, 0.0]), (None, rows[5][2]), ("c", None), ("d", [1.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    found = I.search_index(index, queries, 6, "p0", probes)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["distance"]))
    held = {}
    for r in index.chunks().filter("project_id = 'p0'").collect():
        held.setdefault(r["cell"], []).append((r["chunk_id"], r["embedding"]))
    want = {}
    for name, q in asked:
        if q is None or len(q) != 4:
            continue
        for cell in I.chosen_cells(index, q, 6, "p0", probes):
            for chunk, x in held[cell]:
                want.setdefault(name, []).append((sum((a - b) * (a - b) for a, b in zip(x, q)), chunk))
    best = {name: sorted(found, key=lambda f: (f[0], f[1] is not None, f[1] or ""))[:6] for name, found in want.items()}
    assert {name: sorted(found) for name, found in got.items()} == {name: [(i + 1, c, d) for i, (d, c) in enumerate(found)] for name, found in best.items()}


def test_long_batches_are_split_in_pieces(spark):
    """A batch of any length gives its chunks in pieces of bounded size, NULL for texts that stay in the JVM."""
    texts = [None if i % 7 == 0 else f"{i} " * (i % 300) for i in range(2 * D.SPLIT_ROWS + 5)]
    pieces = list(D.chunk_lists(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]), 50, 10))
    assert [len(p) for p in pieces] == [D.SPLIT_ROWS, D.SPLIT_ROWS, 5]
    assert [c for p in pieces for c in p.to_pylist()] == [None if t is None else split_text(t, 50, 10) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.chunks for r in df.select("id", D.chunk_texts("text", 50, 10).alias("chunks")).collect()}
    assert got == {i: split_text(t, 50, 10) if t else [] for i, t in enumerate(texts)}
