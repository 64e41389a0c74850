"""Document and vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.documents import affiliation_level, document_id, similarity, squared_l2, tables_to_markdown
from gaugeflow.operators import knowledge as K
from gaugeflow.operators import vector_index as I
from gaugeflow.plans.registry import query
from gaugeflow.plans.standins import chunks, query_vector, table
from gaugeflow.session import work_folder

SQL_SCORED = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
    scored AS (SELECT * EXCLUDE (distance), distance, 1 / (1 + distance) AS s FROM (SELECT c.*,
      list_sum(list_transform(list_zip(embedding::DOUBLE[], qv::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM chunks c, q))"""


def files(spark, d):
    """Uploads named after the documents."""
    n = F.col("doc_id")
    ext = F.expr("CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.PDF' WHEN 'de' THEN '.exe' ELSE '' END")
    return table(spark, d, "documents").select(
        F.concat(F.lit("f."), n.cast("string"), ext).alias("filename"), (F.col("n_chars") * 1000).alias("size"), "source", "doc_id"
    )


SQL_FILES = """files AS (SELECT 'f.' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.PDF' WHEN 'de' THEN '.exe' ELSE '' END AS filename,
    n_chars * 1000 AS size, source, doc_id FROM documents)"""


@query("validate_uploads", sql=f"""WITH {SQL_FILES}, e AS (SELECT *, lower(regexp_extract(filename, '\\.[^.]+$')) AS ext FROM files)
    SELECT filename, CASE WHEN ext NOT IN ('.pdf', '.docx', '.txt', '.md') THEN 'Unsupported file type: ' || ext WHEN size > 10485760 THEN 'File too large' END AS error FROM e""")
def _(spark, d):
    return K.validate_uploads(files(spark, d)).select("filename", "error")


@query("document_id", sql=f"""WITH {SQL_FILES} SELECT filename, md5(source || '_' || filename || '__click') AS doc_id,
    md5(source || '_' || filename || '__click') || '_chunk_3' AS chunk_id FROM files""")
def _(spark, d):
    from gaugeflow.functions.documents import chunk_id

    ids = files(spark, d).select("filename", document_id("source", "filename", F.lit(None).cast("string"), F.lit("click")).alias("doc_id"))
    return ids.withColumn("chunk_id", chunk_id("doc_id", F.lit(3)))


@query("tables_to_markdown", sql="""SELECT page_id, '| ' || url || ' | ' || length(html) || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| page | ' || page_id || ' |' AS markdown FROM pages""")
def _(spark, d):
    # the pages have no tables, so each one gets a table of its own facts in front of its text
    html = F.concat(
        F.lit("<table><tr><th>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</th><th> "), F.length("html").cast("string"),
        F.lit("</th></tr><tr><td>page</td><td><b>"), F.col("page_id").cast("string"), F.lit("</b></td></tr></table>"),
    )
    return table(spark, d, "pages").select("page_id", tables_to_markdown(html).alias("markdown"))


@query("pages_without_tables", sql="SELECT page_id, md5(html) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tables_to_markdown("html")).alias("digest"))


@query("chunk_documents")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    return K.chunk_texts_of(docs)


@query("chunk_elements", sql="""SELECT CAST(doc_id AS VARCHAR) AS doc_id, true AS numbered, true AS sized, true AS covered FROM documents WHERE regexp_matches(text, '[^\\s]')""")
def _(spark, d):
    """The lines of a document as its elements: chunks are numbered through, none is too long, and no character is lost."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    elements = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("element_no", "text"))
    signs = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    found = K.chunk_documents(elements).groupBy("doc_id").agg(
        F.count_distinct("chunk_index").alias("n"), F.max("chunk_index").alias("last"), F.min("chunk_index").alias("first"), F.max("total_chunks").alias("total"),
        F.count("*").alias("rows"), F.max(F.length("text")).alias("longest"), F.sum(signs("text")).alias("signs"),
    )
    numbered = (F.col("n") == F.col("rows")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("total") == F.col("n"))
    return found.join(docs.select("doc_id", signs("text").alias("all_signs")), "doc_id").select(
        "doc_id", numbered.alias("numbered"), (F.col("longest") <= 1000).alias("sized"), (F.col("signs") >= F.col("all_signs")).alias("covered")
    )


@query("embed_chunks")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return K.embed_chunks(K.chunk_texts_of(docs), dimensions=64).select("chunk_id", F.size("embedding").alias("dimensions"), "embedding")


@query("index_chunks", "chunks", sql="SELECT chunk_id, project_id, 'old' AS origin FROM chunks WHERE page_number IS NULL UNION ALL SELECT chunk_id, project_id, 'new' FROM chunks WHERE page_number IS NOT NULL")
def _(spark, d):
    cols = chunks(spark, d).select("chunk_id", "project_id", "page_number")
    old = cols.filter("page_number is null").withColumn("origin", F.lit("old"))
    return K.index_chunks(old, cols.withColumn("origin", F.lit("new"))).drop("page_number")


@query("similarity", "chunks", sql=f"WITH {SQL_SCORED} SELECT chunk_id, round(distance, 6) AS distance, round(s, 6) AS similarity FROM scored")
def _(spark, d):
    dist = squared_l2("embedding", F.lit(query_vector(spark, d)))
    rows = chunks(spark, d).select("chunk_id", dist.alias("distance")).withColumn("similarity", F.round(similarity("distance"), 6))
    return rows.withColumn("distance", F.round("distance", 6))


@query("vector_topk", "chunks", sql=f"WITH {SQL_SCORED} SELECT chunk_id, doc_id, round(s, 6) AS similarity_score FROM scored WHERE project_id = 'p0' ORDER BY distance, chunk_id LIMIT 10")
def _(spark, d):
    rows = K.vector_topk(chunks(spark, d), query_vector(spark, d), "p0", 10)
    return rows.select("chunk_id", "doc_id", F.round("similarity_score", 6).alias("similarity_score"))


def _vector_index(spark, d) -> I.VectorIndex:
    """An index over the chunks' vectors, in a work folder."""
    return I.build_vector_index(chunks(spark, d).select("chunk_id", "project_id", "embedding"), work_folder(spark, "vectors"))


@query("approx_vector_topk")
def _(spark, d):
    return I.approx_vector_topk(_vector_index(spark, d), query_vector(spark, d), 10).select("chunk_id", "distance")


@query("approx_far_query", sql="SELECT 'p1' AS project_id, 25::BIGINT AS n, 25::BIGINT AS ids")
def _(spark, d):
    # a query far from every vector still gets all the rows it asks for
    rows = I.approx_vector_topk(_vector_index(spark, d), [40.0 + x for x in query_vector(spark, d)], 25, "p1")
    return rows.groupBy("project_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"))


@query("indexed_vector_topk", "chunks", sql=f"WITH {SQL_SCORED} SELECT chunk_id, project_id, round(s, 6) AS similarity_score FROM scored WHERE project_id = 'p0' ORDER BY distance, chunk_id LIMIT 10")
def _(spark, d):
    rows = I.indexed_vector_topk(_vector_index(spark, d), query_vector(spark, d), 10, "p0")
    return rows.select("chunk_id", "project_id", F.round("similarity_score", 6).alias("similarity_score"))


@query("index_recall", "chunks", sql="SELECT count(*) AS queries, count(*) * 10 AS rows, true AS reached FROM chunks WHERE CAST(doc_id AS BIGINT) % 10 = 0")
def _(spark, d):
    """Every chunk of each tenth document asks for its 10 nearest, once in its cells and once in all; at least 90 % have to be found."""
    index = _vector_index(spark, d)
    asked = chunks(spark, d).filter(F.col("doc_id").cast("bigint") % 10 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    found = I.search_index(index, asked, 10).select("query_id", "chunk_id", F.lit(True).alias("near"))
    every = I.search_index(index, asked, 10, probes=I.CELLS).select("query_id", "chunk_id")
    hits = every.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("rows"), (F.count("near") >= 0.9 * F.count("*")).alias("reached")
    )
    return hits


@query("affiliation_level", "chunks", sql="""SELECT chunk_id, CASE WHEN sensor_type IS NOT NULL THEN 'sensor' WHEN equipment_id IS NOT NULL THEN 'equipment' ELSE 'general' END AS level FROM chunks""")
def _(spark, d):
    return chunks(spark, d).select("chunk_id", affiliation_level("equipment_id", "sensor_type").alias("level"))


@query("affiliation_search", "chunks", sql=f"""WITH {SQL_SCORED} SELECT * FROM (SELECT chunk_id, 'equipment' AS affiliation_level, round(s, 6) AS similarity_score FROM scored
      WHERE project_id = 'p1' AND equipment_id = 'cell_1' AND sensor_type IS NULL ORDER BY distance, chunk_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT chunk_id, 'general', round(s, 6) FROM scored WHERE project_id = 'p1' AND equipment_id IS NULL AND sensor_type IS NULL ORDER BY distance, chunk_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT chunk_id, 'sensor', round(s, 6) FROM scored WHERE project_id = 'p1' AND equipment_id = 'cell_0' AND sensor_type = 'click' ORDER BY distance, chunk_id LIMIT 5)""")
def _(spark, d):
    c, q = chunks(spark, d), query_vector(spark, d)
    result = None
    for level, equipment, sensor in [("equipment", "cell_1", None), ("general", None, None), ("sensor", "cell_0", "click")]:
        rows = K.affiliation_search(c, q, "p1", level, equipment, sensor, 5)
        rows = rows.select("chunk_id", "affiliation_level", F.round("similarity_score", 6).alias("similarity_score"))
        result = rows if result is None else result.unionByName(rows)
    return result


def _levels(equipment: str, sensor: str | None, k: int) -> str:
    """Comparison SQL of the staged search."""
    sensor_rule = f"equipment_id = '{equipment}' AND sensor_type = '{sensor}'" if sensor else "false"
    return f"""WITH {SQL_SCORED}, p AS (SELECT * FROM scored WHERE project_id = 'p0'),
      l AS (SELECT *, CASE WHEN {sensor_rule} THEN 0 WHEN equipment_id = '{equipment}' AND sensor_type IS NULL THEN 1
        WHEN equipment_id IS NULL AND sensor_type IS NULL THEN 2 END AS lvl FROM p),
      r AS (SELECT * FROM l WHERE lvl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lvl ORDER BY distance, chunk_id) <= {k}),
      staged AS (SELECT chunk_id, s, lvl FROM r WHERE (SELECT count(*) FROM r q WHERE q.lvl < r.lvl) < {k}),
      wide AS (SELECT chunk_id, s, CASE WHEN sensor_type IS NOT NULL THEN 0 WHEN equipment_id IS NOT NULL THEN 1 ELSE 2 END AS lvl FROM p
        WHERE (SELECT count(*) FROM staged) = 0 ORDER BY distance, chunk_id LIMIT {k})
      SELECT chunk_id, ['sensor', 'equipment', 'general'][lvl + 1] AS affiliation_level, round(s, 6) AS similarity_score
      FROM (SELECT * FROM staged UNION ALL SELECT * FROM wide) ORDER BY lvl, s DESC, chunk_id LIMIT {k}"""


def _search(spark, d, equipment, sensor, k):
    rows = K.hierarchical_search(chunks(spark, d), query_vector(spark, d), "p0", equipment, sensor, k)
    return rows.select("chunk_id", "affiliation_level", F.round("similarity_score", 6).alias("similarity_score"))


@query("hierarchical_search", "chunks", sql=_levels("cell_1", "click", 5))
def _(spark, d):
    return _search(spark, d, "cell_1", "click", 5)


@query("hierarchical_search_deep", "chunks", sql=_levels("cell_0", "click", 60))
def _(spark, d):
    return _search(spark, d, "cell_0", "click", 60)


@query("hierarchical_search_equipment", "chunks", sql=_levels("cell_1", None, 60))
def _(spark, d):
    return _search(spark, d, "cell_1", None, 60)


@query("hierarchical_search_broad", "chunks", sql=f"""WITH {SQL_SCORED}, b AS (SELECT *, CASE WHEN sensor_type IS NOT NULL THEN 'sensor' WHEN equipment_id IS NOT NULL THEN 'equipment'
    ELSE 'general' END AS affiliation_level FROM scored WHERE project_id = 'p0' ORDER BY distance, chunk_id LIMIT 10) SELECT chunk_id, affiliation_level, round(s, 6) AS similarity_score FROM b""")
def _(spark, d):
    return _search(spark, d, None, None, 10)


@query("dedupe_and_rank", "chunks", sql=f"""WITH {SQL_SCORED}, a AS (SELECT chunk_id, s, CASE WHEN sensor_type IS NOT NULL THEN 0 WHEN equipment_id IS NOT NULL THEN 1 ELSE 2 END AS lvl FROM scored)
    SELECT chunk_id, round(s, 6) AS similarity_score FROM a ORDER BY lvl, s DESC, chunk_id LIMIT 25""")
def _(spark, d):
    rows = K.scored(chunks(spark, d), query_vector(spark, d)).withColumn("affiliation_level", affiliation_level("equipment_id", "sensor_type"))
    twice = rows.unionByName(rows.withColumn("similarity_score", F.col("similarity_score") / 2))
    return K.dedupe_and_rank(twice, 25).select("chunk_id", F.round("similarity_score", 6).alias("similarity_score"))


@query("group_by_document", "chunks", sql=f"""WITH {SQL_SCORED}, t AS (SELECT *, CASE WHEN sensor_type IS NOT NULL THEN 'sensor' WHEN equipment_id IS NOT NULL THEN 'equipment' ELSE 'general' END AS lvl
      FROM scored ORDER BY distance, chunk_id LIMIT 60)
    SELECT doc_id, any_value(filename ORDER BY distance, chunk_id DESC) AS filename, first(lvl ORDER BY s DESC, chunk_id DESC) AS affiliation_level,
    string_agg(chunk_index || ':' || CAST(round(s, 4) AS VARCHAR) || ':' || md5(coalesce(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END, '')), ';'
      ORDER BY round(s, 4) DESC, chunk_index) AS chunks FROM t GROUP BY doc_id""")
def _(spark, d):
    found = K.vector_topk(chunks(spark, d), query_vector(spark, d), None, 60).withColumn("affiliation_level", affiliation_level("equipment_id", "sensor_type"))
    printed = F.array_join(
        F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_index"].cast("string"), c["similarity_score"].cast("string"), F.md5(F.coalesce(c["content"], F.lit(""))))), ";"
    )
    return K.group_by_document(found).select("doc_id", "filename", "affiliation_level", printed.alias("chunks"))


@query("delete_document", "chunks", sql="""SELECT 'kept' AS what, count(*) FILTER (NOT (project_id = 'p1' AND doc_id = '3')) AS n FROM chunks
    UNION ALL SELECT 'removed', count(*) FILTER (project_id = 'p1' AND doc_id = '3') FROM chunks""")
def _(spark, d):
    kept, removed = K.delete_document(chunks(spark, d), "p1", "3")
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(removed.select(F.lit("removed").alias("what"), F.col("removed").alias("n")))


@query("clear_documents", "chunks", sql="""SELECT 'kept' AS what, count(*) FILTER (project_id <> 'p1') AS n FROM chunks UNION ALL SELECT 'removed', count(*) FILTER (project_id = 'p1') FROM chunks""")
def _(spark, d):
    kept, removed = K.clear_documents(chunks(spark, d), "p1")
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(removed.select(F.lit("removed").alias("what"), F.col("removed").alias("n")))


@query("chunk_stats", "chunks", sql="""SELECT project_id, CAST(count(*) AS BIGINT) AS total_chunks, count(DISTINCT doc_id) AS unique_documents,
    count(DISTINCT doc_id || '_' || equipment_id) FILTER (equipment_id IS NOT NULL AND sensor_type IS NULL) AS equipment_specific_documents,
    count(DISTINCT doc_id || '_' || equipment_id || '_' || sensor_type) FILTER (sensor_type IS NOT NULL) AS sensor_specific_documents,
    count(DISTINCT doc_id || '_' || page_number) FILTER (page_number <> 0) AS pages_with_content,
    count(DISTINCT doc_id) - count(DISTINCT doc_id || '_' || equipment_id) FILTER (equipment_id IS NOT NULL AND sensor_type IS NULL)
      - count(DISTINCT doc_id || '_' || equipment_id || '_' || sensor_type) FILTER (sensor_type IS NOT NULL) AS general_documents FROM chunks GROUP BY project_id""")
def _(spark, d):
    return K.chunk_stats(chunks(spark, d))


@query("chunk_file_types", "chunks", sql="SELECT project_id, lower(string_split(filename, '.')[-1]) AS file_type, count(*) AS chunks FROM chunks GROUP BY ALL")
def _(spark, d):
    return K.chunk_file_types(chunks(spark, d))


@query("document_stats", sql="""WITH t AS (SELECT n_chars AS b, CASE WHEN lang <> 'fr' THEN lang END AS ft, CASE WHEN source <> 'src0' THEN source END AS eq, lang AS st FROM documents)
    SELECT 'unique_documents' AS metric, '' AS key, count(*) AS value FROM t UNION ALL SELECT 'total_size_bytes', '', CAST(sum(b) AS BIGINT) FROM t
    UNION ALL SELECT 'file_type', coalesce(ft, 'unknown'), count(*) FROM t GROUP BY ft UNION ALL SELECT 'equipment', eq, count(*) FROM t WHERE eq IS NOT NULL GROUP BY eq
    UNION ALL SELECT DISTINCT 'sensor_type', st, 1 FROM t""")
def _(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("n_chars").alias("file_size"), F.when(F.col("lang") != "fr", F.col("lang")).alias("file_type"),
        F.when(F.col("source") != "src0", F.col("source")).alias("equipment_id"), F.col("lang").alias("sensor_type"),
    )
    return K.document_stats(docs)


@query("list_documents", "chunks", sql="""SELECT project_id, doc_id, first(filename ORDER BY chunk_index) AS filename, first(document_type ORDER BY chunk_index) AS document_type,
    first(equipment_id ORDER BY chunk_index) AS equipment_id, first(sensor_type ORDER BY chunk_index) AS sensor_type, first(total_chunks ORDER BY chunk_index) AS total_chunks
    FROM chunks GROUP BY project_id, doc_id""")
def _(spark, d):
    return K.list_documents(chunks(spark, d))
