"""Chunked documents: building the index, searching it and reporting on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.documents import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    affiliation_level,
    chunk_id,
    chunk_texts,
    document_id,
    file_extension,
    level_priority,
    similarity,
    squared_l2,
    upload_error,
)
from gaugeflow.functions.joins import join_keys

PREVIEW = 500


# --- building --------------------------------------------------------------


def validate_uploads(files: DataFrame) -> DataFrame:
    """Adds ``error``, NULL for accepted files ``(filename, size)``."""
    return files.withColumn("error", upload_error("filename", "size"))


def chunk_documents(elements: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of document elements ``(doc_id, element_no, text, …)``.

    ``chunk_index`` runs over the elements of a document. Only the number of
    chunks per element is counted to number them; the texts are joined with the
    numbers by element.
    """
    split = elements.withColumn("_chunks", chunk_texts("text", size, overlap))
    earlier = W.partitionBy("doc_id").orderBy("element_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        split.select("doc_id", "element_no", F.size("_chunks").alias("n"))
        .withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("total_chunks", F.sum("n").over(W.partitionBy("doc_id")))
        .drop("n")
    )
    return (
        join_keys(split, offsets, ["doc_id", "element_no"])
        .select(*[c for c in elements.columns if c != "text"], "total_chunks", "_offset", F.posexplode("_chunks").alias("_pos", "text"))
        .withColumn("chunk_index", F.col("_offset") + F.col("_pos"))
        .withColumn("chunk_id", chunk_id("doc_id", "chunk_index"))
        .drop("_offset", "_pos")
    )


def chunk_texts_of(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of single-element documents ``(doc_id, text, …)``: a projection without any shuffle."""
    return (
        documents.withColumn("_chunks", chunk_texts("text", size, overlap))
        .select(*[c for c in documents.columns if c != "text"], F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
        .withColumn("chunk_id", chunk_id("doc_id", "chunk_index"))
    )


def embed_chunks(chunks: DataFrame, model: Callable[[list[str]], list] | None = None, dimensions: int = 256) -> DataFrame:
    """Adds ``embedding``. A model maps a list of texts to vectors and is called
    per Arrow batch; the default hashes words into a normalized vector in the JVM."""
    if model is not None:

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(model(batch.tolist())), index=batch.index)

        return chunks.withColumn("embedding", embed("text"))
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+").transform(chunks)
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(words)
    normal = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return normal.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def new_chunks(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming chunks whose id is not in the index yet."""
    return join_keys(incoming, index.select("project_id", "chunk_id"), ["project_id", "chunk_id"], "left_anti")


def index_chunks(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The index with the new chunks added; known ids stay as they are."""
    return index.unionByName(new_chunks(index, incoming).select(*index.columns))


def describe_upload(files: DataFrame) -> DataFrame:
    """Adds the document id to ``(project_id, filename, equipment_id, sensor_type)``."""
    return files.withColumn("doc_id", document_id("project_id", "filename", "equipment_id", "sensor_type"))


# --- searching -------------------------------------------------------------


def scored(chunks: DataFrame, query: list[float]) -> DataFrame:
    distance = squared_l2("embedding", F.lit([float(x) for x in query]))
    return chunks.withColumn("distance", distance).withColumn("similarity_score", similarity("distance")).drop("embedding")


def vector_topk(index: DataFrame, query: list[float], project: str | None = None, k: int = 5) -> DataFrame:
    """The ``k`` nearest chunks. The query is a literal, so the scan scores in
    place and only ``k`` rows per task leave it."""
    rows = index if project is None else index.filter(F.col("project_id") == project)
    return scored(rows, query).orderBy("distance", "chunk_id").limit(k)


def _filled(name: str) -> Column:
    """The value, NULL for an empty text: an empty affiliation is none."""
    return F.nullif(F.col(name), F.lit(""))


def affiliation_filter(level: str, equipment: str | None = None, sensor: str | None = None) -> Column:
    """Chunks of one level; an equipment or sensor that is NULL or empty is none."""
    same_equipment = _filled("equipment_id").eqNullSafe(F.lit(equipment or None))
    if level == "sensor":
        return same_equipment & _filled("sensor_type").eqNullSafe(F.lit(sensor or None))
    if level == "equipment":
        return same_equipment & _filled("sensor_type").isNull()
    return _filled("equipment_id").isNull() & _filled("sensor_type").isNull()


def affiliation_search(index: DataFrame, query: list[float], project: str, level: str, equipment=None, sensor=None, k: int = 5) -> DataFrame:
    """Nearest chunks of one affiliation level."""
    rows = index.filter(affiliation_filter(level, equipment, sensor))
    return vector_topk(rows, query, project, k).withColumn("affiliation_level", F.lit(level))


#: Columns that a search ranks by; everything else is fetched for the rows it returns.
_RANKED = ["chunk_id", "distance", "similarity_score", "equipment_id", "sensor_type"]


def hierarchical_search(index: DataFrame, query: list[float], project: str, equipment: str | None = None, sensor: str | None = None, k: int = 5) -> DataFrame:
    """Sensor, then equipment, then general chunks until ``k`` are found.

    A level takes part only while the levels before it found fewer than ``k``.
    Without an equipment, or when no level finds anything, all chunks of the
    project are searched.

    One pass scores every chunk and keeps the ``k`` best of each level by a
    grouped limit: no task passes on more than ``k`` narrow rows of a level.
    The rules then look at no more than ``4 * k`` rows, and texts and other
    columns are fetched for the ``k`` rows that are returned.
    """
    levels = ["sensor", "equipment", "general"] if equipment and sensor else ["equipment", "general"] if equipment else []
    rows = scored(index.filter(F.col("project_id") == project).select("chunk_id", "equipment_id", "sensor_type", "embedding"), query)
    # each chunk stands for its level, and for the search of all chunks that follows when no level finds anything
    own = reduce(lambda c, i: c.when(affiliation_filter(levels[i], equipment, sensor), F.lit(i)), range(len(levels)), F.when(F.lit(False), F.lit(0)))
    stages = F.array_compact(F.array(own, F.lit(len(levels))))
    nearest = W.partitionBy("_stage").orderBy("distance", "chunk_id")
    best = rows.withColumn("_stage", F.explode(stages)).withColumn("_place", F.row_number().over(nearest)).filter(F.col("_place") <= k)
    # at most k rows per stage come here, so this window over all of them stays tiny
    before = F.count(F.lit(1)).over(W.orderBy("_stage").rangeBetween(W.unboundedPreceding, -1))
    wanted = F.when(F.col("_stage") < len(levels), F.col("_before") < k).otherwise(F.col("_before") == 0)
    staged = best.withColumn("_before", before).filter(wanted)
    named = F.array(*[F.lit(level) for level in levels]) if levels else F.array(F.lit(None).cast("string"))
    level = F.coalesce(F.get(named, F.col("_stage")), affiliation_level("equipment_id", "sensor_type"))
    found = dedupe_and_rank(staged.select(*_RANKED, level.alias("affiliation_level")), k)
    rest = [c for c in index.columns if c not in (*_RANKED, "embedding")]
    if not rest:
        return found
    # one row for each chunk id, also where an index holds an id twice
    texts = index.filter(F.col("project_id") == project).select("chunk_id", *rest).join(F.broadcast(found.select("chunk_id")), "chunk_id", "left_semi")
    texts = texts.groupBy("chunk_id").agg(F.first(F.struct(*rest)).alias("_rest")).select("chunk_id", "_rest.*")
    ranked = found.join(texts, "chunk_id").select("chunk_id", *[c for c in index.columns if c not in ("chunk_id", "embedding")], "distance", "similarity_score", "affiliation_level")
    return ranked.orderBy(level_priority("affiliation_level"), F.desc("similarity_score"), "chunk_id")


def dedupe_and_rank(results: DataFrame, k: int) -> DataFrame:
    """Best score per chunk, ordered by level and score, cut to ``k``."""
    rest = [c for c in results.columns if c != "chunk_id"]
    best = results.groupBy("chunk_id").agg(
        F.max_by(F.struct(*rest), F.struct("similarity_score", -level_priority("affiliation_level"))).alias("r")
    )
    return best.select("chunk_id", "r.*").orderBy(level_priority("affiliation_level"), F.desc("similarity_score"), "chunk_id").limit(k)


def group_by_document(results: DataFrame) -> DataFrame:
    """Search results per document with cut texts and rounded scores, best chunk first."""
    text = F.when(F.length("text") > PREVIEW, F.concat(F.substring("text", 1, PREVIEW), F.lit("..."))).otherwise(F.col("text"))
    score = F.round("similarity_score", 4)
    chunk = F.struct((-score).alias("_order"), "chunk_index", score.alias("similarity_score"), text.alias("content"), "page_number")
    best = F.max_by(F.struct("filename", "equipment_id", "sensor_type", "document_type", "affiliation_level"), F.struct("similarity_score", "chunk_id"))
    grouped = results.groupBy("doc_id").agg(best.alias("d"), F.array_sort(F.collect_list(chunk)).alias("_chunks"))
    return grouped.select("doc_id", "d.*", F.transform("_chunks", lambda c: c.dropFields("_order")).alias("chunks")).orderBy(
        level_priority("affiliation_level"), "doc_id"
    )


# --- reports and removal ---------------------------------------------------


def delete_document(index: DataFrame, project: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """The index without a document of a project, and the number of removed chunks."""
    hit = F.coalesce((F.col("project_id") == project) & (F.col("doc_id") == doc), F.lit(False))
    return index.filter(~hit), index.filter(hit).agg(F.count(F.lit(1)).alias("removed"))


def clear_documents(index: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.col("project_id") == project, F.lit(False))
    return index.filter(~hit), index.filter(hit).agg(F.count(F.lit(1)).alias("removed"))


def chunk_stats(index: DataFrame) -> DataFrame:
    """Chunk and document counts per project.

    Rows are first reduced to distinct documents, affiliations and pages, so
    the distinct counts run on a small table.
    """
    has_sensor = F.coalesce("sensor_type", F.lit("")) != ""
    has_equipment = ~has_sensor & (F.coalesce("equipment_id", F.lit("")) != "")
    reduced = index.groupBy("project_id", "doc_id", "equipment_id", "sensor_type", "page_number").agg(F.count(F.lit(1)).alias("n"))
    return (
        reduced.groupBy("project_id")
        .agg(
            F.sum("n").alias("total_chunks"),
            F.count_distinct("doc_id").alias("unique_documents"),
            F.count_distinct(F.when(has_equipment, F.struct("doc_id", "equipment_id"))).alias("equipment_specific_documents"),
            F.count_distinct(F.when(has_sensor, F.struct("doc_id", "equipment_id", "sensor_type"))).alias("sensor_specific_documents"),
            F.count_distinct(F.when(F.coalesce("page_number", F.lit(0)) != 0, F.struct("doc_id", "page_number"))).alias("pages_with_content"),
        )
        .withColumn(
            "general_documents",
            F.col("unique_documents") - F.col("equipment_specific_documents") - F.col("sensor_specific_documents"),
        )
    )


def chunk_file_types(index: DataFrame) -> DataFrame:
    """Chunks per project and file extension."""
    ext = F.substr(file_extension("filename"), F.lit(2))
    return index.groupBy("project_id", ext.alias("file_type")).agg(F.count(F.lit(1)).alias("chunks"))


def document_stats(documents: DataFrame) -> DataFrame:
    """``metric, key, value`` rows: documents and bytes, documents per file type and equipment, sensor types."""
    total = documents.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("b")).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(c).alias("value"))
                    for m, c in (("unique_documents", "d"), ("total_size_bytes", "b"))
                ]
            )
        )
    )
    by_type = documents.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    by_equipment = documents.filter(F.coalesce("equipment_id", F.lit("")) != "").groupBy(F.col("equipment_id").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    sensors = documents.filter(F.coalesce("sensor_type", F.lit("")) != "").groupBy(F.col("sensor_type").alias("key")).agg(F.lit(1).cast("bigint").alias("value"))
    named = [(by_type, "file_type"), (by_equipment, "equipment"), (sensors, "sensor_type")]
    for df, metric in named:
        total = total.unionByName(df.select(F.lit(metric).alias("metric"), "key", "value"))
    return total


def list_documents(index: DataFrame) -> DataFrame:
    """One row per document with the metadata of its first chunk."""
    first = F.min_by(F.struct("filename", "document_type", "equipment_id", "sensor_type", "total_chunks"), "chunk_index")
    return index.groupBy("project_id", "doc_id").agg(first.alias("d")).select("project_id", "doc_id", "d.*")
