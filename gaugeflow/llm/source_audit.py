"""Source divergence audit: how far the word use of each source is from the other sources and from its language as a whole.

Only fixed-width digests of terms are counted and shuffled. A task writes each
of its terms once as text, beside its counts; that text stays in its file
until the terms to keep are known. Then the smallest and the largest text of
each kept digest are taken; where they differ, two terms share the digest, and
the documents' terms of that digest alone are counted again by their text.
Text is joined back for the terms that a report shows, nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.llm.common import written
from gaugeflow.session import work_folder

#: Documents of its language that a term has to be in, and ranks of the term report.
LEAST_DOCS, RANKS = 10, 10
SCALE = 1_000_000_000
#: Counters of a task before they are passed on, and characters of text that are cut at once.
HELD, PIECE = 800_000, 1 << 20
#: Kept digests that are sent to all tasks, 16 bytes each, to pick their texts; more are joined by a shuffle.
BROADCAST_DIGESTS = 2_000_000
#: Counts of a block of terms by sources, and sources of a block that are held against all others.
BLOCK_COUNTS, BLOCK_SOURCES = 1 << 20, 256
#: Above this count the product with SCALE leaves a long.
LARGE_COUNT = 9_000_000_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in pieces: runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, as UTF-8.

    Pieces end at a space, or at the end of a run that has none.
    """
    raw, at = text.encode("utf-8", "surrogatepass").translate(_LETTERS), 0
    while len(raw) - at > PIECE:
        end = raw.find(b" ", at + PIECE)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def digest(term: bytes, bits: int) -> int:
    """``bits`` bits of a 64-bit hash, as a long."""
    return (xxhash.xxh3_64_intdigest(term) >> (64 - bits)) - (1 << (bits - 1))


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def sources_of(named: DataFrame) -> tuple[DataFrame, int]:
    """lid, gid, lang, source of every (lang, source), and the seed of these hashes: the first that gives no two of them the same."""
    groups = written(named.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        keyed = groups.select(_lid(seed).alias("lid"), _gid(seed).alias("gid"), "lang", "source")
        n, langs, gids, lids = keyed.agg(F.count("*"), F.countDistinct("lang"), F.countDistinct("gid"), F.countDistinct("lid")).first()
        if n == gids and langs == lids:
            return keyed, seed
        seed += 1


def _lid(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("lang"), "lang")


def _gid(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("group"), "lang", "source")


def counted_terms(named: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts of each task (lid, gid, digest, n, docs), and its terms once (digest, term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            for (lid, gid), (n, docs) in held.items():
                for term in n:
                    if term not in known:
                        known[term] = digest(term, bits)
                keys = list(n)
                yield _counts(lid, gid, [known[t] for t in keys], [n[t] for t in keys], [docs[t] for t in keys])
            words = list(known)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["terms"] * len(part)), none, none, pa.array([known[t] for t in part], pa.int64()), none, none, pa.array(part, pa.binary()).cast(pa.string())], names=NAMES)
            held.clear()

        for batch in batches:
            lids, gids, texts = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                n, docs = held.setdefault((lids[i].as_py(), gids[i].as_py()), (Counter(), Counter()))
                own: set[bytes] = set()
                before = len(n)
                for piece in terms(texts[i].as_py()):
                    n.update(piece)
                    own.update(piece)
                docs.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from passed()
                    size = 0
        yield from passed()

    spark = named.sparkSession
    path = work_folder(spark, "terms")
    named.mapInArrow(count, "part string, lid long, gid long, digest long, n long, docs long, term string").write.partitionBy("part").parquet(path)
    schema = "lid long, gid long, digest long, n long, docs long, term string, part string"
    rows = spark.read.schema(schema).parquet(path)
    return rows.where("part = 'counts'").select("lid", "gid", "digest", "n", "docs"), rows.where("part = 'terms'").select("digest", "term")


NAMES = ["part", "lid", "gid", "digest", "n", "docs", "term"]


def _counts(lid: int, gid: int, digests: list[int], n: list[int], docs: list[int]) -> pa.RecordBatch:
    size, long = len(digests), pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(["counts"] * size, pa.string()), pa.array([lid] * size, long), pa.array([gid] * size, long), pa.array(digests, long), pa.array(n, long), pa.array(docs, long), pa.nulls(size, pa.string())],
        names=NAMES,
    )


def _recounted(named: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """lid, gid, digest, term, n, docs of every term whose digest another term has, too; only their text travels."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n: Counter = Counter()
                for piece in terms(batch.column(2)[i].as_py()):
                    n.update(piece)
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i : i + 1].take(pa.array([0] * size, pa.int32())), batch.column(1)[i : i + 1].take(pa.array([0] * size, pa.int32())), pa.array([digest(t, bits) for t in n], pa.int64()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())],
                    names=["lid", "gid", "digest", "term", "n"],
                )

    every = named.mapInArrow(split, "lid long, gid long, digest long, term string, n long")
    return every.join(collided, "digest", "left_semi").groupBy("lid", "gid", "digest", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def kept_terms(named: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms that each language keeps (lid, gid, digest, split, n), and the text of each (digest, split, term).

    ``split`` is NULL but for terms that share their digest with another one; there it is the term.
    """
    counts, texts = counted_terms(named, bits)
    # Tasks have combined their counts, so rows are dealt by digest at once; sums by source and by language then need no further shuffle.
    by_group = counts.repartition("lid", "digest").groupBy("lid", "gid", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_lang = Window.partitionBy("lid", "digest")
    # A digest has as many documents as its terms together, so no kept term is lost here.
    likely = written(by_group.withColumn("all_docs", F.sum("docs").over(by_lang)).where(F.col("all_docs") >= least_docs).drop("all_docs"), "likely")
    wanted = likely.select("digest").distinct()
    if wanted.count() <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    spelled = texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
    spelled = written(spelled, "spelled")
    collided = spelled.where("least <> most").select("digest")
    alone = likely.select("lid", "gid", "digest", F.lit(None).cast("string").alias("split"), "n")
    names = spelled.select("digest", F.lit(None).cast("string").alias("split"), F.col("least").alias("term"))
    if not collided.limit(1).count():
        return alone, names
    again = _recounted(named, collided, bits).withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lid", "digest", "term"))).where(F.col("all_docs") >= least_docs)
    again = written(again.select("lid", "gid", "digest", F.col("term").alias("split"), "n"), "split")
    alone = alone.join(collided, "digest", "left_anti").unionByName(again)
    names = names.join(collided, "digest", "left_anti").unionByName(again.select("digest", "split", F.col("split").alias("term")).distinct())
    return alone, names


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) in whole numbers."""
    below = (total + 2 * kept).cast("decimal(20,0)")
    exact = F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)"), below)
    quick = F.call_function("div", F.lit(SCALE) * (count + 2), total + 2 * kept)
    return F.lit(1) + F.when(count < LARGE_COUNT, quick).otherwise(exact)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """``share`` of terms by sources."""
    if counts.size and counts.max() >= LARGE_COUNT:
        return 1 + (SCALE * (counts.astype(object) + 2) // (totals.astype(object) + 2 * kept)).astype(np.int64)
    return 1 + SCALE * (counts + 2) // (totals + 2 * kept)


def between_sources(table: pa.Table) -> pa.Table:
    """Sums of distances of some sources of a language to its others, over one block of its terms."""
    rows = table.to_pylist()
    profile = next(r for r in rows if r["gids"] is not None)
    kept, tile = profile["kept"], profile["tile"]
    gids, totals = np.array([g["gid"] for g in profile["gids"]], np.int64), np.array([g["total"] for g in profile["gids"]], np.int64)
    place = {g: i for i, g in enumerate(gids.tolist())}
    found = [r for r in rows if r["gids"] is None]
    counts = np.zeros((len(found), len(gids)), np.int64)
    for i, r in enumerate(found):
        for x in r["counts"]:
            counts[i, place[x["gid"]]] = x["n"]
    p = _shares(counts, totals, kept) if kept else np.zeros((0, len(gids)), np.int64)
    one, other, value = [], [], []
    for g in range(tile * BLOCK_SOURCES, min(len(gids), (tile + 1) * BLOCK_SOURCES)):
        own, rest = p[:, g : g + 1], p[:, g + 1 :]
        one.append(np.full(rest.shape[1], gids[g]))
        other.append(gids[g + 1 :])
        value.append(((own - rest) ** 2 // np.maximum(own + rest, 1)).sum(axis=0))
    joined = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.table({"gid": joined(one), "other": joined(other), "value": joined(value)})


def _pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """gid, other, value of every two sources of a language, both ways."""
    profile = totals.groupBy("lid").agg(F.array_sort(F.collect_list(F.struct("gid", "total"))).alias("gids"), F.max("kept").alias("kept"))
    # Blocks of terms and of sources: no task holds more counts than BLOCK_COUNTS, or those of a single term.
    sources = F.size("gids")
    profile = profile.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * sources / BLOCK_COUNTS)).cast("long")).withColumn("tiles", F.ceil(sources / BLOCK_SOURCES).cast("long"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    heads = profile.select("lid", "gids", "kept", F.explode(upto("blocks")).alias("block"), "tiles").select("*", F.explode(upto("tiles")).alias("tile")).drop("tiles")
    terms_of = kept.groupBy("lid", "digest", "split").agg(F.collect_list(F.struct("gid", "n")).alias("counts")).join(profile.select("lid", "blocks", "tiles"), "lid")
    spread = terms_of.select("lid", F.pmod(F.xxhash64("digest", "split"), "blocks").alias("block"), "counts", F.explode(upto("tiles")).alias("tile"))
    rows = heads.select("lid", "block", "tile", "gids", "kept", F.lit(None).cast("array<struct<gid:bigint,n:bigint>>").alias("counts"))
    rows = rows.unionByName(spread.select("lid", "block", "tile", F.lit(None).cast("array<struct<gid:bigint,total:bigint>>").alias("gids"), F.lit(None).cast("long").alias("kept"), "counts"))
    sums = rows.groupBy("lid", "block", "tile").applyInArrow(between_sources, "gid long, other long, value long").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    sums = written(sums, "pairs")
    return sums.unionByName(sums.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS, digest_bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how a source differs from others and by which terms.

    Part ``pair`` has the distance to each other source of the language, all
    ranks; part ``term`` the ``ranks`` kept terms that the source uses more
    than its language, with the largest distances. A language keeps the terms
    in at least ``least_docs`` of its documents; the shares p and distances
    are whole numbers, as ``share`` and ``distance`` state. Ranks go by value
    from the largest, then by item in the order of UTF-8.

    NULL texts, languages and sources are empty strings. Repeated rows count
    as often as they stand there. A source without terms has counts of 0; a
    language that keeps no term has distances of 0 and no term rows. Without
    documents there are no rows. Other columns are not looked at.
    ``digest_bits`` below 64 makes digests collide more; results are the same.
    """
    named = _named(docs, text, lang, source)
    groups, seed = sources_of(named)
    named = named.select(_lid(seed).alias("lid"), _gid(seed).alias("gid"), "text")
    kept, names = kept_terms(named, least_docs, digest_bits)
    by_lang = kept.groupBy("lid", "digest", "split").agg(F.sum("n").alias("lang_n"))
    langs = by_lang.groupBy("lid").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(kept.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(langs, "lid", "left")
    totals = written(totals.select("lid", "gid", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")]), "totals")

    pairs = _pairs(kept, totals).join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other").select("gid", F.lit("pair").alias("part"), "item", "value")
    same = F.col("split").eqNullSafe(F.col("lang_split"))
    whole = by_lang.select(F.col("lid").alias("lang_lid"), F.col("digest").alias("lang_digest"), F.col("split").alias("lang_split"), "lang_n")
    used = kept.join(whole, (F.col("lid") == F.col("lang_lid")) & (F.col("digest") == F.col("lang_digest")) & same).join(totals.drop("lid"), "gid")
    used = used.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("p > q")
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"))
    # Terms that may reach the report, with all ties, get their text; the order among ties needs it.
    shown = used.select("gid", "digest", "split", distance(F.col("p"), F.col("q")).alias("value")).withColumn("place", F.rank().over(by_value)).where(F.col("place") <= ranks)
    names = names.select(F.col("digest").alias("name_digest"), F.col("split").alias("name_split"), "term")
    spelled = shown.join(names, (F.col("digest") == F.col("name_digest")) & F.col("split").eqNullSafe(F.col("name_split"))).select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("gid", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(spelled).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return ranked.join(groups, "gid").select("lang", "source", "part", "item", "value", "rank")

