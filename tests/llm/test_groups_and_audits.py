"""Vector groups, source audit and spelling variants against brute force, with small blocks, colliding digests and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import source_audit, spelling, vector_groups
from gaugeflow.llm.source_audit import audit_sources
from gaugeflow.llm.spelling import near_words, spelling_variants
from gaugeflow.llm.vector_groups import one_of_each, similar_vectors

VECTOR = "vec_id long, embedding array<double>, row int"


def vectors(n, width, rng):
    out = []
    while len(out) < n:
        c = rng.normal(size=width)
        for _ in range(int(rng.choice([1, 1, 2, 5, 60]))):
            out.append((c / np.linalg.norm(c) + rng.normal(size=width) * rng.choice([0.0, 0.02, 0.15, 0.3]) / np.sqrt(width)).tolist())
    # a chain: neighbours are similar, its ends are not
    return out + [(np.cos(t / 4) * np.eye(width)[0] + np.sin(t / 4) * np.eye(width)[1]).tolist() for t in range(30)]


def linked(vs, bound=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vs]
    x = np.zeros((len(vs), max(len(v) for v in vs if v)))
    for i, v in enumerate(vs):
        if ok[i]:
            x[i, : len(v)] = v
            x[i] /= np.abs(x[i]).max()
            x[i] /= np.linalg.norm(x[i])
    similar = x @ x.T >= bound
    np.fill_diagonal(similar, False)
    label = list(range(len(vs)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(similar[i]))]) for i in range(len(vs))]
        if new == label:
            return similar.sum(1).tolist(), label
        label = new


@pytest.mark.parametrize("block,width", [(4096, 2), (16, 3), (16, 24)])
def test_vector_groups_against_all_pairs(spark, tmp_path, monkeypatch, block, width):
    monkeypatch.setattr(vector_groups, "BLOCK_ROWS", block)
    vs = vectors(250, width, np.random.default_rng(width))
    vs += [None, [], [0.0] * width, [float("nan")] * width, [None] + [1.0] * (width - 1), [1e-200] * width, [1e200] * width, [1.0], [1.0]]
    spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], VECTOR).write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    links, label = linked(vs)
    got = {r["vec_id"]: tuple(r)[1:] for r in similar_vectors(rows).collect()}
    assert got == {i: (links[i], label[i], label[i] == i) for i in range(len(vs))}
    kept = one_of_each(rows)
    assert kept.columns == rows.columns and sorted(r[0] for r in kept.select("vec_id").collect()) == sorted(set(label))


def test_vectors_across_cell_borders(spark, tmp_path, monkeypatch):
    """Many cells and no cores: each pair then depends on the copies behind the borders."""
    monkeypatch.setattr(vector_groups, "CORE_LEAST", 10**9)
    monkeypatch.setattr(vector_groups.math, "isqrt", lambda n: 2 * n)
    monkeypatch.setattr(vector_groups, "SAMPLE_ROWS", 400)
    vs = vectors(400, 3, np.random.default_rng(1))
    spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], VECTOR).write.parquet(f"{tmp_path}/v")
    links, label = linked(vs)
    got = {r["vec_id"]: tuple(r)[1:] for r in similar_vectors(spark.read.parquet(f"{tmp_path}/v")).collect()}
    assert got == {i: (links[i], label[i], label[i] == i) for i in range(len(vs))}


def test_vectors_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 6), (2, [1.0, 0.01], 7), (None, [0.0, 1.0], 8), (None, [0.0, 2.0], 9), (4, [0.0, 0.0], 1), (4, None, 2)]
    spark.createDataFrame(rows, VECTOR).coalesce(1).write.parquet(f"{tmp_path}/v")
    table = spark.read.parquet(f"{tmp_path}/v")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in similar_vectors(table).collect())
    assert got == [(0, 1, 0, False), (0, 1, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True)]
    assert sorted(r["row"] for r in one_of_each(table).collect()) == [1, 2, 5, 8]
    floats = table.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert similar_vectors(floats).where("n_links = 2").count() == 3
    assert similar_vectors(table.limit(0)).count() == 0 and one_of_each(table.limit(0)).count() == 0


def audited(docs, least, ranks):
    """Part by part from the words themselves."""
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in docs]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        seen = Counter(t for w in own for t in w[2])
        kept = [t for t in seen if seen[t] >= least]
        groups = {s: sum((w[2] for w in own if w[1] == s), Counter()) for s in {w[1] for w in own}}
        groups[None] = sum((w[2] for w in own), Counter())
        p = {}
        for s, n in groups.items():
            total = sum(n[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            if s is None:
                continue
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o not in (s, None))
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > p[None][t])[:ranks]
            for part, rows in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(rows)}
    return out


@pytest.mark.parametrize("bits,blocks,held,sent", [(64, 1 << 20, 400_000, 100), (3, 8, 5, 0), (1, 1, 5, 100), (8, 50, 40, 0)])
def test_source_audit_against_words(spark, monkeypatch, bits, blocks, held, sent):
    monkeypatch.setattr(source_audit, "BROADCAST_DIGESTS", sent)
    monkeypatch.setattr(source_audit, "BLOCK_COUNTS", blocks)
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(source_audit, "HELD", held)
    random.seed(4)
    vocabulary = ["Alpha", "beta", "gamma", "été", "ÉTÉ", "größe", "the", "The", "一二", "x", "zeta", "a1b", "rare"]
    docs = []
    for _ in range(150):
        lang, source = random.choice(["en", "en", "fr", None]), random.choice(["a", "a", "b", "é", None])
        text = random.choice([" ", "\n", ", ", "1"]).join(random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.randint(0, 12)))
        docs.append((lang, source, random.choice([text, text, None])))
    docs += [("xx", "s", "only once"), ("xx", "t", None), ("yy", "alone", "")] + [("dup", "u", "same words here")] * 12
    rows = spark.createDataFrame([(i, *d, 0) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, gid int").repartition(3)
    got = [tuple(r) for r in audit_sources(rows, least_docs=6, ranks=3, digest_bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(docs, 6, 3)


def test_source_audit_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 10)
    docs = [("en", "a", "word " * 5000), ("en", "b", "x" * 50_000), ("en", "c", "word other")]
    rows = spark.createDataFrame(docs, "lang string, source string, text string")
    assert {tuple(r) for r in audit_sources(rows, least_docs=1).collect()} == audited(docs, 1, 10)
    assert audit_sources(rows.limit(0)).count() == 0
    assert all(r["value"] == 0 for r in audit_sources(rows, least_docs=100).collect())


def test_shares_beyond_a_long(spark):
    row = spark.range(1).select(source_audit.share(F.lit(10**13), F.lit(3 * 10**13), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**6)
    counts = np.array([[10**13, 5]])
    assert source_audit._shares(counts, np.array([3 * 10**13, 7]), 10**6).tolist() == [[row["p"], 1 + 10**9 * 7 // (7 + 2 * 10**6)]]


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("letters,small", [("ab", False), ("ab", True), ("aé÷zÀ", True)])
def test_spelling_variants_against_all_pairs(spark, monkeypatch, letters, small):
    if small:
        for name, value in (("BLOCK_WORDS", 7), ("HOT_BLOCKS", 10**9), ("WALK_WORDS", 20), ("ROW_BYTES", 100), ("HELD", 50), ("PIECE", 64), ("LETTER_BYTES", 400)):
            monkeypatch.setattr(spelling, name, value)
    random.seed(5)
    base, docs = ["".join(random.choice(letters) for _ in range(random.randint(7, 10))) for _ in range(50)], []
    for d in range(60):
        words = []
        for _ in range(90):
            w = random.choice(base[:3] if random.random() < 0.5 else base)
            if random.random() < 0.15:
                k = random.randrange(len(w))
                w = w[:k] + random.choice(["", random.choice(letters), w[k] + random.choice(letters)]) + w[k + 1 :]
            words.append(random.choice([w, w.upper() if w.isascii() else w]))
        docs.append((d, " ".join(words)))
    docs += [(None, "aaaaaaaa " * 30), (7, None), (8, ""), (9, "Ünïcode€word zzzzzzzzzz " + " ".join(["q" * 3000, "q" * 3001] * 3)), (9, "x" * 9)]
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    assert {r["word"]: tuple(r)[1:] for r in spelling_variants(rows).collect()} == variants(docs)


def test_spelling_of_chains_and_empty_tables(spark):
    docs = [(i, "lettering " * 2000 + "letterings " * 150 + "letteringss " * 11 + "letteringsss") for i in range(4)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(rows).collect()}
    assert got == variants(docs)
    assert spelling_variants(rows.limit(0)).count() == 0
    assert near_words(rows.select(F.lit("aloneword").alias("word"), F.lit(2).cast("long").alias("n")).limit(1)).count() == 0
