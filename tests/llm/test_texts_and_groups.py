"""Tokenizers, language, deduplication, the n-gram join and the pipeline: brute force, libraries and edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import language, line_dedup, ngram_join, substring_dedup
from gaugeflow.llm.bpe import Neighbours
from gaugeflow.llm.components import components
from gaugeflow.llm.language import UNKNOWN, fit, predict, sample, words_of
from gaugeflow.llm.queries import tokenizer_file
from gaugeflow.llm.sentencepiece_fst import Transducer, decode, encode, load_model
from gaugeflow.llm.token_counts import CountTransducer, count_tokens, load_merges

DOC = "doc_id long, text string"
PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
SIGNS = ["a", "the", "ing", "'", "'s", "'re", "'v", "'l", "l", " ", "  ", "\n", "1", "²", "é", "é", "İ", "Σ", "日本", "😀", "!", "?!", "▁", "<|endoftext|>", "\x1c", "\x85", "\x00", "̈"]


def random_texts(n, seed):
    random.seed(seed)
    return ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 14))) for _ in range(n)]


def test_encoding_equals_the_library():
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(load_model(PIECES))
    for x in [*random_texts(3000, 1), " " * 70, "ab" * 3000, "\n\n\t"]:
        ids = machine.encode(x).tolist()
        assert ids == library.encode(x), repr(x)
        assert machine.decode(ids) == x.replace("▁", " ")


def test_unigram_path_is_the_best_one():
    pieces = [("<unk>", 0.0, 0), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("▁a", -2.5, 1), ("bb", -9.0, 1)]
    machine = Transducer({"bpe": False, "prefix": True, "squeeze": False, "unknown": 0, "pieces": pieces})
    assert machine.encode("abb").tolist() == [5, 3, 3] and machine.encode("xab").tolist() == [1, 0, 4]


def test_encode_and_decode_rows(spark):
    rows = [(1, "It is. Ñ"), (2, None), (3, ""), (3, ""), (None, "x" * 300_000)]
    docs = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit(1)).withColumn("__x", F.lit(2))
    got = encode(docs, PIECES, check="ok")
    assert got.columns == ["doc_id", "__x", "ids", "ok"]
    assert sorted((r["doc_id"] or 0, r["ok"], r["ids"] is None) for r in got.collect() if r["ok"] is not None) == [(0, True, False), (1, True, False), (3, True, False), (3, True, False)]
    back = {r["doc_id"]: r["text"] for r in decode(got, PIECES).collect()}
    assert back == dict(rows) and encode(docs.limit(0), PIECES).count() == 0


def test_counts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from gaugeflow.llm import token_counts

    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    machine = CountTransducer(load_merges(WORDS))
    texts = [*random_texts(3000, 2), "ab" * 3000, "'", "'r", "a'", "''s"]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [machine.count(x) for x in texts] == want
    monkeypatch.setattr(token_counts, "CHUNK", 3)  # maps of chunks compose to the same
    monkeypatch.setattr(token_counts, "STATE_LIMIT", 50)
    assert [machine.count(x) for x in texts] == want


def test_count_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "é " * 3000)], DOC).withColumn("n_tokens", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, WORDS).collect())
    assert got == [(0, 9000, 3000, True), (1, 3, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False)]
    assert count_tokens(docs.limit(0), WORDS).count() == 0


def test_neighbours_agree_with_merging():
    ranks = {"ab": 0, "bc": 1, "aa": 2, "abc": 3, "aab": 4, "ca": 5, "aaaa": 6}
    n = Neighbours(lambda a, b: (ranks[a + b], a + b) if a + b in ranks else None, list)
    tokens = [*"abc", *ranks]
    for a in tokens:
        for b in tokens:
            assert n.fit(a, b) == ([t[0] for t in n.merge(list(a + b))] == [a, b]), (a, b)


def test_language_model():
    random.seed(0)
    parts = {"xx": ["kra", "zok", "vri"], "yy": ["lua", "mio", "sena"]}

    def text(label, n=40):
        return " ".join("".join(random.choice(parts[label]) for _ in range(random.randint(1, 3))) for _ in range(n))

    model = fit([(label, words_of(text(label))) for label in parts for _ in range(30)])
    machine = language.Labeller(model)
    found = machine.languages([text("xx"), text("yy"), "", "1234 !!", text("xx", 3000)])
    assert [f[0] for f in found] == ["xx", "yy", UNKNOWN, UNKNOWN, "xx"] and found[0][1] > 0.9 and found[3][1] == 0
    switched = [words_of(text("xx", 10)) + words_of(text("yy", 10))]
    labels = machine.marginals(switched)[0].argmax(axis=1).tolist()
    assert labels == [0] * 10 + [1] * 10


def test_forward_backward_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    step, lengths = rng.normal(size=(3, 3)), np.array([1, 4, 3])
    scores = rng.normal(size=(8, 3))
    got, start = language.forward_backward(scores, lengths, step), 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(scores[start + t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(got[start : start + n], total / total.sum(axis=1, keepdims=True))
        start += n


def test_language_rows_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "", None), (None, "…", "b")], DOC + ", score string")
    model = fit([])
    assert {(r["lang_pred"], r["score"]) for r in predict(odd, model).collect()} == {(UNKNOWN, 0.0)}
    assert language.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).count() == 4
    assert language.language_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs_against_brute_force(spark, m):
    random.seed(m)
    rows = [(i, "\n".join(random.choice(["a", "b", "c", "", " ", "d" * 9]) for _ in range(random.randint(0, 12)))) for i in range(40)]
    rows += [(7, rows[7][1]), (100, None), (101, ""), (102, "hot\nhot\nhot\nhot\nhot\nhot")]
    df = spark.createDataFrame(rows, DOC).withColumn("at", F.lit(1)).withColumn("removed_lines", F.lit(0)).coalesce(1)
    got = sorted((r["doc_id"], r["text"] or "", r["removed_lines"]) for r in line_dedup.drop_repeated_lines(df, m).collect())
    seen, want = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        filled, gone = [k for k, x in enumerate(lines) if x.strip()], set()
        for k in range(len(filled) - m + 1):
            run = tuple(lines[j] for j in filled[k : k + m])
            if run in seen:
                gone |= set(filled[k : k + m])
            seen.add(run)
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), sorted(gone)))
    assert got == sorted(want)
    assert line_dedup.line_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [500_000, 3])
def test_passages_against_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD_UNITS", held)
    random.seed(4)
    clauses = [" ".join(random.choice(["red", "old", "sea", "ÉTÉ", "fox"]) for _ in range(random.randint(1, 9))) for _ in range(25)]
    rows = [(i, "".join(random.choice(clauses) + random.choice([". ", ", ", "\n", "? "]) for _ in range(random.randint(0, 20)))) for i in range(40)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (50, None), (51, "")]
    df = spark.createDataFrame(rows, DOC).withColumn("first", F.lit(1)).withColumn("removed", F.lit(0)).coalesce(1)
    got = {}
    for r in substring_dedup.drop_repeated_passages(df).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], [tuple(s) for s in r["removed"]]))
    seen = set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        later = []
        for n, (_, _, words) in enumerate(substring_dedup.units_of(text or "", 5)):
            if " ".join(words) in seen:
                later.append(n)
            seen.add(" ".join(words))
        spans = substring_dedup.removable(text or "", later, 5, 12)
        left = text and "".join(c for k, c in enumerate(text) if not any(s <= k < e for s, e in spans))
        assert (left, spans) in got[i]
    assert substring_dedup.passage_report(df.limit(0)).count() == 0


def test_long_single_lines(spark):
    long, other, short = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 50), ("c", 49)))
    texts = [long, f"own\n{long}\nend", long, f"{other}\n{short}", f"{short}\n\n{other}\n{other}", f"x\n{other}\n{short}", None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in enumerate(texts)], DOC + ", lang string, source string, n_chars long").coalesce(1)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {0: (long, 7), 1: ("own\nend", 7), 3: (texts[3], 7), 4: (f"{short}\n", len(short) + 1), 5: ("x", 1), 6: (None, 7), 7: ("", 7)}
    plain = {r["doc_id"]: r["removed_lines"] for r in line_dedup.drop_repeated_lines(df).collect()}
    assert {k: v for k, v in plain.items() if v} == {5: [1, 2]}


def independent_passages(rows):
    """Removed words of every text: all stretches of clauses that an earlier text has, compared one by one."""
    before, out = [], []
    for _, text in rows:
        clauses = [(m.start(), m[0].lower().split()) for m in re.finditer(r"[a-z][a-z0-9 ]*", text)]
        words, gone = [w for _, w in clauses], set()
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if (j - i == 1 and len(words[i]) >= 5) or sum(map(len, words[i:j])) >= 12:
                    if any(words[i:j] == old[k : k + j - i] for old in before for k in range(len(old))):
                        gone |= set(range(i, j))
        run, kept = [], set()
        for k in [*range(len(words)), None]:
            if k in gone:
                run.append(k)
            elif k is None or len(words[k]) >= 5:
                kept |= set(run) if sum(len(words[i]) for i in run) >= 12 else set()
                run = []
        out.append([w for k, w in enumerate(words) if k not in kept])
        before.append(words)
    return out


def test_short_clauses_against_independent_brute_force(spark):
    random.seed(21)
    clauses = [" ".join(random.choice("abcdefgh") + str(k) for k in range(random.choice([1, 1, 2, 3, 4, 5, 7, 13]))) for _ in range(60)]
    stretches = [[random.choice(clauses) for _ in range(random.randint(2, 14))] for _ in range(10)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(random.randint(1, 4)):
            stretch = random.choice(stretches)
            parts += random.sample(clauses, random.randint(0, 5)) if random.random() < 0.5 else stretch[: random.randint(1, 14)]
        parts = [c for k, c in enumerate(parts) if c not in parts[:k]]  # no copies inside a text
        rows.append((i, "".join(c + random.choice([". ", ", ", "; "]) for c in parts)))
    got = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOC).coalesce(1)).collect()}
    left = [[m[0].split() for m in re.finditer(r"[a-z][a-z0-9 ]*", got[i]) if m[0].strip()] for i, _ in rows]
    want = independent_passages(rows)
    assert [[w for c in x for w in c] for x in left] == [[w for c in x for w in c] for x in want]


def test_own_short_text_stays_and_short_clauses_go(spark):
    letter = "We write to you about the claim as follows: {}. The reason that you have given us for it was: {}. We thank you for your patience with us"
    listed, other = ", ".join(f"word{i}" for i in range(60)), ", ".join(f"word{i * 7 % 60}" for i in range(60))
    rows = [(1, letter.format("John Smith", "fire damage")), (2, letter.format("Ann Lee", "a flood")), (3, "Before. " + listed), (4, "Own text here, " + listed + ". Own end"), (5, other)]
    rows += [(6, "one two, three four five six; seven eight nine ten, eleven twelve"), (7, "One, two three; four five, six seven; eight. Nine: ten eleven, twelve\nrest"), (8, "ha, " * 30)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOC).coalesce(1)).collect()}
    assert got[1] == rows[0][1] and "Ann Lee" in got[2] and "a flood" in got[2] and "claim" not in got[2] and "patience" not in got[2]
    assert got[4] == "Own text here, . Own end" and got[5] == other  # the same words in another order are no copy
    assert got[7] == "\nrest" and got[8].count("ha") == 12  # cut by other signs; the first copy of a repetition stays whole


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 95), (95, 93), (90, 95)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 93, 95)} == {90}


def brute_groups(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(s), d if not s else min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("limits", [(2000, 500_000), (6, 0)])
def test_join_against_brute_force(spark, limits, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", limits[0])
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", limits[1])
    random.seed(limits[0])
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(8):
        base = [random.choice(vocabulary) for _ in range(random.randint(5, 60))]
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((len(rows), random.choice([" ", "\n"]).join(copy)))
    rows += [(200, "A b"), (201, "a B"), (202, "a b c"), (203, None), (204, ""), (205, " \t"), (None, rows[0][1]), (None, "only here once"), (0, rows[0][1]), (206, "é b c d f"), (207, "É b c d f")]
    df = spark.createDataFrame(rows, DOC).withColumn("node", F.lit(1)).withColumn("n", F.lit("x")).coalesce(1)
    got = sorted(map(repr, map(tuple, ngram_join.jaccard_report(df).collect())))
    assert got == sorted(map(repr, brute_groups(rows)))
    kept = [r["doc_id"] for r in ngram_join.one_of_each(df).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, {c for _, n, c in brute_groups(rows) if n} | {203, 204, 205}))
    assert ngram_join.jaccard_report(df.limit(0)).count() == 0


def test_join_of_appended_and_cut_copies(spark):
    random.seed(12)
    rows, fresh = [], iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    for n in (24, 60, 104, 304):
        for j in (0.75, 0.76, 0.8, 0.83, 0.87, 0.9):
            base = words(n)
            more = int((n - 4) * (1 / j - 1))
            rows.append(base)
            rows.append(random.choice([base + words(more), words(more) + base]))  # appended or put before
            base = words(n)
            rows += [base, base[: 4 + -int(-(n - 4) * j // 1)]]  # cut
            rows.append(words(n))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, DOC).coalesce(1)
    got, want = sorted(map(tuple, ngram_join.jaccard_report(df).collect())), sorted(brute_groups(rows))
    assert sum(d != c for d, _, c in want) >= 40
    assert got == want


def test_one_of_each_with_repeated_and_missing_ids(spark):
    text = {x: " ".join(f"{x}{i}" for i in range(20)) for x in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["c"] + " more"), (None, text["d"]), (5, text["d"]), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, at) for at, r in enumerate(rows)], DOC + ", at int").coalesce(1)
    assert sorted(r["at"] for r in ngram_join.one_of_each(df).collect()) == [0, 1, 3, 7, 8, 9]


def test_pipeline_stages(spark, tmp_path):
    random.seed(9)
    en = ["the", "and", "with", "river", "house", "green", "walking", "stone"]
    de = ["der", "und", "mit", "fluss", "haus", "gruen", "gehend", "stein"]

    def text(words, n=40):
        return " ".join(f"{random.choice(words)}{random.choice(['', '', 'er', 'en'])}" for _ in range(n))

    item = text(en, 15)
    rows = [(i, text(en if i % 2 else de), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows.append((60, rows[1][1] + " more", "en", "s", 1))  # a near copy
    rows.append((61, text(en) + "\n" + item, "en", "s", 1))  # a leak
    rows.append((62, "line one is here\nline two is here\n" + rows[3][1].upper(), "en", "s", 1))
    rows.append((63, "line one is here\nline two is here\n" + text(de), "de", "s", 1))
    rows += [(64, None, "en", "s", 1), (65, "12 34", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(kept["language_id"]) == set(range(64))
    assert set(kept["line_dedup"]) == set(range(64)) and not kept["line_dedup"][63]["text"].startswith("line one")
    # row 62 is row 3 with eight words before it: 36 of 44 shingles are shared
    assert set(kept["ngram_join"]) == set(range(64)) - {60, 62}
    assert set(kept["decontamination"]) == set(range(64)) - {60, 61, 62}
    assert set(kept["sentencepiece"]) == set(kept["decontamination"]) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in kept["sentencepiece"].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 61


def test_models_reach_bare_workers(tmp_path):
    """Started from another folder, without the package on any path of the workers, predictions come from the broadcast alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
sys.path.insert(0, {repo!r})
from gaugeflow.session import build_session
from gaugeflow.llm.language import fit, predict
spark = build_session("local[1]", "bare", 1)
model = fit([("en", ["the", "river"] * 20), ("de", ["der", "fluss"] * 20)])
rows = predict(spark.createDataFrame([(1, "the river"), (2, "der fluss"), (3, None)], "doc_id long, text string"), model)
print(sorted((r.doc_id, r.lang_pred) for r in rows.collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(1, 'en'), (2, 'de'), (3, 'und')]" in done.stdout, done.stderr[-2000:]


def test_language_sample_of_repeated_ids(spark):
    """Copies of a chosen id don't add to the sample."""
    rows = [(7, f"the river {i}", "en") for i in range(500)] + [(i, "der fluss", "de") for i in range(20)]
    got = Counter(lang for lang, _ in sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=15))
    assert got == {"en": 15, "de": 15}


def test_parity_maps_bound_what_sets_share():
    """The bound is never below the true overlap, for sets of any sizes, and tells unlike sets of like sizes apart."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n, m, shared in [(1, 1, 0), (1, 1, 1), (300, 200, 150), (5000, 256, 256), (700, 700, 0), (70_000, 66_000, 60_000), (4000, 3000, 2999)]:
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, m - shared, dtype=np.uint64)]))
        p, q = ngram_join.parity(a), ngram_join.parity(b)
        most = ngram_join.most_shared(p, q, len(a), len(b))
        assert most == ngram_join.most_shared(q, p, len(b), len(a)) and most >= len(np.intersect1d(a, b))
        if (n, m, shared) == (700, 700, 0):
            assert 100 * most < 75 * (n + m - most)


def test_passages_keep_clashing_columns(spark):
    line = "a passage of many words that stands in both of these texts, word for word and all"
    names = "doc_id long, text string, __row string, __ROW_ string, __later int, `Removed` int"
    df = spark.createDataFrame([(1, line, "x", "y", 3, 4), (2, line, "z", None, 6, 7)], names).coalesce(1)
    got = substring_dedup.drop_repeated_passages(df)
    assert got.columns == ["doc_id", "text", "__row", "__ROW_", "__later", "removed"]
    assert sorted(map(tuple, got.collect())) == [(1, line, "x", "y", 3, []), (2, "", "z", None, 6, [(0, len(line))])]


def member_lists(lists, columns):
    import pyarrow as pa

    kind = pa.struct([(c, pa.int64()) for c in ("node", "n", "matched", "label", "weight")])
    return pa.table({"members": pa.array(lists, pa.list_(kind)), "n_columns": columns}).to_batches()


def test_rows_of_unlike_sizes_are_no_candidates():
    """A row shares no more columns than it has, however many lie behind the longer one's prefix."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n = rng.integers(20, 900, 150)
    members = [{"node": i, "n": int(x), "matched": ngram_join.prefix_length(int(x)), "label": i, "weight": 1} for i, x in enumerate(n)]
    lists = member_lists([members, members[:40]], [3, 2])
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])}
    rows = pa.Table.from_batches(ngram_join._partial_rows(iter(lists))).sort_by("a")
    assert {(a, b) for a, others in zip(*(rows[c].to_pylist() for c in ("a", "others"))) for b in others} == want
    pairs = [p for batch in ngram_join._accumulate(iter(rows.to_batches())) for p in zip(*(c.to_pylist() for c in batch.columns))]
    assert len(pairs) == len(set(pairs)) and 0 < len(pairs) < len(want) and set(pairs) <= want


def test_long_lists_leave_in_parts(monkeypatch):
    """However many lists a batch has, few pairs are held at once, and the sums stay."""
    import pyarrow as pa

    members = [{"node": i, "n": 40, "matched": 11, "label": i, "weight": 1} for i in range(60)]
    lists = member_lists([members] * 30, [1] * 30)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60)}
    monkeypatch.setattr(ngram_join, "PAIRS", 500)
    parts = list(ngram_join._partial_rows(iter(lists)))
    assert len(parts) > 30 and max(len(p.column(2).flatten()) for p in parts) <= 1100
    pairs = [p for batch in ngram_join._accumulate(iter(pa.Table.from_batches(parts).sort_by("a").to_batches())) for p in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(pairs) == sorted(want)


def test_words_are_found_before_signs_and_beginnings_stay(monkeypatch):
    """A word is the same chunk with and without a sign behind it, and beginnings in use outlive a full table."""
    import sentencepiece

    from gaugeflow.llm import sentencepiece_fst

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(load_model(PIECES))
    assert machine.chunk.findall("▁word,▁word") == ["▁word", ",", "▁word"]
    monkeypatch.setattr(sentencepiece_fst, "KEPT_PATHS", 40)
    random.seed(3)
    for _ in range(300):
        x = " ".join("under" + random.choice("abcde") + random.choice([",", "-", "1", "'s", "é", ":\n", ""]) for _ in range(5))
        assert machine.encode(x).tolist() == library.encode(x), repr(x)
    assert "▁under" in machine.paths or "▁under" in machine.older_paths
    assert len(machine.paths) + len(machine.older_paths) < 300


def test_signs_behind_words_are_chunks_of_their_own():
    """Also where another character that counts as a letter stands before the sign in a piece."""
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(load_model(PIECES))
    assert machine.chunk.findall("▁one.\nNext▁m².▁(é).") == ["▁one", ".\n", "Next", "▁m².", "▁(", "é", ")."]
    for x in ["one.\nNext m². (é).", "².a", "x².²y", "1.a.1", "▁.▁a.▁", "a.", ".a", "²", "ª.º!"]:
        assert machine.encode(x).tolist() == library.encode(x), repr(x)


def test_the_only_path_is_what_merging_gives(monkeypatch):
    """Small models, also with letters that are no piece by themselves; few beginnings and pairs are kept."""
    from gaugeflow.llm import sentencepiece_fst

    monkeypatch.setattr(sentencepiece_fst, "KEPT_PATHS", 4)
    monkeypatch.setattr(sentencepiece_fst, "KEPT_PAIRS", 5, raising=False)
    rng = random.Random(5)
    for singles in ["▁ab", "▁abcd"] * 40:
        made = []
        for _ in range(rng.randint(1, 18)):
            p = rng.choice([*"▁abcd", *made]) + rng.choice([*"abcd", *made])
            if p not in made and len(p) < 10 and "▁" not in p[1:]:
                made.append(p)
        if len(singles) == 5:  # a longer piece may come before its parts
            rng.shuffle(made)
        pieces = [("<unk>", 0.0, 0), *((p, -float(i), 1) for i, p in enumerate([*made, *singles]))]
        machine, ids = Transducer({"bpe": True, "prefix": True, "squeeze": False, "unknown": 0, "pieces": pieces}), {p[0]: i for i, p in enumerate(pieces)}
        merging = Neighbours(lambda a, b: (ids[a + b], a + b) if a + b in ids else None, list)  # noqa: B023
        for _ in range(20):
            x = "".join(rng.choice("aabbccd z") for _ in range(rng.randint(1, 14)))
            want = [ids.get(t[0], 0) for t in merging.merge(list("▁" + x.replace(" ", "▁")))]
            assert machine.encode(x).tolist() == want, (x, made)
        assert len(machine.paths) <= 4 and machine.pairs <= 5


def test_workers_drop_what_another_operator_kept():
    """Also what lies in reference cycles goes at once, not when the interpreter happens to look for them."""
    import gc
    import weakref

    from gaugeflow.llm.common import worker_store

    gc.disable()
    try:
        worker_store("one")["machine"] = machine = Transducer(load_model(PIECES))
        kept = weakref.ref(machine)
        del machine
        assert worker_store("one")["machine"] is kept()
        assert worker_store("two") == {} and kept() is None
    finally:
        gc.enable()


def test_join_drops_the_language_model(tmp_path):
    """The only worker of a session handles texts for the join after language ID; the model and its words are gone then."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
sys.path.insert(0, {repo!r})
import pyarrow as pa
from gaugeflow.session import build_session
from gaugeflow.llm.language import fit, predict
from gaugeflow.llm.ngram_join import similar_documents
def keys(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([str(getattr(sys.modules.get("gaugeflow_worker_store"), "key", None))])], names=["key"])
spark = build_session("local[1]", "drops", 1)
docs = spark.createDataFrame([(1, "the river"), (2, "der fluss")], "doc_id long, text string").coalesce(1)
seen = lambda: docs.mapInArrow(keys, "key string").first().key
predict(docs, fit([("en", ["the", "river"] * 20), ("de", ["der", "fluss"] * 20)])).collect()
before = seen()
similar_documents(docs).collect()
print("kept:", before, "then:", seen())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "kept: language then: ngram_join" in done.stdout, done.stderr[-2000:]


def test_texts_and_new_words_are_handled_in_slices(spark, monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from gaugeflow.llm.common import sliced

    batch = pa.RecordBatch.from_pydict({"x": list(range(1201))})
    parts = list(sliced([batch.slice(0, 0), batch], 500))
    assert [p.num_rows for p in parts] == [500, 500, 201] and pa.Table.from_batches(parts).column("x").to_pylist() == list(range(1201))

    texts = [None if i % 7 == 0 else f"It is {i}." for i in range(1201)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = encode(spark.createDataFrame(list(enumerate(texts)), DOC).coalesce(1), PIECES, check="ok").collect()
    assert [(r["doc_id"], r["ids"], r["ok"]) for r in got] == [(i, None if t is None else library.encode(t), None if t is None else True) for i, t in enumerate(texts)]

    model = fit([("en", ["the", "river", "flows"] * 20), ("de", ["der", "fluss", "strom"] * 20)])
    want = language.Labeller(model).languages(["the river flows", "der strom", "1"])
    sizes, emissions = [], model.emissions
    model.emissions = lambda words: sizes.append(len(words)) or emissions(words)
    monkeypatch.setattr(language, "FRESH_WORDS", 2)
    found = language.Labeller(model).languages(["the river flows", "der strom", "1"])
    assert sizes == [2, 2, 1] and [f[0] for f in found] == [w[0] for w in want]
    assert [f[1] for f in found] == pytest.approx([w[1] for w in want], abs=1e-5)
