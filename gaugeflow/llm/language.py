"""Language of every word and document by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and its entry in a
lexicon learned from the labelled sample. Together with learned transitions
between the labels of neighbouring words they give, by forward-backward, the
probability of each language for every word of a text, also of texts that
switch between languages. A document's language is the one with the highest
mean probability over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.llm.common import sliced, worker_store

UNKNOWN = "und"
#: Bounds of the sample a model is fitted on: documents of each label, words of each document.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 150, 200
#: Words of a segment; segments of several documents in a row make a training sequence with switches.
SEGMENT, SEGMENTS = 25, 4
ROUNDS, RATE, DECAY = 25, 0.5, 1e-4
#: A lexicon entry needs this many occurrences and this share of one label.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
#: Characters of texts that are handled together, and words whose emissions a worker keeps.
BATCH_CHARS, KEPT_WORDS = 1_000_000, 250_000
#: New words whose emissions are made at once; each takes about a kilobyte meanwhile.
FRESH_WORDS = 25_000
#: Runs of letters; a few number signs also match and are told apart by isalpha.
RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


def features(word: str) -> list[str]:
    """Affixes and n-grams of two and three characters, with marks at both ends, affixes up to four, and the word itself for the lexicon."""
    marked = f"<{word}>"
    n = len(marked)
    out = [marked[i : i + 2] for i in range(n - 1)]
    out += [marked[i : i + 3] for i in range(n - 2)]
    out += [marked[:4], marked[:5], marked[-4:], marked[-5:], f"={word}"]
    return out


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Sums of the weights of each word's known features."""
        places, ends = [], []
        for word in words:
            places += [i for i in map(self.index.get, features(word)) if i is not None]
            ends.append(len(places))
        sums = np.vstack([np.zeros((1, len(self.labels))), np.cumsum(self.weights[np.array(places, dtype=np.int64)], axis=0, dtype=np.float64)])
        ends = np.array([0, *ends], dtype=np.int64)
        return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, counts: bool = False):
    """Label probabilities of every word of many sequences that lie one behind the other, and expected transitions if asked for.

    All sequences advance together, longest first, so each step is one array
    operation over those that still have words.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    step = np.exp(transitions)
    local = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf))
    alpha, expected, state = np.empty_like(local), np.zeros_like(step), None
    for t, n in enumerate(active):
        at = starts[:n] + t
        now = local[at] if t == 0 else (state[:n] @ step) * local[at]
        state = now / now.sum(axis=1, keepdims=True)
        alpha[at] = state
    beta, behind, n_behind = alpha.copy(), None, 0  # becomes the result
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        now = np.ones((n, len(step)), dtype=local.dtype)
        if n_behind:
            ahead = local[at[:n_behind] + 1] * behind
            now[:n_behind] = ahead @ step.T
            now[:n_behind] /= now[:n_behind].sum(axis=1, keepdims=True)
            if counts:
                pairs = alpha[at[:n_behind], :, None] * step[None] * ahead[:, None, :]
                expected += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = alpha[at] * now
        beta[at] = both / both.sum(axis=1, keepdims=True)
        behind, n_behind = now, n
    return (beta, expected) if counts else beta


def fit(texts: list[tuple[str, list[str]]]) -> Model:
    """Fits weights and transitions to words of labelled texts by gradient ascent on the conditional likelihood.

    Segments of different texts are put in a row, dealt out by their place
    alone, so that switches between languages are seen. The same sample always
    gives the same model.
    """
    labels = sorted({label for label, words in texts if words})
    number = {label: i for i, label in enumerate(labels)}
    segments = [(number[label], words[i : i + SEGMENT]) for label, words in texts for i in range(0, len(words), SEGMENT)]
    segments = [segments[i] for i in np.random.default_rng(0).permutation(len(segments))]
    words, tags = [w for _, s in segments for w in s], np.array([y for y, s in segments for _ in s], dtype=np.int64)
    sizes = np.array([sum(len(s) for _, s in segments[i : i + SEGMENTS]) for i in range(0, len(segments), SEGMENTS)], dtype=np.int64)
    count, share = Counter(words), Counter(zip(words, tags.tolist()))
    lexicon = {w for (w, _), n in share.items() if count[w] >= LEXICON_COUNT and n >= LEXICON_SHARE * count[w]}
    distinct = list(count)
    lists = [[f for f in features(w) if f[0] != "=" or f[1:] in lexicon] for w in distinct]
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(f, len(index)) for fs in lists for f in fs], dtype=np.int64)
    owner = np.repeat(np.arange(len(distinct)), [len(fs) for fs in lists])
    place = {w: i for i, w in enumerate(distinct)}
    ids = np.array([place[w] for w in words], dtype=np.int64)

    k, n_features = len(labels), len(index)
    weights, step = np.zeros((n_features, k)), np.zeros((k, k))
    seen_w, seen_s = np.full_like(weights, 1e-8), np.full_like(step, 1e-8)
    ends = np.cumsum(sizes)
    inner = np.ones(len(tags), dtype=bool)
    inner[ends - 1] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (tags[:-1][inner[:-1]], tags[1:][inner[:-1]]), 1)

    def per_group(groups, values, n):
        return np.stack([np.bincount(groups, values[:, y], n) for y in range(k)], axis=1)

    for _ in range(ROUNDS if k > 1 else 0):
        emissions = per_group(owner, weights[flat], len(distinct))
        marginals, expected = forward_backward(emissions[ids], sizes, step, counts=True)
        rest = -marginals
        rest[np.arange(len(tags)), tags] += 1
        grad_w = per_group(flat, per_group(ids, rest, len(distinct))[owner], n_features) - DECAY * len(tags) * weights
        grad_s = seen - expected - DECAY * len(tags) * step
        seen_w += grad_w**2
        seen_s += grad_s**2
        weights += RATE * grad_w / np.sqrt(seen_w)
        step += RATE * grad_s / np.sqrt(seen_s)
    return Model(labels, index, weights, step)


class Labeller:
    """A model with the emissions of the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.ids: dict[str, int] = {}
        self.fresh: list[str] = []
        self.rows = np.zeros((1024, len(self.model.labels)), dtype=np.float32)
        self.letters = np.zeros(1024, dtype=bool)

    def number(self, word: str) -> int:
        self.ids[word] = i = len(self.ids)
        self.fresh.append(word)
        return i

    def learn(self):
        """Emissions of the words that were numbered last."""
        if len(self.ids) > len(self.rows):
            more = max(len(self.rows), len(self.ids) - len(self.rows))
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), self.rows.dtype)])
            self.letters = np.concatenate([self.letters, np.zeros(more, bool)])
        new = slice(len(self.ids) - len(self.fresh), len(self.ids))
        for start in range(0, len(self.fresh), FRESH_WORDS):
            some = self.fresh[start : start + FRESH_WORDS]
            self.rows[new.start + start : new.start + start + len(some)] = self.model.emissions(some)
        self.letters[new] = [any(map(str.isalpha, w)) for w in self.fresh]
        self.fresh = []

    def marginals(self, texts: list[list[str]]):
        """For the words of all texts in a row: probabilities of the labels, and whether a word has letters."""
        if len(self.ids) > KEPT_WORDS:
            self.clear()
        known = self.ids
        ids = np.fromiter((known[w] if w in known else self.number(w) for words in texts for w in words), np.int64)
        self.learn()
        lengths = np.array([len(w) for w in texts if w], dtype=np.int64)
        return forward_backward(self.rows[ids], lengths, self.model.transitions.astype(np.float32)), self.letters[ids]

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        split = [words_of(t) for t in texts]
        probabilities, letters = self.marginals(split)
        sums = np.vstack([np.zeros((1, len(self.model.labels))), np.cumsum(probabilities * letters[:, None], axis=0, dtype=np.float64)])
        n = np.concatenate([[0], np.cumsum(letters)])
        ends = np.cumsum([len(w) for w in split])
        out = []
        for words, end in zip(split, ends):
            start = end - len(words)
            if n[end] == n[start]:
                out.append((UNKNOWN, 0.0))
                continue
            mean = (sums[end] - sums[start]) / (n[end] - n[start])
            best = int(mean.argmax())
            out.append((self.model.labels[best], float(min(1.0, max(0.0, mean[best])))))
        return out


def sample(docs: DataFrame, per_label: int = SAMPLE_DOCUMENTS, n_words: int = SAMPLE_WORDS, text: str = "text", label: str = "lang", order: str = "doc_id") -> list[tuple[str, list[str]]]:
    """At most ``per_label`` labelled documents of each label, in an order hashed from ``order``, with their first ``n_words`` words."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(order).isNotNull())
    order_of = [F.xxhash64(order), order]
    first = Window.partitionBy(label).orderBy(*order_of)
    chosen = known.select(label, order).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label).select(order).distinct()
    # One row for each label and place at most; rows that share a chosen id are ranked again, so that no more reach the driver.
    cut = F.array_join(F.slice(F.split(text, r"\s+", n_words + 2), 1, n_words), " ")
    rows = known.join(F.broadcast(chosen), order, "left_semi").select(label, order, cut.alias("text"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order_of, "text"))
    rows = rows.withColumn("n", place).where(F.col("n") <= per_label).select(label, order, "text").orderBy(*order_of, "text").collect()
    return [(r[0], words_of(r["text"])[:n_words]) for r in rows]


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Places of texts, longest first, in groups of bounded size: texts of one group take about as many steps."""
    group, chars = [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        group.append(i)
        chars += lengths[i] + 1
        if chars >= BATCH_CHARS:
            yield group
            group, chars = [], 0
    yield group


def predict(docs: DataFrame, model: Model, text: str = "text", label_into: str = "lang_pred", score_into: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with the predicted language of every whole text and its mean probability, and without the text unless it is kept.

    NULL texts and texts without letters give ``und`` with score 0. Rows,
    repeated ones too, and all other columns stay; columns that are named like
    the results are replaced. The model has a fixed size and travels as a
    broadcast.
    """
    spark = docs.sparkSession
    # Plain lists and arrays: a broadcast is read where this package may not be installed.
    sent, run = spark.sparkContext.broadcast((model.labels, model.index, model.weights, model.transitions)), uuid.uuid4().hex

    def label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("language")
        if store.get("run") != run:
            store |= {"run": run, "labeller": Labeller(Model(*sent.value))}
        labeller = store["labeller"]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found: list = [None] * batch.num_rows
            for group in _groups(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                for i, result in zip(group, labeller.languages([texts[i].as_py() or "" for i in group])):
                    found[i] = result
            columns = batch.columns[: batch.num_columns - (not keep_text)]
            names = batch.schema.names[: len(columns)]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield from sliced([pa.RecordBatch.from_arrays(columns, names=[*names, label_into, score_into])])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, label_into, score_into)]
    body = F.col(f"`{text}`")
    schema = docs.select(*others, *[body] * keep_text, F.lit("").alias(label_into), F.lit(0.0).alias(score_into)).schema
    found = docs.select(*others, body).mapInArrow(label_batches, schema)
    order = [c for c in docs.columns if c not in (label_into, score_into) and (keep_text or c != text)]
    return found.select(*[f"`{c}`" for c in order], label_into, score_into)


def held_out(doc_id: Column) -> Column:
    """Documents that no model is fitted on; one without id is none of them, and isn't fitted on either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the model is fitted on the documents that aren't held out."""
    model = fit(sample(docs.where(~held_out(F.col("doc_id")))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")
