"""Token counts by a deterministic transducer compiled from a word BPE.

The transducer reads a normalised text character by character. Its states hold
where the splitting pattern stands (outside a word, in letters, in other
signs, in a contraction) and, inside a word, which tokens could still cover
the last characters. A transition carries the number of tokens it emits: the
change of the number of tokens of what was read so far. Transitions are
compiled when they are first taken.

That a finite state suffices rests on a property of BPE: tokens a and b can
stand side by side in an encoding exactly if the encoding of their joined text
is a, b. Every prefix of a word then has exactly one encoding, and its last
token is all that later tokens look at.

White space takes the transducer to its start from any state. The state map of
a chunk therefore is a head up to the first white space, which depends on the
state before, and a constant afterwards; the maps of a text's
chunks are applied in order inside one task.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm.bpe import Neighbours
from gaugeflow.llm.common import no_cycles, worker_store

#: States that are kept before the transducer is compiled anew, and characters of a chunk.
STATE_LIMIT, CHUNK = 350_000, 1 << 16
#: Characters of texts that are in one call, so that long texts don't add up.
LETTER, NUMBER, SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\p{White_Space}")
#: The contractions that the tokenizer's pattern names, by their letter after the apostrophe.
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_merges(path: str) -> dict:
    """What the transducer needs of a tokenizer file: the merges in order, the word end and the special strings."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": pairs, "end": model["end_of_word_suffix"], "special": [t["content"] for t in whole["added_tokens"]]}


class WordBpe:
    """Merges over symbols. Symbol b is byte b, symbol 256 + b is byte b at a word's end; tokens are numbered in the order of their merges."""

    def __init__(self, merges: list[tuple[str, str]], end: str):
        alphabet = byte_alphabet()
        number = {c: b for c, b in alphabet.items()} | {c + end: 256 + b for c, b in alphabet.items()}
        self.pairs, self.text, self.fits = {}, [(s,) for s in range(512)], {}
        self.neighbours = Neighbours(self.join, self.text.__getitem__)
        for a, b in merges:
            token = len(self.text)
            number[a + b] = token
            self.pairs[number[a], number[b]] = token
            self.text.append(self.text[number[a]] + self.text[number[b]])
        # A trie over symbols: node -> {symbol: node}; token_at[node] is the token that ends there.
        self.next, self.token_at = [{}], [None]
        for token, symbols in enumerate(self.text):
            node = 0
            for s in symbols:
                if s not in self.next[node]:
                    self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.token_at.append(None)
                node = self.next[node][s]
            self.token_at[node] = token

    def join(self, a: int, b: int):
        made = self.pairs.get((a, b))
        return None if made is None else (made, made)

    def side_by_side(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.neighbours.fit(a, b)
        return known

    def advance(self, items: tuple, symbol: int) -> tuple[tuple, int]:
        """Reads a symbol. Items are (trie node, token before, count) of the tokens that may be under way; counts are relative to the last boundary."""
        alive, last = [], None
        for node, before, count in items:
            child = self.next[node].get(symbol)
            if child is None:
                continue
            if self.next[child]:
                alive.append((child, before, count))
            token = self.token_at[child]
            if last is None and token is not None and (before is None or self.side_by_side(before, token)):
                last, delta = token, count + 1  # no other token can end here
        return (*((n, b, c - delta) for n, b, c in alive), (0, last, 0)), delta


WORD_START = ((0, None, 0),)


class State(dict):
    """Transitions by character: (next state, tokens emitted). A missing one is compiled."""

    __slots__ = ("machine", "mode", "items", "pending")

    def __init__(self, machine, mode, items=WORD_START, pending=""):
        self.machine, self.mode, self.items, self.pending = machine, mode, items, pending

    def __missing__(self, c):
        self[c] = step = self.machine.compile(self, c)
        return step


class CountTransducer:
    """States and transitions of one tokenizer, compiled as texts ask for them."""

    def __init__(self, merges: dict):
        self.bpe, self.special = WordBpe(merges["merges"], merges["end"]), merges["special"]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.clear()

    def clear(self):
        self.states: dict[tuple, State] = {}
        self.start = self.state("out")

    def state(self, mode, items=WORD_START, pending="") -> State:
        key = (mode, items, pending)
        if key not in self.states:
            self.states[key] = State(self, mode, items, pending)
        return self.states[key]

    def read(self, items, c: str, at_end: bool):
        """Tokens that the bytes of a character of a word add, and what is under way behind it."""
        total, data = 0, c.encode("utf-8", "surrogatepass")
        for i, b in enumerate(data):
            items, n = self.bpe.advance(items, b + 256 * (at_end and i == len(data) - 1))
            total += n
        return items, total

    def word(self, text: str) -> int:
        items, total = WORD_START, 0
        for i, c in enumerate(text):
            items, n = self.read(items, c, i == len(text) - 1)
            total += n
        return total

    def ended(self, s: State) -> int:
        """Tokens that are emitted if the text ends at a state."""
        if s.mode == "out":
            return 0
        if s.mode in ("letters", "other"):
            return self.read(s.items, s.pending, True)[1]
        return self.word("'") + (self.word(s.pending) if s.pending else 0)  # an apostrophe, and r, v or l

    def compile(self, s: State, c: str) -> tuple[State, int]:
        kind = "space" if SPACE.match(c) else "letters" if LETTER.match(c) else "number" if NUMBER.match(c) else "other"
        if s.mode == kind:
            items, n = self.read(s.items, s.pending, False)
            return self.state(kind, items, c), n
        if s.mode == "apostrophe":
            if not s.pending and c in SHORT:
                return self.start, self.word("'" + c)
            if s.pending and c == LONG[s.pending]:
                return self.start, self.word("'" + s.pending + c)
            if not s.pending and c in LONG:
                return self.state("apostrophe", pending=c), 0
            if not s.pending and kind == "other":
                return self.state("other", self.read(WORD_START, "'", False)[0], c), 1
            if s.pending and kind == "letters":
                items, n = self.read(WORD_START, s.pending, False)
                return self.state("letters", items, c), n + self.word("'")
        n = self.ended(s)
        if kind == "space":
            return self.start, n
        if kind == "number":
            return self.start, n + self.word(c)
        if c == "'":
            return self.state("apostrophe"), n
        return self.state(kind, WORD_START, c), n

    def run(self, s: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            s, n = s[c]
            total += n
        if len(self.states) > STATE_LIMIT:  # states are found again by what they stand for
            mode, items, pending = s.mode, s.items, s.pending
            self.clear()
            s = self.state(mode, items, pending)
        return s, total

    def chunk_map(self, chunk: str) -> tuple[str, State | None, int]:
        """The head up to and with the first white space; the state at the end and the tokens behind the head, None without white space."""
        found = SPACE.search(chunk)
        if not found:
            return chunk, None, 0
        return (chunk[: found.end()], *self.run(self.start, chunk[found.end() :]))

    def apply(self, s: State, chunk_map) -> tuple[State, int]:
        head, end, n = chunk_map
        s, before = self.run(s, head)
        return (s if end is None else end), before + n

    def count_plain(self, text: str) -> int:
        text = normalise(text)
        if len(text) <= CHUNK:
            s, total = self.run(self.start, text)
            return total + self.ended(s)
        s, total = self.start, 0
        for i in range(0, len(text), CHUNK):
            s, n = self.apply(s, self.chunk_map(text[i : i + CHUNK]))
            total += n
        return total + self.ended(s)

    def count(self, text: str) -> int:
        if not self.split:
            return self.count_plain(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


def normalise(text: str) -> str:
    """NFC, then each character lower-cased by itself; white space needs no change, as all of it resets the transducer."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a word BPE file on the driver; its merges
    reach the workers as a broadcast of that file's fixed size. NULL counts as
    empty: no bytes, no tokens. Texts of any length are read whole, in chunks.
    Repeated rows stay; input columns named like a result are replaced.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_merges(tokenizer))
    key = ("count", tokenizer)

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(key)
        machine = store.get("machine") or store.setdefault("machine", CountTransducer(sent.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            with no_cycles():
                n = pa.array([0 if t is None else machine.count(t) for t in (x.as_py() for x in texts)], pa.int64())
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, batch.column(batch.num_columns - 2), n], names=[*batch.schema.names[:-2], "n_bytes", "n_tokens"])

    names = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.octet_length(body).cast("long").alias("n_bytes"), F.col(f"`{text}`").alias("__text"))
    schema = rows.select(*[F.col(f"`{c}`") for c in names], "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(count_batches, schema).withColumn("over_limit", F.col("n_tokens") > limit)
