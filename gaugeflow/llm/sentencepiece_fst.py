"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The transducer is a composition of three: the normaliser maps blanks to the
meta symbol and puts one in front of a text; the piece lexicon, a trie, maps
character sequences to pieces; byte fallback maps any other character to the
pieces of its bytes. A text composed with it is a lattice over positions, and
its path of least cost in the tropical semiring (add along a path, minimum
over paths) is the encoding.

A unigram model puts its negated scores on the arcs. A BPE model admits an arc
behind another one exactly if the two pieces can stand side by side, that is,
if merging their joined text gives the two again; every text has one such path.
So there are no costs to compare: the search goes depth first, along the longest
piece that fits, and comes back from where none does. At most one path leads to
a place, so each is met once.

No piece holds the meta symbol behind another character, so a text falls into
chunks that are composed one by one; a worker keeps the paths of the chunks it
has seen. Decoding is the inverted transducer: pieces to bytes to text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.bpe import Neighbours
from gaugeflow.llm.common import no_cycles, sliced, worker_store

META = "▁"
#: Chunks whose ids and (unigram) beginnings whose compositions a worker keeps, in each of two generations, and characters of one at most.
KEPT_CHUNKS, KEPT_PATHS, KEPT_LENGTH = 250_000, 40_000, 64
#: First characters of a chunk whose arcs are kept, and pairs of pieces of which a worker keeps whether they can stand side by side.
BEGINNING, KEPT_PAIRS = 6, 200_000
#: Fixed value: what an unknown character costs beyond the least score in a unigram model.
UNKNOWN_PENALTY = 10.0
SPECIAL, NORMAL, BYTE = 0, 1, 2
#: Characters that aren't letters.
OTHERS = re.compile(r"[\W\d_]")


def load_model(path: str) -> dict:
    """Pieces, scores, kinds and settings of a model file; read on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("models with a character map are not supported")
    kinds = {1: NORMAL, 4: NORMAL, 6: BYTE}
    return {
        "bpe": proto.trainer_spec.model_type == 2,
        "prefix": proto.normalizer_spec.add_dummy_prefix,
        "squeeze": proto.normalizer_spec.remove_extra_whitespaces,
        "unknown": proto.trainer_spec.unk_id,
        "pieces": [(p.piece, p.score, kinds.get(p.type, SPECIAL)) for p in proto.pieces],
    }


class Transducer(dict):
    """The compiled model. As a dictionary it holds the paths of chunks, as the bytes of 32-bit ids."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.bpe = model, model["bpe"]
        self.id = {p: i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == NORMAL}
        self.score = [s for _, s, _ in model["pieces"]]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == BYTE}
        self.least = min(s for _, s, kind in model["pieces"] if kind == NORMAL)
        self.longest = max(map(len, self.id))
        self.neighbours = Neighbours(self.join, list)
        self.known: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.paths: dict[str, tuple] = {}
        self.older_paths: dict[str, tuple] = {}
        self.older: dict[str, bytes] = {}
        self.lost: set[str] = set()
        self.ever_lost = False
        self.adjacent = {pair for p in self.id for pair in zip(p, p[1:])}
        self.output = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(META, " ").encode() if kind == NORMAL else b"" for p, _, kind in model["pieces"]]
        self.output[model["unknown"]] = " ⁇ ".encode()
        # Chunks end before a meta symbol behind another character.
        whole = any(META in p.lstrip(META) for p in self.id)
        self.chunk = re.compile("(?s).+" if whole else f"{self.borders()}{META}*[^{META}]+|{META}+")
        # The lexicon as a trie: {character: node}, the arc of the piece that ends at a node under "".
        self.trie: dict = {}
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, array("i", [self.id[p]]).tobytes(), -self.score[self.id[p]])
        if not self.bpe:
            self.paths[""] = ([(self.trie, 0.0, b"")], None)

    def borders(self) -> str:
        """Patterns of the chunks that end between a letter and a sign, or a sign and a letter, that are neighbours in no piece."""
        signs = [c for c in map(chr, range(128)) if OTHERS.match(c)]
        letters: dict[str, str] = {}  # that stand before a sign in a piece
        for a, b in sorted(self.adjacent):
            if not OTHERS.match(a):
                letters[b] = letters.get(b, "") + a
        before = {a for a, b in self.adjacent if not OTHERS.match(b)}
        alike = {"": [META]}  # letters also end before a meta symbol
        for c in signs:
            alike.setdefault(letters.get(c, ""), []).append(c)
        any_of = lambda cs: f"[{re.escape(''.join(cs))}]"
        ends = "|".join((f"(?<!{any_of(a)})" if a else "") + f"(?={any_of(cs)})" for a, cs in sorted(alike.items()))
        starts = [c for c in signs if c not in before]
        return f"{META}*[^\\W\\d_]++(?:{ends})|" + (f"{META}*{any_of(starts)}++(?=[^\\W\\d_])|" if starts else "")

    def normalise(self, text: str) -> str:
        """Blanks become meta symbols, one is put in front; runs are squeezed and ends cut if the model says so."""
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.model["prefix"] else "") + text).replace(" ", META)

    def join(self, a: str, b: str):
        made = self.id.get(a + b)
        return None if made is None else (-self.score[made], a + b)

    def fits(self, before: str, piece: str) -> bool:
        if self.pairs >= KEPT_PAIRS:
            self.known.clear()
            self.pairs = 0
        found = self.neighbours.fit(before, piece) if before else self.neighbours.alone(piece)
        self.known.setdefault(before, {})[piece] = found
        self.pairs += 1
        return found

    def arcs(self, node: dict, text: str) -> tuple[list, dict | None]:
        """The arcs of the pieces on the way from a node of the trie along a text, shorter ones first, and the node at its end, None if no piece goes on."""
        found = []
        for c in text:
            if c not in node:
                return found, None
            node = node[c]
            if "" in node:
                found.append(node[""])
        return found, node

    def first_arcs(self, chunk: str) -> list:
        """The arcs at the front of a chunk. Texts that begin alike share those of what they share."""
        begun = chunk[:BEGINNING]
        kept = self.paths.get(begun)
        if kept is None:
            kept = self.older_paths.get(begun) or self.arcs(self.trie, begun)
            self.paths[begun] = kept
            if len(self.paths) >= KEPT_PATHS:  # what is still in use comes back from the older ones
                self.older_paths, self.paths = self.paths, {}
        found, node = kept
        return [*found, *self.arcs(node, chunk[BEGINNING : self.longest])[0]] if node else found[:]

    def only_path(self, chunk: str) -> bytes:
        """The ids on a BPE model's path."""
        n, longest, trie, known, single = len(chunk), self.longest, self.trie, self.known, self.id
        at, before, path = 0, "", []
        dead = set()  # places from which no path leads on
        while at < n:
            arcs = self.arcs(trie, chunk[at : at + longest])[0] if at else self.first_arcs(chunk)
            if chunk[at] not in single:
                arcs.insert(0, self.unknown(chunk[at]))
            fitting = known.get(before, {})
            while arcs:
                arc = arcs.pop()
                piece = arc[0]
                fits = fitting.get(piece)
                if (fits or fits is None and self.fits(before, piece)) and at + len(piece) not in dead:
                    path.append(arc)
                    at, before = at + len(piece), piece
                    break
            else:
                if not path:
                    raise ValueError(f"no path through {chunk[:KEPT_LENGTH]!r}")
                dead.add(at)
                at -= len(path.pop()[0])
                before = path[-1][0] if path else ""
        return b"".join([data for _, data, _ in path])

    def extend(self, arcs: tuple, c: str) -> tuple:
        """Reads a character. Arcs are (trie node, cost, ids) of the pieces under way; beside them is the best path that ends here."""
        best, ahead, trie = None, [], self.trie
        for node, cost, ids in arcs[0]:
            if c in node:
                child = node[c]
                if "" not in child:
                    ahead.append((child, cost, ids))
                    continue
                if len(child) > 1:  # else no longer piece begins like this one
                    ahead.append((child, cost, ids))
                end = child[""]
            elif node is trie and c not in self.id:
                end = self.unknown(c)
            else:
                continue
            _, data, weight = end
            if best is None or cost + weight < best[0]:
                best = (cost + weight, ids + data)
        if best is not None:
            ahead.append((trie, *best))
        return ahead, best

    def shortest_path(self, chunk: str) -> bytes:
        """The ids on a unigram model's path of least cost. Texts that begin alike share the composition of what they share."""
        n, paths, older = len(chunk), self.paths, self.older_paths
        known = min(n, KEPT_LENGTH)
        while (arcs := paths.get(begun := chunk[:known]) or older.get(begun)) is None:
            known -= 1
        paths[begun] = arcs
        for k in range(known, n):
            arcs = self.extend(arcs, chunk[k])
            if k < KEPT_LENGTH:
                paths[chunk[: k + 1]] = arcs
        if len(paths) >= KEPT_PATHS:  # what is still in use comes back from the older ones
            self.older_paths, self.paths = paths, {"": self.paths[""]}
        return arcs[1][1]

    def unknown(self, c: str) -> tuple[str, bytes, float]:
        """The arc of a character that is no piece: its bytes, or the unknown piece where a model has no bytes."""
        out = [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.model["unknown"]]
        return c, array("i", out).tobytes(), UNKNOWN_PENALTY - self.least

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is not None:
            self.keep(chunk, found)
            return found
        # No piece crosses two characters that are neighbours in none. Two letters are hardly ever such a place, so only others are looked at.
        cuts = []
        if not chunk[1:].isalpha():
            places = {i for m in OTHERS.finditer(chunk, 1) for i in (m.start(), m.end())}
            cuts = [i for i in sorted(places) if 0 < i < len(chunk) and (chunk[i - 1], chunk[i]) not in self.adjacent]
        if cuts:
            found = b"".join(map(self.__getitem__, [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]))
        else:
            found = self.only_path(chunk) if self.bpe else self.shortest_path(chunk)
        # What is put together from parts decodes to them if each part does.
        if (not cuts or self.ever_lost) and b"".join(map(self.output.__getitem__, array("i", found))) != chunk.replace(META, " ").encode("utf-8", "surrogatepass"):
            self.lost.add(chunk)
            self.ever_lost = True
        if len(chunk) <= KEPT_LENGTH:
            self.keep(chunk, found)
        return found

    def keep(self, chunk: str, found: bytes):
        """Full, the dictionary becomes the older one, from which what is still in use comes back."""
        if len(self.lost) >= KEPT_CHUNKS:  # nothing is remembered that isn't known to be lost
            self.older, self.lost = {}, set()
            self.clear()
        if len(self) >= KEPT_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.checked(text)[0]

    def checked(self, text: str) -> tuple[np.ndarray, bool]:
        """The ids of a text, and whether they decode to the normalised text: that is so if each chunk's ids do, which is seen once a chunk."""
        chunks = self.chunk.findall(self.normalise(text))
        found = np.frombuffer(b"".join(map(self.__getitem__, chunks)), dtype=np.int32)
        return found, not self.lost or self.lost.isdisjoint(chunks)

    def decode(self, ids) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


def _transducer(sent, name: str) -> Transducer:
    store = worker_store(("sentencepiece", name))
    return store.get("machine") or store.setdefault("machine", Transducer(sent.value))


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` without the text, with the ids of every whole text; ``check`` names a column that says whether they decode to the normalised text.

    ``model`` is a file on the driver; its pieces reach the workers as a
    broadcast of that file's size. NULL gives NULL ids (and check), an empty
    text no ids. Unknown characters become byte pieces, or the unknown piece
    where a model has none. Rows, repeated ones too, and the other columns
    stay; columns named like the results are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_model(model))
    results = [into, check] if check else [into]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent, model)
        for whole in batches:
            with no_cycles():  # once for many slices: each time it ends, all that is kept is walked
                yield from map(encoded, repeat(machine), sliced([whole]))

    def encoded(machine: Transducer, batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(None, None) if t is None else machine.checked(t) for t in (x.as_py() for x in batch.column(batch.num_columns - 1))]
        found, same = [p[0] for p in pairs], [p[1] for p in pairs]
        sizes = np.cumsum([0] + [0 if f is None else len(f) for f in found])
        flat = np.concatenate([f for f in found if f is not None]) if any(f is not None for f in found) else np.zeros(0, np.int32)
        missing = pa.array([f is None for f in found])
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()), mask=missing))
        if check:
            columns.append(pa.array(same, pa.bool_()))
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *results])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *results)]
    rows = docs.select(*kept, F.col(f"`{text}`").alias("__text"))
    kinds = [F.array(F.lit(0)).alias(into)] + ([F.lit(True).alias(check)] if check else [])
    schema = docs.select(*kept, *kinds).schema
    for name in results:
        schema[name].nullable = True
    return rows.mapInArrow(batches_of, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` without the ids, with the text they stand for; NULL gives NULL. Ids outside the model raise an error."""
    sent = rows.sparkSession.sparkContext.broadcast(load_model(model))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent, model)
        for batch in batches:
            texts = [None if x.as_py() is None else machine.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], into])

    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (ids, into)]
    schema = rows.select(*kept, F.lit("").alias(into)).schema
    schema[into].nullable = True
    return rows.select(*kept, F.col(f"`{ids}`").alias("__ids")).mapInArrow(batches_of, schema)


def encoding_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the normalised text, of every document."""
    rows = encode(docs.select("doc_id", "text"), model, check="round_trip")
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
