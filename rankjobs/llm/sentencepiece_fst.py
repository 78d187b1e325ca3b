"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled once per worker into

- a normaliser: spaces become the mark U+2581, and one mark is put before a text;
- a piece transducer: a trie from characters to piece ids, as two arrays;
- byte fallback: a character that no piece has is an arc of its own, which writes the
  ids of its UTF-8 bytes.

Composed with an input this gives a lattice: positions are states, pieces are arcs. Its
weights are in the tropical semiring (minimum, plus). For unigram models an arc weighs
its piece's negative score. For BPE models an arc weighs nothing if the piece can follow
the piece before it, that is if merging the two pieces' characters by the model's order
gives just these two, and infinity otherwise: a sequence of pieces is the BPE encoding
exactly if all its neighbours are such pairs, so one path of finite weight is left. The
shortest path is the encoding. Each state keeps its distance and its last arc.

No piece has a mark after another character (this is checked), so paths never cross the
start of a word. The composition runs over the distinct words of a slice, all words of
one length at once, in numpy, and what it found for up to ``KNOWN_WORDS`` words is kept; words beyond ``LONG_WORD`` characters go one by one, in
memory linear in their length. A slice's result leaves the task before the next slice is read, so a worker holds one Arrow
batch of texts and one slice of results.

Decoding is the inverse transducer: ids to bytes to text; marks become spaces, the first
one goes. Where the text has no U+2581 of its own, decoding returns it exactly.

Defined results: null and empty texts have no ids; null id lists decode to null; control
ids decode to nothing, the unknown id and broken UTF-8 to U+FFFD; other columns pass through.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_CHARS = 2 << 20
SLICE_IDS = 1 << 19
ROWS_AT_ONCE = 1 << 13
PAIR_SLOTS = 1 << 20
KNOWN_PAIRS = 1 << 19
KNOWN_WORDS = 400_000
TRIE_SLOTS = 1 << 19
HASH_FACTOR = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
LONG_WORD = 64
UNREACHED = np.float32(np.inf)

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of the fields of one protocol buffer message; nested messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    """What a model file says."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    algorithm: int
    dummy_prefix: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, types, algorithm = [], [], [], UNIGRAM
        normaliser = {3: 1, 4: 1, 5: 1}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normaliser |= dict(_fields(value))
        if normaliser.get(2) or normaliser[4] or not normaliser[5]:
            raise ValueError("only models that keep white space, escape it and map no characters are supported")
        if algorithm not in (UNIGRAM, BPE) or USER_DEFINED in types:
            raise ValueError("only unigram and BPE models without user defined pieces are supported")
        return cls(pieces, scores, types, algorithm, bool(normaliser[3]))


class Transducer:
    """A compiled model."""

    def __init__(self, model: Model):
        self.model = model
        usable = [i for i, t in enumerate(model.types) if t == NORMAL]
        if any(MARK in model.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece goes beyond the start of a word")
        self.ids = {model.pieces[i]: i for i in usable}
        self.unknown = len(model.pieces)  # the arc of a character without a piece
        self.start = self.unknown + 1  # the arc before the first
        self.longest = max((len(p) for p in self.ids), default=1)
        floor = min((model.scores[i] for i in usable), default=0.0)
        weights = np.zeros(self.start + 1, np.float32)
        if model.algorithm == UNIGRAM:
            weights[: len(model.scores)] = -np.array(model.scores, np.float32)
            weights[self.unknown] = 10.0 - floor
        self.weights = weights
        self.bytes = {int(model.pieces[i][3:5], 16): i for i, t in enumerate(model.types) if t == BYTE}
        self.unknown_id = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self._compile_trie()
        # whether a piece can follow another: a table with one slot per hash, and what has been worked out
        self.base = self.start + 1
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int32 if self.base**2 < 1 << 31 else np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, int] | None = None
        self._forget()

    def _compile_trie(self) -> None:
        """Sorted keys (state, character) with the next state, and the piece that ends in each state."""
        states: dict[tuple[int, int], int] = {}
        ends = {}
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                state = states.setdefault((state, ord(c)), len(states) + 1)
            ends[state] = i
        keys = np.array([(s << 21) | c for s, c in states], np.int64)
        order = np.argsort(keys)
        keys, following = keys[order], np.array(list(states.values()), np.int32)[order]
        # one slot per hash; keys that find theirs taken are searched for in a short sorted list
        slots, first = np.unique(self._trie_slots(keys), return_index=True)
        self.slot_keys, self.slot_next = np.full(TRIE_SLOTS, -1, np.int64), np.zeros(TRIE_SLOTS, np.int32)
        self.slot_keys[slots], self.slot_next[slots] = keys[first], following[first]
        self.more_keys, self.more_next = np.delete(keys, first), np.delete(following, first)
        self.piece_at = np.full(len(states) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())

    @staticmethod
    def _trie_slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * HASH_FACTOR) >> 40) & (TRIE_SLOTS - 1)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The state after each (state, character) key; -1 where there is none."""
        slots = self._trie_slots(keys)
        there = self.slot_keys[slots]
        out = np.where(there == keys, self.slot_next[slots], np.int32(-1))
        other = np.flatnonzero((there != keys) & (there >= 0))
        if len(other) and len(self.more_keys):
            at = np.minimum(np.searchsorted(self.more_keys, keys[other]), len(self.more_keys) - 1)
            out[other] = np.where(self.more_keys[at] == keys[other], self.more_next[at], np.int32(-1))
        return out

    def merge(self, text: str) -> list[str]:
        """BPE by the order of scores, the leftmost first on a tie: the definition that pair weights rest on."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.model.scores[i] > best[0]):
                    best = (self.model.scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, before: int, piece: int) -> bool:
        if self.model.algorithm == UNIGRAM or piece == self.unknown:
            return True
        p = self.model.pieces[piece]
        if before in (self.start, self.unknown):
            return self.merge(p) == [p]
        return self.merge(self.model.pieces[before] + p) == [self.model.pieces[before], p]

    def pair_fits_key(self, key: int) -> bool:
        if key not in self.pairs:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._fits(*divmod(key, self.base))
        return self.pairs[key]

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the one before it."""
        keys = before.astype(np.int64) * self.base + piece
        slots = ((keys * HASH_FACTOR) >> 40) & (PAIR_SLOTS - 1)
        out = self.pair_fits[slots]
        missing = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            found = np.array([self.pair_fits_key(k) for k in new.tolist()])
            out[missing] = found[back]
            at = slots[missing[first]]
            # of pairs that share a slot one is written, key and value alike
            _, one = np.unique(at, return_index=True)
            self.pair_keys[at[one]], self.pair_fits[at[one]] = new[one], found[one]
        return out

    def compose(self, points: np.ndarray) -> np.ndarray:
        """(words, characters) -> (start, words, characters) piece ids of the arcs by length - 1 and start; -1 for none."""
        n, length = points.shape
        arcs = np.full((min(self.longest, length), n, length), -1, np.int32)
        for start in range(length):
            state = np.zeros(n, np.int64)
            live = np.arange(n)
            for size in range(min(self.longest, length - start)):
                after = self.follow((state << 21) | points[live, start + size])
                known = after >= 0
                live, state = live[known], after[known].astype(np.int64)
                if not len(live):
                    break
                arcs[size, live, start] = self.piece_at[state]
        arcs[0][arcs[0] < 0] = self.unknown
        return arcs

    def shortest_paths(self, points: np.ndarray) -> np.ndarray:
        """(words, characters): the arcs of each word's shortest path, after as many -1 as there are arcs too few."""
        n, length = points.shape
        arcs = self.compose(points)
        distance = np.full((length + 1, n), UNREACHED, np.float32)
        last = np.full((length + 1, n), self.start, np.int32)
        size_of = np.zeros((length + 1, n), np.int32)
        distance[0] = 0
        single = self.model.algorithm == BPE  # one path of finite weight: a state that is reached is done
        for end in range(1, length + 1):
            for size in range(min(len(arcs), end) - 1, -1, -1):
                start = end - size - 1
                possible = (arcs[size, :, start] >= 0) & (distance[start] < UNREACHED)
                if single:
                    possible &= distance[end] == UNREACHED
                rows = np.flatnonzero(possible)
                if not len(rows):
                    continue
                piece = arcs[size, rows, start]
                fit = self.fits(last[start, rows], piece)
                rows, piece = rows[fit], piece[fit]
                through = distance[start, rows] + self.weights[piece]
                shorter = through < distance[end, rows]
                rows, piece = rows[shorter], piece[shorter]
                distance[end, rows], last[end, rows], size_of[end, rows] = through[shorter], piece, size + 1
        # back along the last arcs, all words at once
        path = np.full((n, length), -1, np.int32)
        at, rows = np.full(n, length), np.arange(n)
        for place in range(length - 1, -1, -1):
            path[rows, place] = last[at[rows], rows]
            at[rows] -= size_of[at[rows], rows]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        return path

    def _ids(self, word: str, arcs: np.ndarray) -> np.ndarray:
        """Output side: piece ids, and bytes for characters without a piece."""
        out, at = [], 0
        for a in arcs.tolist():
            if a == self.unknown:
                raw = word[at].encode("utf-8")
                out += [self.bytes[b] for b in raw] if self.bytes else [self.unknown_id]
                at += 1
            else:
                out.append(a)
                at += len(self.model.pieces[a])
        return np.array(out, np.int32)

    def _long(self, word: str) -> np.ndarray:
        """The same shortest path for one long word, position by position, so that memory is linear in its length."""
        if self.steps is None:
            used = np.flatnonzero(self.slot_keys >= 0)
            self.steps = dict(zip(self.slot_keys[used].tolist(), self.slot_next[used].tolist()))
            self.steps |= dict(zip(self.more_keys.tolist(), self.more_next.tolist()))
        steps = self.steps
        n = len(word)
        distance, last, sizes = [0.0] + [float("inf")] * n, [self.start] * (n + 1), [0] * (n + 1)
        for start in range(n):
            if distance[start] == float("inf"):
                continue
            state, arcs = 0, []
            for size in range(1, min(self.longest, n - start) + 1):
                state = steps.get((state << 21) | ord(word[start + size - 1]), -1)
                if state < 0:
                    break
                if self.piece_at[state] >= 0:
                    arcs.append((size, int(self.piece_at[state])))
            if not arcs or arcs[0][0] > 1:
                arcs.append((1, self.unknown))
            for size, piece in arcs:
                through = distance[start] + float(self.weights[piece])
                if through < distance[start + size] and self.pair_fits_key(last[start] * self.base + piece):
                    distance[start + size], last[start + size], sizes[start + size] = through, piece, size
        path, at = [], n
        while at > 0:
            path.append(last[at])
            at -= sizes[at]
        return np.array(path[::-1], np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after another in some order, where those of each word begin, and how many they are.

        Words are parts of a normalised text. Only words that are not known yet are composed
        with the transducer; they are then known, until there are ``KNOWN_WORDS``.
        """
        if len(self.known) >= KNOWN_WORDS:
            self._forget()
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            names = [words[k] for k in new.tolist()]
            flat, begins, sizes = self._encode_new(names)
            at[new] = len(self.known_sizes) + np.arange(len(new))
            self.known.update(zip(names, at[new].tolist()))
            self.known_begins = np.concatenate([self.known_begins, len(self.known_flat) + begins])
            self.known_flat = np.concatenate([self.known_flat, flat])
            self.known_sizes = np.concatenate([self.known_sizes, sizes])
        out = self.known_flat, self.known_begins[at], self.known_sizes[at]
        if len(self.known_flat) > 16 * KNOWN_WORDS:  # a few very long words
            self._forget()
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_flat, self.known_begins, self.known_sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``encode_words`` returns, for distinct words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        flat, sizes, total = [], np.zeros(len(words), np.int64), 0
        begins = np.zeros(len(words), np.int64)

        def add(which: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal total
            sizes[which], begins[which] = n, total + np.cumsum(n) - n
            flat.append(ids)
            total += len(ids)

        single: list[tuple[int, np.ndarray]] = []  # words that are long or have characters without a piece
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, edges) if len(words) else ():
            length = int(lengths[group[0]])
            if length > LONG_WORD:
                single += [(k, self._ids(words[k], self._long(words[k]))) for k in group.tolist()]
                continue
            for some in np.split(group, range(ROWS_AT_ONCE, len(group), ROWS_AT_ONCE)):
                text = "".join([words[k] for k in some.tolist()])
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                paths = self.shortest_paths(points.astype(np.int64).reshape(len(some), length))
                odd = (paths == self.unknown).any(axis=1)
                single += [(k, self._ids(words[k], p[p >= 0])) for k, p in zip(some[odd].tolist(), paths[odd])]
                paths = paths[~odd]
                add(some[~odd], paths[paths >= 0], (paths >= 0).sum(axis=1))
        if single:
            which, ids = zip(*single)
            add(np.array(which), np.concatenate(ids), np.array([len(x) for x in ids]))
        return np.concatenate(flat) if flat else np.empty(0, np.int32), begins, sizes

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text."""
        lead = MARK if self.model.dummy_prefix else ""
        parts = [WORDS.findall(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        coded = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
        flat, begins, sizes = self.encode_words(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(total[-1]) + np.repeat(begins[codes] - total[:-1], n)]
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(ids.astype(np.int32)))

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_output_bytes"):
            kinds = {
                NORMAL: lambda p: p.encode("utf-8"), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: "�".encode(),
                UNUSED: lambda p: p.encode("utf-8"), CONTROL: lambda p: b"",
            }
            raw = [kinds[t](p) for p, t in zip(self.model.pieces, self.model.types)]
            self._output_ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            self._output_bytes = np.frombuffer(b"".join(raw), np.uint8)
        return self._output_bytes, self._output_ends

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids."""
        raw, ends = self._outputs()
        ids = lists.flatten().to_numpy()
        if len(ids) and not ((ids >= 0) & (ids < len(ends) - 1)).all():
            raise ValueError("an id is not in the model")
        n = np.diff(ends)[ids] if len(ids) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        data = raw[np.arange(total[-1]) + np.repeat(ends[ids] - total[:-1], n)].tobytes() if len(ids) else b""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = total[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        mark, out = MARK.encode(), []
        for a, b, valid in zip(cuts, cuts[1:], lists.is_valid().to_pylist()):
            text = data[a:b].replace(mark, b" ")
            if self.model.dummy_prefix and text.startswith(b" "):
                text = text[1:]
            out.append(text.decode("utf-8", "replace") if valid else None)
        return out


# a word takes the marks before it; line ends and the like stand alone, no piece has them
WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

_compiled: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """One transducer per worker and model."""
    if data not in _compiled:
        transducer = Transducer(Model.parse(data))
        if any("\n" in p for p in transducer.ids):
            raise ValueError("a piece has a line end")
        _compiled[data] = transducer
    return _compiled[data]


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _slices(texts: pa.Array) -> list[pa.Array]:
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_CHARS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    return [texts.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _id_slices(lists: pa.ListArray) -> list[pa.ListArray]:
    part = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) // SLICE_IDS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    return [lists.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def encode(docs: DataFrame, model: bytes, text_column: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array of ints."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in _slices(texts):
                yield compiled(model).encode(some.to_pylist())

    return docs.withColumn(output, ids(F.col(f"`{text_column}`")))


def decode(docs: DataFrame, model: bytes, ids_column: str = "ids", output: str = "text") -> DataFrame:
    """``docs`` with the text of each array of ids."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for some in _id_slices(lists):
                yield pa.array(compiled(model).decode(some), pa.string())

    return docs.withColumn(output, text(F.col(f"`{ids_column}`")))


CODED = "struct<ids:array<int>,text:string>"


def encode_and_decode(docs: DataFrame, model: bytes, text_column: str = "text", ids_output: str = "ids", text_output: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and what they decode to, in one pass (two chained functions would encode twice)."""

    @F.arrow_udf(CODED)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in _slices(texts):
                ids = compiled(model).encode(some.to_pylist())
                for part in _id_slices(ids):
                    back = pa.array(compiled(model).decode(part), pa.string())
                    yield pa.StructArray.from_arrays([part, back], names=["ids", "text"])

    result = coded(F.col(f"`{text_column}`"))
    return docs.withColumns({ids_output: result["ids"], text_output: result["text"]})
