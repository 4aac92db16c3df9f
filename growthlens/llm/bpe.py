"""Byte-level BPE with a minimal acyclic transducer for the frequent words.

Method: count the pre-tokens of all documents
in Spark; those that make up at least ``MIN_SHARE`` of them (so at most
``1 / MIN_SHARE`` exist, whatever the corpus) are merged once and compiled into a
minimal acyclic automaton.  Shared suffixes are stored once; each arc knows how
many words precede it, so a walk gives a word's number and with it the word's
ids.  Workers memory-map the automaton; words that it lacks are merged exactly,
so the counts decide speed only.  A worker keeps the ids of the runs between
white space that it met last, and splits only new ones into pre-tokens.

Defined cases: null text counts as empty (no ids, empty decoded text); a null
or repeated doc_id is passed through row by row; an empty table gives no rows.
Texts of any length are taken whole (a long pre-token is merged in n log n
steps).  Columns of the input beside the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word joins the automaton if it is at least this share of all pre-tokens.
MIN_SHARE = 1 / 50_000
#: Words kept decoded by a worker before it starts over; speed only.
CACHE_WORDS = 300_000
#: Words merged at once, and bytes of text whose new words are.
MERGE_ROWS, BATCH_BYTES = 1 << 14, 4 << 20
#: Characters of different pieces that a worker counts before it hands on the counts.
COUNT_CHARACTERS = 16 << 20


_BYTES = [bytes([b]) for b in range(256)]


def byte_characters() -> dict[str, int]:
    """The printable stand-in character of every byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return table


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a ``tokenizer.json``."""

    def __init__(self, text: str):
        spec = json.loads(text)
        back = byte_characters()
        self.ids = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[bytes(back[c] for c in a), bytes(back[c] for c in b)] = rank
        # the same by ids: pair of ids as one number -> rank, and rank -> id of the merged token
        self.single = [self.ids[_BYTES[b]] for b in range(256)]
        self.rank_of = {self.ids[a] << 32 | self.ids[b]: rank for (a, b), rank in self.ranks.items()}
        self.merged = [0] * len(self.ranks)
        for (a, b), rank in self.ranks.items():
            self.merged[rank] = self.ids[a + b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

        # pairs in order of their numbers, for look-ups of whole arrays
        self.pair = np.array(sorted(self.rank_of), np.int64)
        self.pair_rank = np.array([self.rank_of[p] for p in self.pair.tolist()], np.int32)
        self.merged_id = np.array([*self.merged, 0], np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of ranks where the pair does not merge or an id is below 0."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], len(self.merged)) if len(self.pair) else np.zeros(len(key), np.int32)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, as packed ids: each round merges the best pair of every word that has one."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= 64), key=lambda i: len(words[i]))
        for i in range(len(words)):
            if len(words[i]) > 64:
                out[i] = pack(self.merge(words[i]))
        single, none = np.array(self.single, np.int32), len(self.merged)
        for at in range(0, len(order), MERGE_ROWS):
            group = np.array(order[at: at + MERGE_ROWS])
            size = np.array([len(words[i]) for i in group])
            wide = int(size.max(initial=0))
            place = np.arange(wide)
            parts = np.full((len(group), wide + 1), -1, np.int32)
            parts[:, :wide][place < size[:, None]] = single[np.frombuffer(b"".join(words[i] for i in group), np.uint8)]
            ranks = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(group), wide).astype(np.int32)
            rows, done = np.arange(len(group)), parts.copy()
            while wide > 1 and len(rows):
                i = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), i]
                more = best < none
                done[rows[~more]] = parts[~more]
                rows, parts, ranks, i, best = rows[more], parts[more], ranks[more], i[more], best[more]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                parts[each, i] = self.merged_id[best]
                # what follows the merged pair moves one place to the left
                parts = np.take_along_axis(parts, np.minimum(np.arange(wide + 1) + (np.arange(wide + 1) > i[:, None]), wide), axis=1)
                ranks = np.take_along_axis(ranks, np.minimum(place + (place >= i[:, None]), wide - 1), axis=1)
                ranks[:, -1] = none
                ranks[each, i] = self._ranks(parts[each, i], parts[each, i + 1])
                left = np.flatnonzero(i > 0)
                ranks[left, i[left] - 1] = self._ranks(parts[left, i[left] - 1], parts[left, i[left]])
            flat = done[done >= 0].astype("<u4").tobytes()
            ends = (4 * (done >= 0).sum(axis=1).cumsum()).tolist()
            for i, a, b in zip(group.tolist(), [0, *ends], ends):
                out[i] = flat[a:b]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked adjacent pair is merged, leftmost first, until none is left."""
        if len(word) > 64:
            return self._merge_long([_BYTES[b] for b in word])
        single, rank, merged, none = self.single, self.rank_of.get, self.merged, len(self.merged)
        parts = [single[b] for b in word]
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, none)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for long pre-tokens: a heap of pairs over a linked list, n log n steps."""
        import heapq
        n, ranks = len(parts), self.ranks
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (parts[x], parts[after[x]])) in ranks:
                    heapq.heappush(heap, (ranks[p], x, *p))
        return [self.ids[parts[i]] for i in range(n) if alive[i]]


def compile_automaton(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of ``words`` as one block of little-endian int32.

    Layout: number of states, arcs, words and ids; first arc of each state;
    label, target and words-before of each arc; whether each state ends a word;
    first id of each word; ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def close(node: list) -> int:
        key = (node[0], tuple((label, child) for label, child in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[child] for _, child in key[1]))
        return register[key]

    ordered = sorted(words)
    path: list[list] = [[False, []]]
    last = b""
    for word in [*ordered, None]:
        shared = 0
        if word is not None:
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
        for _ in range(len(path) - 1 - shared):
            done = close(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], done)
        if word is None:
            break
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    root = close(path[0])
    first, label, target, skipped = [0], [], [], []
    for final, arcs in states:
        seen = int(final)
        for byte, child in arcs:
            label.append(byte)
            target.append(child)
            skipped.append(seen)
            seen += counts[child]
        first.append(len(label))
    ids = [words[w] for w in ordered]
    parts = [[len(states), len(label), len(ordered), sum(map(len, ids)), root], first, label, target, skipped,
             [int(final) for final, _ in states], [0, *np.cumsum([len(x) for x in ids]).tolist()], [i for x in ids for i in x]]
    return b"".join(np.asarray(p, "<i4").tobytes() for p in parts)


class Automaton:
    """A compiled automaton read through a memory map of a file without a name."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        states, arcs, words, ids, self.root = view[:5]
        cuts = np.cumsum([5, states + 1, arcs, arcs, arcs, states, words + 1, ids]).tolist()
        self.first, self.label, self.target, self.skipped, self.final, self.start, self.ids = (
            view[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        self.size = words

    def find(self, word: bytes) -> memoryview | None:
        """Ids of a stored word, else None."""
        first, label, state, number = self.first, self.label, self.root, 0
        for byte in word:
            hi = first[state + 1]
            arc = bisect_left(label, byte, first[state], hi)
            if arc == hi or label[arc] != byte:
                return None
            number += self.skipped[arc]
            state = self.target[arc]
        return self.ids[self.start[number]:self.start[number + 1]] if self.final[state] else None


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: White space as the pre-token pattern has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with the blank before it, or white space as the pre-token pattern cuts it.
#: Pre-tokens never cross such pieces, and depend on nothing outside their piece.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def chunk_edges(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of ``_CHUNK`` begin, and the end, in texts that lie one after the other in UTF-8."""
    size = len(data)
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = wide[1:-1], wide[2:]
    blank = ((data >= 9) & (data <= 13)) | (data == 0x20)
    lead2 = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    lead3 = (((data == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80))
             | ((data == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))))
    for at, width in ((np.flatnonzero(lead2), 2), (np.flatnonzero(lead3), 3)):
        for k in range(width):
            blank[at + k] = True
    start, end, doc = tokens.runs(~blank, bounds)
    inner = start > bounds[doc]
    s = start[inner]
    # the white-space character before a run belongs to it if it is a blank, and is a piece of its own if not
    back = np.ones(len(s), np.int64)
    for _ in range(2):
        back += (wide[s - back] & 0xC0) == 0x80
    own = s[wide[s - 1] != 0x20]
    cut = np.zeros(size + 1, bool)
    for at in (bounds, end, s - back, own, start[~inner], [size]):
        cut[at] = True
    return np.flatnonzero(cut).astype(np.int64)


def text_blocks(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, the same as array, where each text begins, and the end) of about ``BATCH_BYTES`` of texts at a time."""
    data, bounds = tokens.buffers(texts)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BATCH_BYTES, side="right")) - 1)
        part = data[bounds[at]: bounds[to]]
        yield part.tobytes(), part, bounds[at: to + 1] - bounds[at]
        at = to


def coded_chunks(part: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The pieces between ``cuts`` by their number among the different ones."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(part)]).dictionary_encode()


class Chunks(dict):
    """Piece of ``_CHUNK`` -> packed ids of its pre-tokens."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.encoder.__getitem__, self.encoder.pattern.findall(chunk)))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Encoder(dict):
    """Pre-token -> packed ids; looks up the automaton, else merges."""

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton | None = None):
        super().__init__()
        self.vocabulary, self.automaton = vocabulary, automaton
        self.pattern = regex.compile(PATTERN)
        self.chunks = Chunks(self)
        # bytes of all tokens one after the other, by id
        token = [vocabulary.token.get(i, b"") for i in range(max(vocabulary.token) + 1)]
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        self.size = np.array([len(x) for x in token], np.int64)
        self.start = np.cumsum(self.size) - self.size
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __missing__(self, piece: str) -> bytes:
        word = piece.encode()
        found = self.automaton.find(word) if self.automaton else None
        packed = pack(self.vocabulary.merge(word)) if found is None else found.tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[piece] = packed
        return packed

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; the new words of all of them are merged at once."""
        chunks = self.chunks
        if len(chunks) >= CACHE_WORDS:
            chunks.clear()
        if len(self) >= CACHE_WORDS:
            self.clear()
        names = [p.decode() for p in pieces]
        new = [p for p in names if p not in chunks]
        # a run of letters, with or without a blank before it, is one pre-token
        words = [[p] if p.removeprefix(" ").isalpha() else self.pattern.findall(p) for p in new]
        unseen = list(set(chain.from_iterable(words)) - self.keys())
        if self.automaton:
            stored = [self.automaton.find(w.encode()) for w in unseen]
            self.update((w, x.tobytes()) for w, x in zip(unseen, stored) if x is not None)
            unseen = [w for w, x in zip(unseen, stored) if x is None]
        self.update(zip(unseen, self.vocabulary.merge_all([w.encode() for w in unseen])))
        for p, found in zip(new, words):
            chunks[p] = self[found[0]] if len(found) == 1 else b"".join([self[w] for w in found])
        return [chunks[p] for p in names]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text; each different piece of many texts is looked up once."""
        for raw, part, edges in text_blocks(texts):
            if self.special and self.special.search(raw.decode()):
                yield from (self.encode(raw[a:b].decode()) for a, b in zip(edges[:-1], edges[1:]))
            else:
                cuts = chunk_edges(part, edges)
                coded = coded_chunks(part, cuts)
                packed = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
                code = coded.indices.to_numpy(zero_copy_only=False)
                flat = np.frombuffer(b"".join(packed), "<u4")
                size = np.array([len(p) // 4 for p in packed], np.int64)
                first = np.cumsum(size) - size
                size, first = size[code], first[code]
                ends = np.concatenate([[0], np.cumsum(size)])
                ids = flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])].tobytes()
                of = (4 * ends[np.searchsorted(cuts, edges)]).tolist()
                yield from (ids[a:b] for a, b in zip(of[:-1], of[1:]))

    def parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special and self.special.search(text) else [text]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.parts(text):
            if part in self.vocabulary.special:
                out.append(pack([self.vocabulary.special[part]]))
            else:
                out.append(b"".join(map(self.chunks.__getitem__, _CHUNK.findall(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return ""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace")


def _count_pieces(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder, chunks, held = Encoder(vocabulary.value), Counter(), 0

        def out():
            counts = Counter()
            for chunk, n in chunks.items():
                for piece in [chunk] if chunk.removeprefix(" ").isalpha() else encoder.pattern.findall(chunk):
                    counts[piece] += n
            # how many there are in all goes without a piece
            return pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([counts.total(), *counts.values()], pa.int64())], names=["piece", "n"])
        for batch in batches:
            for raw, part, edges in text_blocks(batch.column(0)):
                if encoder.special and encoder.special.search(raw.decode()):
                    found = Counter(chain.from_iterable(_CHUNK.findall(p) for a, b in zip(edges[:-1], edges[1:]) for p in encoder.parts(raw[a:b].decode())
                                                        if p not in vocabulary.value.special))
                else:
                    coded = coded_chunks(part, chunk_edges(part, edges))
                    n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                    found = dict(zip((c.decode() for c in coded.dictionary.to_pylist()), n.tolist()))
                chunks.update(found)
                held += sum(map(len, found))
                if len(chunks) > CACHE_WORDS or held > COUNT_CHARACTERS:
                    yield out()
                    chunks.clear()
                    held = 0
        yield out()
    return run


def _merge_pieces(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            ids = [vocabulary.value.merge(p.encode()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])
    return run


def _encode(vocabulary, block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = Encoder(vocabulary.value, Automaton(block.value))
        for batch in batches:
            ids = list(encoder.encode_all(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return run


def _digest(vocabulary, block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = Encoder(vocabulary.value, Automaton(block.value))
        for batch in batches:
            n, coded, decoded = [], [], []
            for packed in encoder.encode_all(batch.column(1)):
                n.append(len(packed) // 4)
                coded.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def lexicon(docs: DataFrame, text_col: str, vocabulary) -> bytes:
    """The compiled automaton of the frequent pre-tokens (at most 1 / MIN_SHARE) of all texts."""
    # what occurs once is not frequent; the row without a piece holds the number of all
    counts = common.written(
        docs.select(text_col).mapInArrow(_count_pieces(vocabulary), "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).where("piece is null or n > 1"))
    total = counts.where("piece is null").agg(F.max("n")).first()[0] or 0
    frequent = counts.where(F.col("piece").isNotNull() & (F.col("n") >= max(2, total * MIN_SHARE))).select("piece")
    rows = frequent.mapInArrow(_merge_pieces(vocabulary), "piece string, ids array<int>").collect()
    return compile_automaton({r.piece.encode(): list(r.ids) for r in rows})


def _prepared(docs: DataFrame, text_col: str, vocabulary_path: str):
    spark = docs.sparkSession
    common.prepare(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(file.read()))
    return vocabulary, spark.sparkContext.broadcast(lexicon(docs, text_col, vocabulary))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, packed as little-endian unsigned 32-bit integers."""
    vocabulary, block = _prepared(docs, text_col, vocabulary_path)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _encode(vocabulary, block), "doc_id long, ids binary")


def decode(coded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) of ``encode``'s rows."""
    spark = coded.sparkSession
    common.prepare(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(file.read()))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encoder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each whole text in one pass."""
    vocabulary, block = _prepared(docs, text_col, vocabulary_path)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _digest(vocabulary, block), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
