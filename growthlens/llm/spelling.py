"""Spelling variants: near words of the vocabulary, found by Bloom-guided neighbourhoods.

1. Runs of letters are counted per word over all texts (each task adds up what
   it meets before the shuffle); words of at least ``MIN_LENGTH`` code points and
   ``MIN_COUNT`` occurrences are the vocabulary.
2. The vocabulary's hashes fill blocked Bloom filters, one shard per word
   length.  Spark ORs the marks of each block, and the filters are broadcast.  A
   broadcast is at most ``FILTER_BYTES``: a larger vocabulary is dealt into
   slices by hash, one filter and one pass for each, so the share of false
   positives stays the same at every size.
3. Each word generates its edits: every single deletion, and every single
   replacement by a larger letter.  That covers both directions, since an
   insertion is the other word's deletion.  An edit's hash follows from its
   word's by one sum, so an edit becomes a string only if the filter of its length holds it.
4. Only those positives are shuffled, to an equi-join with the vocabulary
   that removes the false ones.  Every pair arises exactly once.
5. Near words are counted, and the most frequent one chosen, by map-side
   combined aggregates.  Roots follow by pointer doubling: a form is at least
   twice as frequent as its word, so a chain is short.

Defined cases: a null text has no words; a null doc_id counts as the empty text in
the hash; rows that repeat are counted each; ties of forms go to the
smaller word in code-point order.  Words and texts of any length are taken whole (a
long word's edits are worked on in pieces).  An empty table has no words.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One occurrence in this many loses a letter; 0 leaves words as they are written.
NOISE = 97
#: Bytes of text worked on at once, and edits probed at once.
PIECE, EDITS = 4 << 20, 1 << 20
#: Bits of filter a word, bytes of a block (eight lanes of 32 bits) and bytes of one broadcast.
BITS, BLOCK_BYTES, FILTER_BYTES = 16, 32, 32 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: In UTF-8, U+00C0 to U+00FF are this byte and one more; no other letter has it.
_LEAD = 0xC3


def _noisy(word: bytes, crc: int) -> str:
    """``word`` without the code point that ``crc`` points at."""
    text = word.decode()
    at = crc % len(text)
    return text[:at] + text[at + 1:]


def _occurrences(noise: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, n) of each piece of text."""
    def counted(ids: list, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        data = tokens.LOWER[data]
        lead = data == _LEAD
        inside = _ASCII[data] | lead
        inside[1:] |= lead[:-1]
        start, end, doc = tokens.runs(inside, bounds)
        leads = np.concatenate([[0], np.cumsum(lead)])
        kept = end - start - (leads[end] - leads[start]) >= MIN_LENGTH
        start, end, doc = start[kept], end[kept], doc[kept]
        code, words = tokens.dictionary(data, start, end)
        words = [w.as_py() for w in words]
        counts: dict[str, int] = defaultdict(int)
        plain = np.zeros(len(words), np.int64)
        pair, n = np.unique(doc * max(len(words), 1) + code, return_counts=True)
        code = pair % max(len(words), 1)
        if noise:
            # one checksum for each document's words; it goes on from that of the id
            seed = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
            owner = pair // max(len(words), 1)
            crc = np.fromiter((zlib.crc32(words[w], seed[d]) for w, d in zip(code.tolist(), owner.tolist())), np.int64, len(pair))
            hit = crc % noise == 0
            for w, h, c in zip(code[hit].tolist(), crc[hit].tolist(), n[hit].tolist()):
                short = _noisy(words[w], h)
                if len(short) >= MIN_LENGTH:
                    counts[short] += c
            code, n = code[~hit], n[~hit]
        np.add.at(plain, code, n)
        for w in np.flatnonzero(plain).tolist():
            counts[words[w].decode()] += int(plain[w])
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, bounds = tokens.buffers(batch.column(1))
            at, rows = 0, len(bounds) - 1
            while at < rows:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1)
                yield counted(ids[at:to], data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at])
                at = to
    return run


def vocabulary(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words of ``docs(doc_id, text)`` that are long and frequent enough."""
    common.prepare(docs.sparkSession)
    met = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_occurrences(noise), "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points as rows of a matrix) of the words of each length, in pieces that bound a piece's edits."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        step = max(1, EDITS // (length * 64))
        for a in range(0, len(at), step):
            part = at[a: a + step]
            points = "".join(words.take(pa.array(part)).to_pylist()).encode("utf-32-le")
            yield part, np.frombuffer(points, "<u4").reshape(len(part), length)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash(points: np.ndarray) -> np.ndarray:
    return (points.astype(_U) * _powers(_BASE, points.shape[1])).sum(axis=1, dtype=_U)


def _slice(mixed: np.ndarray, slices: int) -> np.ndarray:
    return (mixed & _U(0xFFFF)) % _U(slices)


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> _U(32)) * _U(blocks)) >> _U(32)


def _bit(mixed: np.ndarray, lane: int) -> np.ndarray:
    """Bit of the lane: five bits of a second scrambling for each lane."""
    return (mixed >> _U(8 + 5 * lane)) & _U(31)


def _marks(first: dict[int, tuple[int, int]], part: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, lanes) of each word of the slice; blocks are numbered through all lengths."""
    def run(batches):
        for batch in batches:
            for _, points in _by_length(batch.column(0)):
                mixed = tokens.mix(_hash(points))
                mixed = mixed[_slice(mixed, slices) == part]
                at, blocks = first[points.shape[1]]
                again = tokens.mix(mixed)
                lanes = [pa.array((_U(1) << _bit(again, k)).astype(np.int64)) for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(_block(mixed, blocks).astype(np.int64) + at), *lanes], names=["block", *(f"lane{k}" for k in range(8))])
    return run


def _holds(lanes: np.ndarray, at: int, blocks: int, hashed: np.ndarray, part: int, slices: int) -> np.ndarray:
    """Places of the hashes that the filter of one length may hold."""
    mixed = tokens.mix(hashed)
    place = np.arange(len(mixed))
    if slices > 1:
        place = np.flatnonzero(_slice(mixed, slices) == part)
        mixed = mixed[place]
    block = _block(mixed, blocks).astype(np.int64) + at
    again = tokens.mix(mixed)
    for k in range(8):
        set_ = (lanes[block, k] >> _bit(again, k).astype(np.uint32)) & 1 == 1
        place, block, again = place[set_], block[set_], again[set_]
    return place


def _probe(shared, alphabet: np.ndarray, part: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(edit, word, n) of the edits that the filters may hold."""
    def run(batches):
        first, lanes = shared.value
        for batch in batches:
            words, counts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for where, points in _by_length(words):
                length = points.shape[1]
                edits, of = [], []
                wide, up, down = points.astype(_U), _powers(_BASE, length), _U(_INVERSE)
                total = _hash(points)
                before = np.cumsum(wide * up, axis=1, dtype=_U)
                if length - 1 in first:
                    # without place j: what follows moves one place down; of equal neighbours only the last goes
                    last = np.ones(points.shape, bool)
                    last[:, :-1] = points[:, 1:] != points[:, :-1]
                    row, j = np.nonzero(last)
                    head = np.where(j > 0, before[row, j - 1], _U(0))
                    hashed = head + (total[row] - before[row, j]) * down
                    for i in _holds(lanes, *first[length - 1], hashed, part, slices).tolist():
                        word = words[int(where[row[i]])].as_py()
                        edits.append(word[: j[i]] + word[j[i] + 1:])
                        of.append(where[row[i]])
                step = max(1, EDITS // max(len(alphabet) * len(points), 1))
                for a in range(0, length, step):
                    cell = points[:, a: a + step]
                    larger = alphabet[None, None, :] > cell[:, :, None]
                    row, j, letter = np.nonzero(larger)
                    change = alphabet[letter].astype(_U) - cell[row, j].astype(_U)
                    hashed = total[row] + change * up[a + j]
                    for i in _holds(lanes, *first[length], hashed, part, slices).tolist():
                        word, k = words[int(where[row[i]])].as_py(), a + int(j[i])
                        edits.append(word[:k] + chr(alphabet[letter[i]]) + word[k + 1:])
                        of.append(where[row[i]])
                of = np.array(of, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), words.take(pa.array(of)), pa.array(counts[of])], names=["edit", "word", "n"])
    return run


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.unique(np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), "<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64))], names=["letter"])


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): each pair of ``words(word, n)`` one edit apart, once.  ``words`` is settled and has no word twice."""
    spark = words.sparkSession
    common.prepare(spark)
    # of one number a length, and of the letters of the alphabet
    sizes = {r[0]: r[1] for r in words.groupBy(F.char_length("word")).count().collect()}
    alphabet = np.array(sorted(r[0] for r in words.select("word").mapInArrow(_letters, "letter long").distinct().collect()), np.uint32)
    schema = "edit string, word string, n long"
    positives = spark.createDataFrame([], schema)
    slices = max(1, -(-sum(sizes.values()) * BITS // (8 * filter_bytes)))
    first, blocks = {}, 0
    for length, count in sorted(sizes.items()):
        need = max(1, -(-count * BITS // (8 * BLOCK_BYTES * slices)))
        first[length] = blocks, need
        blocks += need
    for part in range(slices):
        marks = words.select("word").mapInArrow(_marks(first, part, slices), "block long, " + ", ".join(f"lane{k} long" for k in range(8)))
        held = marks.groupBy("block").agg(*[F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(8)]).toArrow()
        lanes = np.zeros((blocks, 8), np.uint32)
        at = held.column("block").to_numpy()
        for k in range(8):
            lanes[at, k] = held.column(f"lane{k}").to_numpy().astype(np.uint32)
        found = words.select("word", "n").mapInArrow(_probe(spark.sparkContext.broadcast((first, lanes)), alphabet, part, slices), schema)
        positives = positives.unionByName(found) if part else found
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return positives.join(exact, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links(word, form)``, whose chains end: pointers are doubled until none moves."""
    at = common.written(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return at


def variants(docs: DataFrame, noise: int = NOISE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary of ``docs(doc_id, text)``.

    ``form`` is the most frequent near word if it is at least ``RATIO`` times as frequent as the word, else null.
    """
    words = common.written(vocabulary(docs, noise))
    pairs = common.written(near_pairs(words, filter_bytes))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    close = -F.col("top.less") >= RATIO * F.col("n")
    told = common.written(words.join(near, "word", "left").select(
        "word", F.when(close, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, -F.col("top.less")).alias("form_n")))
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
