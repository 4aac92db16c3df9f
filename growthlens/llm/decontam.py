"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set that every document is held against, in
blocks of at most ``BLOCK_BYTES`` of item text; each block's seeds are sent to
the executors, so neither documents nor their n-grams are shuffled.

1. Every n-gram of an item is a possible seed; one pass over all documents
   counts in how many each occurs.
2. Rare ones seed the search: those in few documents, those hardly more
   frequent than the rarer ones of their item (a leak in a third of the corpus
   still has seeds), and in every window of ``WINDOW`` successive n-grams the
   rarest.  Only n-grams that are common outside the item are left out.
3. Around the seed hits of a document and an item, the words of the passage and
   of the item are aligned locally (match +2, mismatch and gap -1).  The score
   is the alignment's share of a perfect one; paraphrased or edited copies
   lose a few points only.

Defined cases: null and empty texts hold nothing; items without words are
skipped; items of fewer than n words are their own single seed; rows that
repeat a doc_id or item_id are reported once for each pair of ids, with the
best score; null ids are reported as null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
N = 4
WINDOW = 6
#: A seed is rare if at most this share of all documents hold it (or ``RARE_DOCS``, if that is more) ...
RARE, RARE_DOCS = 1e-3, 100
#: ... or at most this multiple of the documents that hold the rarer quarter of its item's n-grams.
LIKE_ITEM = 2
#: Share of a perfect alignment of the item from which a passage counts as copied.
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, score double, first long, end long, matched long"


class Items:
    """Word hashes of a block of items and their seeds, sorted by hash."""

    def __init__(self, ids: list, texts: list[str | None], n: int = N):
        data, bounds = tokens.buffers(pa.array(texts, pa.string()))
        words = tokens.Words(data, bounds, tokens.PUNCTUATION)
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        grams, at = tokens.ngrams(words, n)
        item, place = words.doc[at], at - words.first[words.doc[at]]
        self.whole = {}  # items of fewer than n words, by length
        for i, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.whole.setdefault(len(w), []).append(i)
        order = np.lexsort((place, item, grams))
        self.gram, self.item, self.place = grams[order], item[order], place[order]
        self.keys = np.unique(self.gram)

    def keep(self, frequency: np.ndarray, most: float) -> None:
        """Keep rare seeds: ``frequency`` is the document count of each key."""
        count = frequency[np.searchsorted(self.keys, self.gram)]
        keep = count <= most
        by_place = np.lexsort((self.place, self.item))
        ends = np.flatnonzero(np.append(self.item[by_place][1:] != self.item[by_place][:-1], True)) + 1 if len(by_place) else []
        start = 0
        for end in ends:
            run = by_place[start:end]
            keep[run] |= count[run] <= LIKE_ITEM * np.quantile(count[run], 0.25)
            for k in range(max(1, len(run) - WINDOW + 1)):
                window = run[k:k + WINDOW]
                keep[window[np.argmin(count[window])]] = True
            start = end
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.keys = np.unique(self.gram)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """(score, first, end, matched words) of the best local alignment of two word sequences.

    One row per item word; gaps along the row are a running maximum.
    """
    width = len(passage)
    slope = np.arange(width + 1) * -GAP
    # scores are compared together with their origin: score, then the earlier start of the passage
    score, origin, matched = np.zeros(width + 1, np.int64), np.arange(width + 1), np.zeros(width + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        hit = passage == word
        diagonal = score[:-1] + np.where(hit, MATCH, MISMATCH)
        above = score[1:] + GAP
        take = diagonal >= above
        cell = np.where(take, diagonal, above)
        start = np.where(take, origin[:-1], origin[1:])
        same = np.where(take, matched[:-1] + hit, matched[1:])
        fresh = cell <= 0
        cell = np.concatenate([[0], np.where(fresh, 0, cell)])
        start = np.concatenate([[0], np.where(fresh, np.arange(1, width + 1), start)])
        same = np.concatenate([[0], np.where(fresh, 0, same)])
        lifted = cell + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        score = np.maximum(top - slope, 0)
        alive = score > 0
        origin, matched = np.where(alive, start[source], np.arange(width + 1)), np.where(alive, same[source], 0)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(origin[k]), k, int(matched[k]))
    return best


def _hits(words: tokens.Words, items: Items, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the key, first word) of the seeds found."""
    grams, at = tokens.ngrams(words, n)
    if not len(items.keys) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.minimum(np.searchsorted(items.keys, grams), len(items.keys) - 1)
    found = items.keys[key] == grams
    return key[found], at[found]


def _frequency(shared, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many documents each key occurs: one row for each key of a task's documents."""
    def run(batches):
        items = shared.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for _, words in tokens.pieces(batch.column(0), space=tokens.PUNCTUATION):
                key, at = _hits(words, items, n)
                total += np.bincount(np.unique(words.doc[at] * len(items.keys) + key) % max(len(items.keys), 1), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["key", "n"])
    return run


def _search(shared, n: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        items = shared.value
        for batch in batches:
            out = []
            for row, words in tokens.pieces(batch.column(1), space=tokens.PUNCTUATION):
                key, at = _hits(words, items, n)
                # one entry for each hit and place of its seed
                lo, hi = np.searchsorted(items.gram, items.keys[key]), np.searchsorted(items.gram, items.keys[key], side="right")
                size = hi - lo
                seed = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else lo
                doc, item = words.doc[np.repeat(at, size)], items.item[seed]
                begin = np.repeat(at, size) - items.place[seed]  # where the item would start
                for length, short in items.whole.items():
                    if len(words.start) < length:
                        continue
                    for i in short:
                        same = np.ones(len(words.start) - length + 1, bool)
                        for k in range(length):
                            same &= words.hash[k:len(words.start) - length + 1 + k] == items.words[i][k]
                        same &= words.doc[:len(same)] == words.doc[length - 1:]
                        place = np.flatnonzero(same)
                        doc, item, begin = np.append(doc, words.doc[place]), np.append(item, np.full(len(place), i)), np.append(begin, place)
                order = np.lexsort((begin, item, doc))
                doc, item, begin = doc[order], item[order], begin[order]
                start = 0
                for end in [*(np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1).tolist(), len(doc)]:
                    if start == end:
                        continue
                    out += _best(words, items, int(doc[start]), int(item[start]), begin[start:end], row, least)
                    start = end
            column = lambda k, kind: pa.array([x[k] for x in out], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(column(0, pa.int64())), pa.array([items.ids[x[1]] for x in out], pa.int64()),
                column(2, pa.float64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int64()),
            ], names=["doc_id", "item_id", "score", "first", "end", "matched"])
    return run


def _best(words: tokens.Words, items: Items, doc: int, item: int, begin: np.ndarray, row: int, least: float) -> list[tuple]:
    """The best passage of one document for one item, if it reaches ``least``."""
    pattern = items.words[item]
    lo, hi, length = int(words.first[doc]), int(words.first[doc + 1]), len(pattern)
    slack = max(4, length // 2)
    best = (0, 0, 0, 0)
    cuts = np.flatnonzero(np.diff(begin) > slack) + 1
    for part in np.split(begin, cuts):
        a, b = max(lo, int(part[0]) - slack), min(hi, int(part[-1]) + length + slack)
        score, first, end, matched = align(pattern, words.hash[a:b])
        if score > best[0]:
            best = (score, a - lo + first, a - lo + end, matched)
    share = best[0] / (MATCH * length)
    return [(row + doc, item, share, *best[1:])] if share >= least else []


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first, end, matched): the best passage of each document that copies an item.

    ``first`` and ``end`` are word positions in the document, words being parted
    by white space and ASCII punctuation.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], SCHEMA) if not blocks else None
    n_docs = texts.count() if blocks else 0
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        own = Items([r.item_id for r in rows], [r.text for r in rows], n)
        shared = spark.sparkContext.broadcast(own)
        frequency = np.zeros(len(own.keys), np.int64)
        for r in (texts.select("text").mapInArrow(_frequency(shared, n), "key long, n long")
                  .groupBy("key").agg(F.sum("n").alias("n")).collect()):  # at most the block's seeds
            frequency[r["key"]] = r["n"]
        own.keep(frequency, max(RARE_DOCS, RARE * n_docs))
        part = texts.mapInArrow(_search(spark.sparkContext.broadcast(own), n, least), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "matched", "first", "end")).alias("best")).select(
        "doc_id", "item_id", "best.score", "best.first", "best.end", "best.matched")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` (all columns) that copy no item."""
    bad = common.settle(contaminated(docs, benchmark, least=least).where("doc_id is not null").select(F.col("doc_id").alias("_bad_id")).distinct())
    return docs.join(common.small(bad), docs["doc_id"] == F.col("_bad_id"), "left_anti")
