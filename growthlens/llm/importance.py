"""Importance resampling towards a target distribution.

1. Words are hashed into buckets; the occurrences of all source documents and
   of all target texts are counted per bucket (each task sends one row a
   bucket at most).  A bucket's gain is the smoothed log ratio of both
   distributions, in thousandths.  The gains are one array of ``buckets``
   numbers, whatever the size of the tables.
2. A document's weight is the sum of the gains its features point at in that
   array; a Gumbel number drawn from its id is added, so that the highest
   scores are a weighted sample without replacement.
3. Scores are written once.  The score of the last drawn row is found by
   bisecting its numeric range: each job counts the rows at or above ``CUTS``
   thresholds exactly (four halvings at once), until one value is left.  Rows
   that tie with it are cut by the same search over their ids, and rows that
   repeat an id by one over their place in the written table.
4. The drawn rows are range-partitioned in order; a row's rank is the number
   of rows in the partitions before its own plus its place there.

No row is gathered, and no sort runs over rows that are not drawn.

Defined cases: a null text has no words, weight 0 and is never drawn; a null
doc_id counts as the empty text in the hash and as the largest id in ties; rows
that repeat an id count each.  Empty tables draw nothing.  A text is read
whole, whatever its length.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

#: Thresholds that one job of the search counts at.
CUTS = 15
#: Bytes of text that are worked on at once.
PIECE = 4 << 20
#: Separators: all of ASCII but digits and letters.
_OTHER = np.zeros(256, bool)
_OTHER[:128] = True
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LARGEST = 2**63 - 1


def _features(column: pa.Array, n: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words of each row, row of each feature, bucket of each feature) of successive whole texts."""
    data, bounds = tokens.buffers(column)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1)
        part = tokens.LOWER[data[bounds[at]: bounds[to]]]
        start, end, doc = tokens.runs(~_OTHER[part], bounds[at: to + 1] - bounds[at])
        code, words = tokens.dictionary(part, start, end)
        words = [w.as_py() for w in words]
        one = np.array([zlib.crc32(w) for w in words], np.int64)
        owner, hashed = [doc], [one[code] % buckets if len(code) else np.zeros(0, np.int64)]
        gram = code
        crc = one
        for k in range(1, n):
            # runs of k + 1 words go on from the checksum of their first k
            whole = doc[k:] == doc[:-k] if len(doc) > k else np.zeros(0, bool)
            head, last = gram[: len(whole)][whole], code[k:][whole]
            pair, seen = np.unique(head * len(words) + last, return_inverse=True)
            crc = np.array([zlib.crc32(b" " + words[p % len(words)], int(crc[p // len(words)])) for p in pair.tolist()], np.int64)
            gram = np.full(len(code) - k if len(code) > k else 0, 0)
            gram[whole] = seen
            owner.append(doc[: len(whole)][whole])
            hashed.append(crc[seen] % buckets if len(seen) else np.zeros(0, np.int64))
        yield at, to - at, np.bincount(doc, minlength=to - at), np.concatenate(owner), np.concatenate(hashed)
        at = to


def _count(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, _, bucket in _features(batch.column(0), n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["bucket", "n"])
    return run


def feature_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in ``texts(text)``: one number a bucket reaches the driver."""
    rows = texts.select("text").mapInArrow(_count(n, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to source of each bucket, add-one smoothed, in thousandths."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _weigh(shared, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        gain = shared.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, size, count, row, bucket in _features(batch.column(1), n, len(gain)):
                words[at: at + size] = count
                features[at: at + size] = np.bincount(row, minlength=size)
                weight[at: at + size] = np.bincount(row, gain[bucket].astype(float), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(doc_id: str, seed: int) -> Column:
    """A Gumbel number in thousandths, drawn from the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, column: str, need: int) -> tuple[int, int]:
    """(largest value with at least ``need`` rows at or above it, rows above it), by exact counts; ``need`` >= 1."""
    low, high, above = *rows.agg(F.min(column), F.max(column)).first(), 0
    # at least ``need`` rows are at or above low, and ``above`` < need rows are above high
    while low < high:
        cuts = sorted({low + 1 + (high - low - 1) * i // CUTS for i in range(CUTS)} | {high})
        counts = rows.agg(*[F.count_if(F.col(column) >= c) for c in cuts]).first()
        for c, n in zip(cuts, counts):
            if n >= need:
                low = c
            else:
                high, above = c - 1, n
                break
    return low, above


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n: int = 1, buckets: int = 10_000,
             seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document of ``docs(doc_id, text)``; rank is null where it is not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a
    hundred (rounded down) are drawn so that their runs of 1 to ``n`` words follow ``target(text)``.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    gain = gains(feature_counts(docs, n, buckets), feature_counts(target, n, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    weighed = texts.mapInArrow(_weigh(spark.sparkContext.broadcast(gain), n), "doc_id long, n_words long, n_features long, weight long")
    scored = common.written(
        weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        # ascending ids and places are descending complements, so that one search serves all three
        .withColumn("by_id", F.bitwise_not(F.coalesce("doc_id", F.lit(_LARGEST))))
        .withColumn("by_place", F.bitwise_not(F.monotonically_increasing_id())))
    fit = F.col("n_words") >= min_words
    need = scored.where(fit).count() * percent // 100
    if need < 1:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    above_cut, at_cut, left = F.lit(False), fit, need
    for column in ("score", "by_id", "by_place"):
        value, above = cutoff(scored.where(at_cut), column, left)
        above_cut, at_cut, left = above_cut | (at_cut & (F.col(column) > value)), at_cut & (F.col(column) == value), left - above
    drawn = above_cut | at_cut
    ordered = common.written(
        scored.where(drawn).repartitionByRange(F.desc("score"), F.desc("by_id"), F.desc("by_place"))
        .sortWithinPartitions(F.desc("score"), F.desc("by_id"), F.desc("by_place"))
        .withColumn("place", F.monotonically_increasing_id())
        .select("doc_id", "n_features", "weight", "score", F.shiftright("place", 33).alias("part"),
                (F.col("place").bitwiseAND(2**33 - 1) + 1).alias("nth")))
    # one row a partition of the line above
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    ranked = ordered.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
