"""Near-duplicate documents by SuperMinHash.

Each document is a set of distinct n-word shingles.  Signatures come from
correlated permutation ranks per element with early stopping (SuperMinHash);
their bands propose pairs; every link is confirmed on the full shingle sets;
groups are the connected components of the links.

No group is gathered into one task and no group's pairs are all emitted:

* equal sets collapse to one class first (map-side combined minimum);
* in a bucket each member is paired with two leaders only;
* what the confirmed leader links leave in several components of one bucket is
  compared in blocks of at most ``BLOCK`` members, which emit one link for each
  pair of components that meet, not one for each pair of documents.

Defined cases: null text counts as empty; a text without words has no
shingles and links with nothing; a row with null id keeps its shingle count,
has a null component and is not kept; rows that repeat an id are one document
for linking.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
SLOTS, BANDS = 64, 16
BLOCK = 512

SIGNATURE_SCHEMA = "id long, n_shingles long, key1 long, key2 long, bands array<long>"


def shingle_sets(words: tokens.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within each document, and each document's offsets.

    A document with fewer than ``width`` words has its whole sequence as one shingle.
    """
    grams, at = tokens.ngrams(words, width)
    doc = words.doc[at]
    extra_doc, extra = [], []
    for d in np.flatnonzero((words.count > 0) & (words.count < width)):
        lo, n = words.first[d], words.count[d]
        extra_doc.append(d)
        extra.append(tokens.combine([words.hash[lo + k: lo + k + 1] for k in range(n)])[0])
    if extra:
        grams = np.concatenate([grams, np.array(extra, _U)])
        doc = np.concatenate([doc, np.array(extra_doc, doc.dtype)])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(words.docs + 1))


def superminhash(grams: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures [documents, slots]; slot values are (rank << 48 | 48 random bits).

    All elements of all documents take step j of their own permutation together;
    a document's elements leave once every slot holds a rank below j.
    """
    docs = len(bounds) - 1
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    signature = np.full(docs * slots, np.iinfo(_U).max, _U)
    element, permuted = grams, np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(grams), slots)).copy()
    row = np.arange(len(grams))
    for j in range(slots):
        if not len(element):
            break
        random = tokens.mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((random >> _U(48)) * _U(slots - j) >> _U(16)).astype(np.int64)
        swap = permuted[row, k]
        permuted[row, k] = permuted[row, j]
        value = (_U(j) << _U(48)) | (tokens.mix(random) >> _U(16))
        np.minimum.at(signature, doc * slots + swap, value)
        if j + 1 < slots:
            worst = signature.reshape(docs, slots).max(axis=1) >> _U(48)
            stay = worst[doc] > j
            if not stay.all():
                element, doc, permuted = element[stay], doc[stay], permuted[stay]
                row = np.arange(len(element))
    return signature.reshape(docs, slots)


def _signatures(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, words in tokens.pieces(batch.column(1)):
                grams, bounds = shingle_sets(words, width)
                n = np.diff(bounds)
                sums = np.zeros((2, len(grams) + 1), _U)
                np.cumsum(tokens.mix(grams + _U(1)), out=sums[0, 1:])
                np.cumsum(tokens.mix(grams + _U(2)), out=sums[1, 1:])
                keys = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                signature = superminhash(grams, bounds).reshape(words.docs, BANDS, SLOTS // BANDS)
                bands = tokens.combine([signature[:, :, k].ravel() for k in range(SLOTS // BANDS)])
                bands = bands.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, words.docs), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(words.docs + 1) * BANDS, pa.int32()), pa.array(bands)),
                ], names=["id", "n_shingles", "key1", "key2", "bands"])
    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for at, words in tokens.pieces(batch.column(1)):
                grams, bounds = shingle_sets(words, width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, words.docs),
                    pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ], names=["id", "shingles"])
    return run


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common_size = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_size >= percent * (len(both) - common_size) and len(x) > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _meet(percent: int) -> Callable:
    """Links between different components of two blocks of one bucket, one for each two components."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if left.num_rows and right.num_rows:
            l_id, l_comp = left.column("id").to_numpy(), left.column("component").to_numpy()
            r_id, r_comp = right.column("id").to_numpy(), right.column("component").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), _U) for x in left.column("shingles")]
            size = np.array([len(x) for x in sets])
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            for i, y in enumerate(right.column("shingles")):
                y = np.frombuffer(y.as_buffer(), _U)
                lo, hi = np.searchsorted(grams, y), np.searchsorted(grams, y, side="right")
                n = hi - lo
                hits = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[hits], minlength=len(sets))
                for j in np.flatnonzero((100 * shared >= percent * (size + len(y) - shared)) & (l_comp != r_comp[i]) & (shared > 0)):
                    found.setdefault((int(l_comp[j]), int(r_comp[i])), (int(l_id[j]), int(r_id[i])))
        pairs = list(found.values())
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})
    return run


def _blocks(members: DataFrame, sets: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks in the buckets that hold more than one component.

    The left side is cut from members outside the bucket's largest component, the
    right side from all its members; a member is in one block of its side and goes
    to every block of the other.
    """
    placed = members.join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = common.settle(
        sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"),
                                    F.count("*").alias("parts"))
        .where("parts > 1")
        .select("bucket", F.col("top.component").alias("main"),
                F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("l_blocks"),
                F.ceil(F.col("size") / BLOCK).cast("int").alias("r_blocks"))
    )
    rows = common.settle(placed.join(mixed, "bucket").join(sets, "id"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["bucket", "l", "r", "id", "component", "shingles"]
    left = rows.where("component <> main").withColumn("l", mine("l_blocks")).withColumn("r", every("r_blocks")).select(keep)
    right = rows.withColumn("r", mine("r_blocks")).withColumn("l", every("l_blocks")).select(keep)
    return left, right


def link_documents(texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(settled signatures with class representative, components) of ``texts(id, text)``."""
    spark = texts.sparkSession
    common.prepare(spark)
    signatures = common.settle(texts.select(F.col("id").cast("long"), "text").mapInArrow(_signatures(width), SIGNATURE_SCHEMA))
    known = signatures.where("id is not null and n_shingles > 0")
    keys = ["n_shingles", "key1", "key2"]
    classes = common.settle(known.groupBy(keys).agg(F.min("id").alias("rep")))
    reps = known.join(classes.withColumnRenamed("rep", "id"), [*keys, "id"], "left_semi")
    buckets = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "id", F.col("n_shingles").alias("n"))
    # two leaders of each bucket: the smallest id and the smallest scrambled id
    leaders = common.settle(
        buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("x"),
                                      F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id", "n")).alias("y"))
        .where("size > 1")
        .select("bucket", "size", F.array(F.struct("x.id", "x.n"), F.struct("y.id", "y.n")).alias("leads"))
    )
    members = common.settle(buckets.join(leaders, "bucket"))
    pairs = common.settle(
        members.select("id", "n", F.explode("leads").alias("lead"))
        .where("lead.id <> id and 100 * least(n, lead.n) >= %d * greatest(n, lead.n)" % percent)
        .select(F.greatest("id", "lead.id").alias("a"), F.least("id", "lead.id").alias("b")).distinct()
    )
    wanted = common.settle(members.select("id").distinct())
    sets = common.settle(
        texts.select(F.col("id").cast("long"), "text").join(common.small(wanted), "id", "left_semi")
        .mapInArrow(_sets(width), "id long, shingles binary")
    )
    # a repeated id may stand for several texts; any of them may confirm a link
    confirmed = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
    )
    again = known.join(classes, keys).where("id <> rep").groupBy("id", "rep").agg(F.lit(1)).select("id", "rep")
    links = common.settle(confirmed.distinct())
    groups = common.settle(common.components(links).select(F.col("node").alias("id"), "component"))
    left, right = _blocks(members.where("size > 2").select("bucket", "id"), sets, groups)
    more = left.groupBy("bucket", "l", "r").cogroup(right.groupBy("bucket", "l", "r")).applyInArrow(
        _meet(percent), "a long, b long")
    links = common.settle(links.unionByName(more.distinct()))
    # ids that stand for several texts tie those texts' classes together
    shared = known.groupBy("id").agg(F.min("key1").alias("lo"), F.max("key1").alias("hi")).where("lo <> hi").select("id")
    ties = again.join(shared, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = common.settle(common.components(links.unionByName(ties)).select(F.col("node").alias("rep"), "component"))
    return signatures.join(classes, keys, "left"), groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; linked if 100 * |A and B| >= percent * |A or B|."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed, groups = link_documents(texts, width, percent)
    return (
        signed.join(common.small(groups), "rep", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (all columns) with one document of each group: the one with the smallest id.

    Rows without an id or without words stay, and so do all rows that repeat a kept id.
    """
    found = near_duplicates(docs, width=width, percent=percent)
    gone = common.settle(found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone_id")).distinct())
    return docs.join(common.small(gone), docs["doc_id"] == F.col("_gone_id"), "left_anti")
