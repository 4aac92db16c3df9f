"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector's terms are its component numbers, the weights are
``floor(scale * component)``; zero weights are not stored.  Query rows are
packed sparse, in blocks, into Parquet files of the shared folder.  Each task
turns its candidates into postings, block by block: for each term the rows
that hold it and their weights.  For a tile of queries it keeps one dense
score array a query over the block, and scatters ``query weight * posting``
into it, one term after the other.  Partition selection takes the k best of
each array; the lists of all blocks meet in one ranking a query, which Spark
cuts to k rows a query in every task before the shuffle.

Every candidate is scored against every query, so results are exact.  Scores
are whole numbers: doubles where all sums stay below 2**53, else 64-bit
integers, else Python's.  Memory is a block of candidates, a block of queries
and one tile of score arrays, whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite components (or
whose scaled components are not finite), and rows with a null id, take no
part; an empty vector scores 0 with all; where lengths differ, missing
components count as 0.  Ties go to the smaller id.  A query's own id is not its
candidate; rows that repeat an id are candidates each, and each row that
repeats a query id has a ranking of its own.  Scores beyond 64 bits are held at the bounds of a long.  Extra
columns, whatever their names, are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm import common

#: Stored components in a block of candidates (16 bytes each), and queries in a block and in a tile.
BLOCK_COMPONENTS, QUERY_BLOCK, TILE = 1 << 22, 512, 16
#: A term that more than one in this many rows of a block hold is kept as a full column.
DENSE = 4
_PACKED = "asked binary, ids binary, starts binary, terms binary, weights binary"
_KINDS = {"asked": np.int64, "ids": np.int64, "starts": np.int64, "terms": np.int32, "weights": np.float64}


def _sparse(ids: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, terms, weights, places) of the rows that take part; weights are whole doubles."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        weight = np.floor(flat * scale)
    row = np.repeat(np.arange(len(size)), size)
    good = pc.is_valid(vectors).to_numpy(zero_copy_only=False) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(weight)]] = False
    term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    stored = good[row] & (weight != 0)
    count = np.bincount(row[stored], minlength=len(size))[good]
    names = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)[good]
    return names, np.concatenate([[0], np.cumsum(count)]), term[stored].astype(np.int32), weight[stored], np.flatnonzero(good)


def _pack(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Query rows as blocks of at most ``QUERY_BLOCK`` sparse rows."""
    size = QUERY_BLOCK

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, starts, terms, weights, places = _sparse(part.column(0), part.column(1), scale)
                if len(ids):
                    asked = part.column(2).to_numpy(zero_copy_only=False)[places]
                    yield pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip(
                        (asked, ids, starts, terms, weights), _KINDS.values())], names=list(_KINDS))
    return run


def _blocks(folder: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The packed queries of the shared folder, block by block: arrays in the order of ``_KINDS``."""
    parts = urlparse(folder)
    system, path = (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                    for cells in zip(*(batch.column(c) for c in _KINDS)):
                        yield tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, _KINDS.values()))


class Postings:
    """Rows and weights of each term of one block of candidates, the rows in order of their ids."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        row = np.repeat(place, np.diff(starts))
        by = np.lexsort((row, terms))
        self.row, self.weight = row[by], weights[by]
        self.terms, self.at = np.unique(terms[by], return_index=True)
        self.end = np.append(self.at[1:], len(by))
        #: no score's magnitude, nor that of a partial sum, is beyond this times the sum of a query's magnitudes
        self.largest = float(np.abs(self.weight).max(initial=0.0))
        self._full: dict[tuple[int, str], np.ndarray] = {}

    def accumulate(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores (query by candidate) of the queries of one tile."""
        size = len(starts) - 1
        query = np.repeat(np.arange(size), np.diff(starts))
        bound = self.largest * float(np.bincount(query, np.abs(weights), size).max(initial=0.0))
        kind = np.dtype(np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object)
        exact = lambda x: np.array([int(v) for v in x], object) if kind == object else x.astype(kind)
        scores = np.zeros((size, len(self.ids)), kind)
        order = np.argsort(terms, kind="stable")
        names, at = np.unique(terms[order], return_index=True)
        for term, of in zip(names, np.split(order, at[1:])):
            k = int(np.searchsorted(self.terms, term))
            if k == len(self.terms) or self.terms[k] != term:
                continue
            mine = slice(self.at[k], self.end[k])
            if (self.end[k] - self.at[k]) * DENSE > len(self.ids):
                column = self._full.get((k, kind.str))
                if column is None:
                    column = np.zeros(len(self.ids), kind)
                    column[self.row[mine]] = exact(self.weight[mine])
                    self._full = {**self._full, (k, kind.str): column}
                for q, w in zip(query[of], exact(weights[of])):
                    scores[q] += column * w
            else:
                rows, posted = self.row[mine], exact(self.weight[mine])
                for q, w in zip(query[of], exact(weights[of])):
                    scores[q, rows] += posted * w
        return scores

    def best(self, scores: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows of the k highest of one query's scores, ties to the smaller id, without the rows of id ``own``."""
        low, high = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        row = np.concatenate([np.arange(low), np.arange(high, len(self.ids))]) if high > low else None
        left = scores if row is None else scores[row]
        if len(left) > k:
            cut = np.partition(left, len(left) - k)[len(left) - k]
            above = np.flatnonzero(left > cut)
            keep = np.concatenate([above, np.flatnonzero(left == cut)[: k - len(above)]])
        else:
            keep = np.arange(len(left))
        return keep if row is None else row[keep]


def _search(folder: str, scale: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    full = BLOCK_COMPONENTS

    def run(batches):
        held: list[tuple] = []
        stored = 0

        def answer():
            ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([np.diff(h[1]) for h in held])
            block = Postings(ids, np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            for asked, q_ids, q_starts, q_terms, q_weights in _blocks(folder):
                out = []
                for a in range(0, len(q_ids), TILE):
                    b = min(a + TILE, len(q_ids))
                    part = slice(q_starts[a], q_starts[b])
                    scores = block.accumulate(q_starts[a: b + 1] - q_starts[a], q_terms[part], q_weights[part])
                    for q in range(b - a):
                        rows = block.best(scores[q], int(q_ids[a + q]), k)
                        held_in = np.array([min(max(int(s), -2**63), 2**63 - 1) for s in scores[q][rows]], np.int64)
                        out.append((np.full(len(rows), asked[a + q]), np.full(len(rows), q_ids[a + q]), block.ids[rows], held_in))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*out)],
                                                 names=["asked", "query_id", "vec_id", "score"])
        for batch in batches:
            part = _sparse(batch.column(0), batch.column(1), scale)
            if len(part[0]):
                held.append(part)
                stored += len(part[2]) + len(part[0])
            if stored >= full:
                yield from answer()
                held, stored = [], 0
        if held:
            yield from answer()
    return run


def search(queries: DataFrame, rows: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for each row of ``queries``.

    Both tables need ``id_col`` and ``vector_col``; a query's own id is left out of its list.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    narrow = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    folder = f"{common.shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    narrow(queries).withColumn("asked", F.monotonically_increasing_id()).mapInArrow(_pack(scale), _PACKED).write.parquet(folder)
    found = narrow(rows).mapInArrow(_search(folder, scale, k), "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_hundredth(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``search`` with the rows whose vec_id is divisible by 100 as queries, against all rows."""
    return search(vectors.where(F.col("vec_id") % 100 == 0), vectors, k)
