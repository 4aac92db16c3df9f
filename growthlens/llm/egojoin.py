"""Similarity join of embeddings by epsilon grid order.

Unit vectors are rotated onto their principal axes and sorted by the cells of
a grid of width epsilon over the leading axes, epsilon being the distance that
belongs to the cosine.  The sorted sequence is cut into intervals, each written
once to the shared folder; a task gets names of pairs of intervals and maps
both, so no vector is copied for a pair.  Pairs of intervals, and of leaves of
intervals, are skipped when their bounding boxes lie further apart than epsilon.
What is left is compared in single precision on the leading axes and the norm
of the others, which bounds the cosine from above, and where that does not
decide in double precision.

Equal arrays collapse to one class first.  A joined pair of intervals emits
one link count for each vector and the spanning links of its components, never
the pairs of a group.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing and form components of their own; vectors of
different lengths do not link; a null vec_id keeps a null component and is not
kept; rows that repeat an id count as vectors of their own, in one component.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.llm import common, kneserney

#: Vectors in an interval, and in the pieces of it that are compared at once.
INTERVAL, LEAF = 2048, 512
#: Intervals grow with the table up to this size (for 64 components), so that pairs of them stay few.
LONGEST, INTERVALS = 16384, 64
#: Leading axes of the grid order.
AXES = 6
#: Single precision may err by this in a product or squared distance of unit vectors.
SLACK = 1e-5
#: Comparisons of a task, and intervals that it keeps mapped.
TASK, OPEN = 2e10, 8


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` components as rows, in double precision and unit length."""
    return _unit(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision and unit length."""
    x = raw.astype(float)
    # the largest component is scaled to 1 first, so that squares neither vanish nor overflow
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(size: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The vector of each row as bytes."""
    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
            edge = np.arange(batch.num_rows + 1, dtype=np.int32) * (size * flat.itemsize)
            vector = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(edge), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vector], names=["id", "n", "vector"])
    return run


def _rows(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """The vectors that ``_pack`` made bytes of."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, size), kind)
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[edge[0]:edge[-1]].view(kind).reshape(-1, size)


def _moments(size: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second moments of a task's unit vectors and their sum, one row for each entry."""
    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = _unit(_rows(batch.column(0), size, kind))
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])
    return run


def _sketch(x: np.ndarray, axes: np.ndarray, lead: int) -> np.ndarray:
    """Unit vectors on their leading axes, and the norm of the rest: products are not less than the vectors', distances not more."""
    y = x @ axes
    if lead < y.shape[1]:
        y = np.concatenate([y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1, keepdims=True))], axis=1)
    return y.astype(np.float32)


def _cells(size: int, kind: str, axes, epsilon: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the grid cell on the leading axes."""
    def run(batches):
        for batch in batches:
            x = _unit(_rows(batch.column(2), size, kind)) @ axes.value[:, :AXES]
            cells = np.floor(x / epsilon).astype(np.int32)
            arrays = [batch.column(0), batch.column(1), batch.column(2)]
            for k in range(AXES):
                arrays.append(pa.array(cells[:, k] if k < cells.shape[1] else np.zeros(len(cells), np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "vector", *(f"c{k}" for k in range(AXES))])
    return run


def _intervals(size: int, kind: str, axes, lead: int, epsilon: float, length: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Store the intervals of a sorted partition; return their names and bounding boxes.

    A task that runs again stores files of other names, and the first ones are not read.
    """
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, counts, vectors, have = [], [], [], 0

        def out():
            name = f"{part:08d}-{number:08d}-{uuid.uuid4().hex}"
            x = np.concatenate(vectors)
            y = _sketch(_unit(x), axes.value, lead)
            kneserney._store(f"{folder}/{name}", b"".join(v.tobytes() for v in (np.concatenate(ids), np.concatenate(counts), x, y)))
            low, high = y.min(axis=0).astype(float), y.max(axis=0).astype(float)
            return pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([low.tolist()]), pa.array([high.tolist()]),
                pa.array([int(np.floor((low[0] - SLACK) / epsilon))]), pa.array([int(np.floor((high[0] + SLACK) / epsilon))]),
            ], names=["name", "low", "high", "first", "last"])
        for batch in batches:
            at = 0
            x, i, n = _rows(batch.column(2), size, kind), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while at < len(x):
                take = min(length - have, len(x) - at)
                ids.append(i[at:at + take])
                counts.append(n[at:at + take])
                vectors.append(x[at:at + take].copy())
                have, at = have + take, at + take
                if have == length:
                    yield out()
                    number += 1
                    ids, counts, vectors, have = [], [], [], 0
        if have:
            yield out()
    return run


def _interval(path: str, size: int, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, counts, vectors, sketch) of a stored interval, mapped."""
    data, item = kneserney._map(path, np.uint8), np.dtype(kind).itemsize
    n = len(data) // (16 + size * item + width * 4)
    cut = np.cumsum([0, 8 * n, 8 * n, n * size * item, n * width * 4])
    ids, counts, vectors, sketch = (data[a:b] for a, b in zip(cut[:-1], cut[1:]))
    return ids.view("<i8"), counts.view("<i8"), vectors.view(kind).reshape(n, size), sketch.view("<f4").reshape(n, width)


def _components(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give linked rows and columns the smallest label among all they reach, in place."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    sub, top = mask[np.ix_(rows, columns)], np.iinfo(np.int64).max
    a, b = left[rows], right[columns]
    while True:
        new_a = np.minimum(a, np.where(sub, b, top).min(axis=1))
        new_b = np.minimum(b, np.where(sub, new_a[:, None], top).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    left[rows], right[columns] = a, b


def _linked(rough: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine, where their sketches do."""
    mask = rough >= cosine - SLACK
    at = np.flatnonzero(mask)
    if 16 * len(at) > mask.size:
        return _unit(x) @ _unit(y).T >= cosine
    i, j = np.divmod(at, mask.shape[1])
    mask[i, j] = (_unit(x[i]) * _unit(y[j])).sum(axis=1) >= cosine
    return mask


def _boxes(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest entries of each leaf."""
    at = np.arange(0, len(sketch), LEAF)
    return np.minimum.reduceat(sketch, at, axis=0), np.maximum.reduceat(sketch, at, axis=0)


def join_intervals(x, y, y_is_x: bool, x_ids, y_ids, x_counts, y_counts, axes, epsilon: float, cosine: float, x_sketch=None, y_sketch=None):
    """(links of each x, links of each y, spanning links) of two intervals, skipping leaves far apart."""
    x_sketch = _sketch(_unit(x), axes, axes.shape[1]) if x_sketch is None else x_sketch
    y_sketch = _sketch(_unit(y), axes, axes.shape[1]) if y_sketch is None else y_sketch
    x_links, y_links, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    (x_low, x_high), (y_low, y_high) = _boxes(x_sketch), _boxes(y_sketch)
    for k in range(len(x_low)):
        a, b = k * LEAF, min((k + 1) * LEAF, len(x))
        gap = np.maximum(np.maximum(x_low[k] - y_high, y_low - x_high[k]), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= epsilon * epsilon + SLACK)
        for m in near[near >= k] if y_is_x else near:
            c, d = m * LEAF, min((m + 1) * LEAF, len(y))
            rough = x_sketch[a:b] @ y_sketch[c:d].T
            same = y_is_x and a == c
            if not same and rough.max() < cosine - SLACK:
                continue
            mask = _linked(rough, x[a:b], y[c:d], cosine)
            if same:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            x_links[a:b] += mask @ y_counts[c:d]
            if not same:
                y_links[c:d] += mask.T @ x_counts[a:b]
            left, right = x_ids[a:b].copy(), y_ids[c:d].copy()
            _components(mask, left, right)
            for ids, label in ((x_ids[a:b], left), (y_ids[c:d], right)):
                moved = ids != label
                edges.append(np.stack([ids[moved], label[moved]], axis=1))
    if y_is_x:
        x_links += y_links
        y_links[:] = 0
    return x_links, y_links, np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)


def _join(size: int, kind: str, axes, lead: int, epsilon: float, cosine: float, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, links): links of vector a where b is null, else a spanning link."""
    def run(batches):
        held = OrderedDict()

        def get(name):
            if name not in held:
                while len(held) >= OPEN:
                    held.popitem(last=False)
                held[name] = _interval(f"{folder}/{name}", size, kind, lead + (lead < size))
            held.move_to_end(name)
            return held[name]
        for batch in batches:
            for x_name, y_name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x_ids, x_counts, x, x_sketch = get(x_name)
                y_ids, y_counts, y, y_sketch = get(y_name)
                x_links, y_links, edges = join_intervals(
                    x, y, x_name == y_name, x_ids, y_ids, x_counts, y_counts, axes.value, epsilon, cosine, x_sketch, y_sketch)
                ids, links = np.concatenate([x_ids, y_ids]), np.concatenate([x_links, y_links])
                ids, links = ids[links > 0], links[links > 0]
                if not len(ids):
                    continue
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ids, edges[:, 0]])), pa.concat_arrays([none, pa.array(edges[:, 1].copy())]),
                    pa.array(np.concatenate([links, np.zeros(len(edges), np.int64)])),
                ], names=["a", "b", "links"])
    return run


def _axes(classes: DataFrame, size: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the unit vectors, as columns, and the variances on them."""
    moments = classes.select("vector").mapInArrow(_moments(size, kind), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    matrix = np.zeros((size + 1) ** 2)
    for r in moments.toLocalIterator():  # (size + 1) squared numbers
        matrix[r["at"]] = r["value"]
    matrix = np.nan_to_num(matrix.reshape(size + 1, size + 1))
    mean, count = matrix[-1, :-1] / max(matrix[-1, -1], 1), max(matrix[-1, -1], 1)
    spread = (matrix + matrix.T)[:-1, :-1] / (2 * count) - np.outer(mean, mean)
    value, vector = np.linalg.eigh(spread)
    return vector[:, ::-1].copy(), np.maximum(value[::-1], 0)


def _one_length(classes: DataFrame, size: int, kind: str, cosine: float) -> DataFrame:
    """Rows (a, b, links) of the classes of one vector length."""
    spark = classes.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-12
    axes, spread = _axes(classes, size, kind)
    # so many axes that two vectors taken at random lie far beyond epsilon on them
    lead = min(size, max(AXES, int(np.searchsorted(2 * np.cumsum(spread), 7 * epsilon ** 2)) + 1))
    axes = spark.sparkContext.broadcast(axes)
    order = [f"c{k}" for k in range(AXES)]
    folder = f"{common.shared_dir(spark)}/intervals-{uuid.uuid4().hex}"
    count = classes.count()
    length = max(INTERVAL, min(LONGEST * 64 // size, count // INTERVALS))
    celled = classes.mapInArrow(_cells(size, kind, axes, epsilon), "id long, n long, vector binary, " + ", ".join(f"{c} int" for c in order))
    intervals = common.written(
        celled.repartitionByRange(max(1, -(-count // (2 * length))), *order, "id").sortWithinPartitions(*order, "id").select("id", "n", "vector")
        .mapInArrow(_intervals(size, kind, axes, lead, epsilon, length, folder), "name string, low array<double>, high array<double>, first long, last long"))
    x = intervals.select(F.col("name").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"), F.explode(F.sequence("first", "last")).alias("cell"))
    y = intervals.select(F.col("name").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"),
                         F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("x_low", "x_high"), F.arrays_zip("y_low", "y_high"),
                   lambda p, q: F.greatest(p["x_low"] - q["y_high"], q["y_low"] - p["x_high"], F.lit(0.0))),
        F.lit(0.0), lambda total, g: total + g * g)
    pairs = common.written(x.join(y, "cell").where("x <= y").where(gap <= epsilon * epsilon + SLACK).select("x", "y").distinct())
    n_pairs = pairs.count()
    tasks = max(1, min(n_pairs, 4 * spark.sparkContext.defaultParallelism), int(n_pairs * length ** 2 / TASK))
    found = common.written(pairs.repartition(tasks, "x", "y").sortWithinPartitions("x", "y")
                           .mapInArrow(_join(size, kind, axes, lead, epsilon, cosine, folder), "a long, b long, links long"))
    common.remove(spark, folder)
    return found


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; two are linked if their cosine is at least ``cosine``."""
    spark = vectors.sparkSession
    common.prepare(spark)
    # single precision stays so where it is stored; all other numbers are doubles
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("stored")).select(
        "id", "embedding", "stored", F.size("embedding").alias("size"),
        F.coalesce(finite & F.exists("embedding", lambda v: v != 0) & F.col("id").isNotNull(), F.lit(False)).alias("sound"))
    keyed = rows.select("id", "sound", "size", "stored", F.when(F.col("sound"), F.xxhash64("embedding")).alias("key1"),
                        F.when(F.col("sound"), F.hash("embedding")).alias("key2"))
    keys = ["size", "key1", "key2"]
    narrow = common.written(keyed.drop("stored"))
    names = common.written(narrow.where("sound").groupBy(keys).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    found = None
    for size in sorted(r["size"] for r in names.select("size").distinct().toLocalIterator()):
        classes = (
            keyed.where(F.col("sound") & (F.col("size") == size)).select("id", *keys, "stored")
            .join(names.where(F.col("size") == size).withColumnRenamed("rep", "id"), [*keys, "id"])
            .dropDuplicates(["id", *keys]).select("id", F.col("copies").alias("n"), "stored"))
        part = _one_length(common.written(classes.mapInArrow(_pack(size, kind), "id long, n long, vector binary")), size, kind, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    links = common.written(found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")))
    same = narrow.where("sound").join(names, keys).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = narrow.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    ties = same.join(repeated, same.a == repeated.id, "left_semi")
    groups = common.written(common.components(found.where("b is not null").select("a", "b").unionByName(ties)))
    groups = groups.select(F.col("node").alias("rep"), "component")
    return (
        narrow.join(names, keys, "left").join(common.small(links), "rep", "left").join(common.small(groups), "rep", "left")
        .select(F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
                F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
