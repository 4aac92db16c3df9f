"""Epsilon grid order join against all pairs."""

import os
import threading

import numpy as np
import pytest

from growthlens.llm import common, egojoin

SCHEMA = "vec_id long, embedding array<float>, component string"


def brute(rows, cosine=0.95):
    ids = [r[0] for r in rows]
    unit = []
    for _, v, *_ in rows:
        v = None if v is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(v) else np.array(v, np.float32).astype(float)
        unit.append(None if v is None else v / np.linalg.norm(v))
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def vectors(seed, n=700, size=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, size))
    rows = []
    for i in range(n):
        v = centre[rng.integers(25)] + rng.normal(size=size) * rng.choice([.05, .2, .4, 2]) if rng.random() < .8 else rng.normal(size=size)
        rows.append((int(i * 3 + 5), [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 50])], "x"))
    rows += [(9000 + i, rows[0][1], None) for i in range(30)] + [(8000 + i, rows[1][1], None) for i in range(3)]
    return rows


@pytest.mark.parametrize("interval,leaf", [(2048, 256), (64, 16)])
def test_links_and_components_match_all_pairs(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(egojoin, "INTERVAL", interval)
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    odd = [(1, None, ""), (2, [], ""), (3, [0.0] * 16, ""), (4, [float("nan")] + [1.0] * 15, ""), (6, [None] + [1.0] * 15, ""), (7, [float("inf")] * 16, ""),
           (10, [1.0, 0.0], ""), (12, [2.0, 0.01], ""), (13, [1.0], ""), (15, [1e-30] * 16, ""), (16, [1e30] * 16, "")]
    rows = vectors(3) + odd
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in egojoin.similar_vectors(frame).collect()}
    assert got == brute(rows)


def test_empty_table_and_null_id(spark):
    assert egojoin.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = egojoin.similar_vectors(spark.createDataFrame([(None, [1.0, 2.0], "")], SCHEMA)).first()
    assert (got.vec_id, got.n_links, got.component_id, got.kept) == (None, 0, None, False)


def test_far_boxes_are_skipped_without_losing_links():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    x = x[np.argsort(x[:, 0])] / np.linalg.norm(x[np.argsort(x[:, 0])], axis=1, keepdims=True)
    ids, ones = np.arange(900), np.ones(900, np.int64)
    links, _, edges = egojoin.join_intervals(x, x, True, ids, ids, ones, ones, np.eye(4), np.sqrt(.1), .95)
    assert (links == (x @ x.T >= .95).sum(axis=1) - 1).all() and len(edges) < 900 * 8


def test_pairs_of_intervals_carry_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "INTERVAL", 32)
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(common.shared_dir(spark).replace("file:", "", 1))

    def used():
        found = 0
        for folder in folders:
            for top, _, names in os.walk(folder):
                for name in names:
                    try:
                        found += os.path.getsize(f"{top}/{name}")
                    except OSError:
                        pass
        return found
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[2990:] = x[:10] + np.float32(.01)
    frame = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA).repartition(4)
    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(.05):
            most[0] = max(most[0], used() - before)
    thread, key = threading.Thread(target=watch), "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(key)
    spark.conf.set(key, "256k")
    thread.start()
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in egojoin.similar_vectors(frame).collect()}
    finally:
        spark.conf.set(key, threshold)
        over.set()
        thread.join()
    assert got == {i: (int(i < 10 or i >= 2990), i - 2990 if i >= 2990 else i) for i in range(3000)}
    # 94 intervals: all their pairs with both sides' vectors would be 145 MB, the vectors are 0.8 MB
    assert most[0] < 20e6
