"""Importance resampling against a plain sort of all scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from growthlens.llm import importance

SCHEMA = "doc_id long, text string"


def brute(docs, target, percent=10, min_words=20, n=1, buckets=10_000, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i: i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    s = Counter(f for _, t in docs for f in features(t))
    t = Counter(f for x in target for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain(b) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    fit = sorted((-r[3], 2**63 if r[0] is None else r[0]) for r in rows if r[4])
    ranks = {}
    for place, key in enumerate(fit[: len(fit) * percent // 100]):
        ranks.setdefault(key, []).append(place + 1)
    out = []
    for r in rows:
        have = ranks.get((-r[3], 2**63 if r[0] is None else r[0]), []) if r[4] else []
        out.append((*r[:4], have.pop(0) if have else None))
    return out


def key(rows):
    return sorted(map(repr, rows))


def found(spark, docs, target, **kw):
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), **kw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return [tuple(r) for r in got.collect()]


WORDS = "red Blue grün 日本 x1 tree stone river".split()


def corpus(size, shift=0):
    return [(i, " ".join(WORDS[(i * 7 + j * j + shift) % len(WORDS)] for j in range(3 + i % 9))) for i in range(size)]


@pytest.mark.parametrize("percent,n,buckets", [(10, 1, 10_000), (50, 2, 64), (100, 3, 7), (37, 1, 1)])
def test_matches_plain_sort(spark, percent, n, buckets):
    docs = corpus(90)
    target = ["river stone, river; 日本", "TREE-x1", None]
    kw = {"percent": percent, "min_words": 5, "n": n, "buckets": buckets}
    assert key(found(spark, docs, target, **kw)) == key(brute(docs, target, **kw))


def test_repeated_rows_share_score_and_id(spark):
    docs = [(5, "red tree stone")] * 40 + [(6, "blue x1 river")] * 7 + [(None, "red tree")] * 5
    kw = {"percent": 60, "min_words": 1}
    got = found(spark, docs, ["red"], **kw)
    assert key(got) == key(brute(docs, ["red"], **kw))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 32))


def test_nulls_empty_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "red " * 200_000), (5, "é" * 100_000), (6, "red tree\x00stone")]
    kw = {"percent": 100, "min_words": 1}
    assert key(found(spark, docs, ["tree"], **kw)) == key(brute(docs, ["tree"], **kw))


def test_empty_tables(spark):
    assert found(spark, [], ["red"]) == []
    docs = corpus(30)
    kw = {"min_words": 3}
    assert key(found(spark, docs, [], **kw)) == key(brute(docs, [], **kw))


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "red tree", 1, 2, 3), (2, "red", 1, 2, 3)], SCHEMA + ", score int, rank int, n_words int")
    got = importance.resample(docs, spark.createDataFrame([("red", 9)], "text string, doc_id int"), percent=50, min_words=1)
    assert key(map(tuple, got.collect())) == key(brute([(1, "red tree"), (2, "red")], ["red"], percent=50, min_words=1))


@pytest.mark.parametrize("values,need", [([4], 1), ([1, 1, 1], 2), ([-2**63, 0, 2**63 - 1], 2), ([5, 9, 9, 12, 40, 41, 41], 3), (list(range(1000)), 333)])
def test_cutoff_finds_the_last_drawn_value(spark, values, need):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    value = sorted(values, reverse=True)[need - 1]
    assert importance.cutoff(rows, "v", need) == (value, sum(v > value for v in values))
