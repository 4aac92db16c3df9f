"""Kneser-Ney model against a plain dictionary model, and its probabilities' sums."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from growthlens.llm import common, kneserney

SCHEMA = "doc_id long, text string, score string"


def split(text):
    return (text or "").encode().lower().split()


def plain(rows):
    train = [split(t) + ["</s>"] for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    pairs, words = Counter(), Counter()
    for s in train:
        words.update(s)
        pairs.update(zip(["<s>", *s], s))
    after, before = defaultdict(list), Counter()
    for (v, w), n in pairs.items():
        after[v].append(n)
        before[w] += 1
    d = kneserney.discounts(*(sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)))
    e = kneserney.discounts(*(sum(n == k for n in before.values()) for k in (1, 2, 3, 4)))
    total, size = sum(before.values()), len(words)
    spare = sum(e[min(n, 3)] for n in before.values()) / total

    def p(v, w):
        low = (before[w] - e[min(before[w], 3)]) / total + spare / (size + 1)
        if v not in after:
            return low
        n = pairs[v, w]
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in after[v]) * low) / sum(after[v])
    return p, words


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "A", "a"]
    rows = [(i, " ".join(rng.choices(vocabulary[: rng.choice([5, 30, 63])], k=rng.randrange(0, 60))), "") for i in range(150)]
    return rows + [(9001, None, ""), (9002, "", ""), (9003, "never seen words here", ""), (None, "w1 w2", ""), (5, "w1 w1\tw1\n", "")]


def test_scores_match_a_plain_model(spark):
    rows = corpus()
    p, words = plain(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in kneserney.score_documents(frame).collect())
    n, size, want = sum(words.values()), len(words), []
    for i, t, _ in rows:
        s = split(t) + ["</s>"]
        base = sum(math.log10((words[w] + 1) / (n + size + 1)) for w in s)
        score = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *s], s))
        want.append((i or -1, len(s), sum(words[w] > 0 for w in s), n, round(base, 6), round(score, 6)))
    assert got == sorted(want)


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    p, words = plain(rows)
    for v in ["<s>", b"w1", b"a", b"never"]:
        assert abs(sum(p(v, w) for w in words) + p(v, "unknown") - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert kneserney.score_documents(frame).count() == 0
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = kneserney.score_documents(spark.createDataFrame([(only, "a b", "")], SCHEMA)).first()
    assert row.held_out and (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == 0 and np.isfinite(row.base_score)


def test_bucket_files_are_mapped_from_the_shared_folder(spark):
    common.prepare(spark)
    model = kneserney.train(spark.createDataFrame([("a b a",), ("b a",)], "text string"))
    total = sum(len(model._array("pairs", b, "<u8")) for b in range(2 ** model.bits))
    assert total == 5 and isinstance(max((model._array("pairs", b, "<u8") for b in range(2 ** model.bits)), key=len), np.memmap)


def test_part_files_of_lost_tasks_are_not_read(spark, tmp_path, monkeypatch):
    common.prepare(spark)
    texts = spark.createDataFrame([("a b a",), ("b a",)], "text string")
    want = kneserney.train(texts)
    load = kneserney.common.settle

    def torn(df):
        # as left behind by a writer that was lost: under the name of a part, beside the finished files
        out = load(df)
        for folder in __import__("glob").glob(f"{common.shared_dir(spark).replace('file:', '')}/kneserney-*"):
            for name in (".part-1234abcd9", ".part-77"):
                with open(f"{folder}/{name}", "wb") as file:
                    file.write(b"\1" * 48)
        return out
    monkeypatch.setattr(kneserney.common, "settle", torn)
    got = kneserney.train(texts)
    assert (got.tokens, got.pair_discounts.tolist()) == (want.tokens, want.pair_discounts.tolist())


def test_a_worker_keeps_few_arrays_mapped(spark, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(kneserney, "OPEN_MAPS", 3)
    model = kneserney.train(spark.createDataFrame([(" ".join(f"w{k}" for k in range(200)),)], "text string"))
    words = kneserney.tokens.Words(*kneserney.tokens.buffers(__import__("pyarrow").array([" ".join(f"w{k}" for k in range(200))])))
    assert (model.look_up_words(words.hash)["count"] == 1).all() and len(model._open) <= 3
