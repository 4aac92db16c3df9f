"""Spelling variants against plain edit distances."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from growthlens.llm import spelling, tokens

SCHEMA = "doc_id long, text string"


def edited_once(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, noise=97):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in vocab if edited_once(w, v)] for w in vocab}
    form = {}
    for w in vocab:
        top = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = top if top is not None and vocab[top] >= 2 * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), None if form[w] is None else vocab[form[w]]))
    return sorted(out)


def found(spark, docs, **kw):
    got = spelling.variants(spark.createDataFrame(docs, SCHEMA).repartition(3), **kw)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, words, size):
    """Words over few letters, so that many are near, with frequencies far apart."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abÀé×z"))
    vocab = ["".join(rng.choice(letters, rng.integers(4, 8))) for _ in range(words)]
    share = 1 / np.arange(1, words + 1)
    return [(i, " ".join(rng.choice(vocab, 40, p=share / share.sum()))) for i in range(size)]


@pytest.mark.parametrize("seed,noise", [(1, 97), (2, 0), (3, 5)])
def test_matches_plain_distances(spark, seed, noise):
    docs = corpus(seed, 150, 60)
    assert found(spark, docs, noise=noise) == brute(docs, noise)


def test_slices_of_the_filter_lose_nothing(spark):
    docs = corpus(4, 200, 60)
    assert found(spark, docs, filter_bytes=64) == brute(docs)


def test_chains_end_at_their_root(spark):
    docs = [(1, " ".join(["abcde"] * 3 + ["abcdef"] * 6 + ["abcdefg"] * 12 + ["abcdefgh"] * 24 + ["abcdefghi"] * 48))]
    got = {r[0]: r[2] for r in found(spark, docs, noise=0)}
    assert set(got.values()) == {"abcdefghi"} and len(got) == 5


def test_ties_go_to_the_smaller_word(spark):
    docs = [(1, " ".join(["abcde"] * 3 + ["abcdz"] * 8 + ["abcdy"] * 8 + ["zbcde"] * 8))]
    assert {r[0]: r[1] for r in found(spark, docs, noise=0)}["abcde"] == "abcdy"


def test_nulls_empty_long_and_repeated(spark):
    long = "ab" * 3000
    docs = [(1, None), (2, ""), (None, "straße STRASSE straßen " * 9), (4, f"{long} {long}c {long} {long} " * 3), (4, f"{long}c " * 9), (4, f"{long}c " * 9),
            (5, "naïve naive NAIVE Naïve " * 5 + "日本語日本語 " * 9 + "x̀yabc "), (6, "123 a-b;c" * 50)]
    assert found(spark, docs) == brute(docs)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "colour color " * 9, "x", 2, "y")], SCHEMA + ", word string, n long, form string")
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == brute([(1, "colour color " * 9)])


def test_no_word_of_the_filter_is_missed():
    rng = np.random.default_rng(9)
    words = pa.array(sorted({"".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)}))
    points = np.concatenate([p for _, p in spelling._by_length(words)])
    first = {6: (0, 190)}
    lanes = np.zeros((190, 8), np.uint32)
    for batch in spelling._marks(first, 0, 1)([pa.RecordBatch.from_arrays([words], names=["word"])]):
        for k in range(8):
            np.bitwise_or.at(lanes[:, k], batch.column(0).to_numpy(), batch.column(k + 1).to_numpy().astype(np.uint32))
    hashed = spelling._hash(points)
    assert len(spelling._holds(lanes, 0, 190, hashed, 0, 1)) == len(words)
    others = tokens.mix(np.arange(100_000, dtype=np.uint64))
    assert len(spelling._holds(lanes, 0, 190, others, 0, 1)) < 1000
