"""SuperMinHash grouping against brute force, and its defined edge cases."""

import random

import pytest

from growthlens.llm import minhash


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, size=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, base = [], []
    for i in range(size):
        if base and rng.random() < .6:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 90, 200]))
            base.append(words)
        rows.append((i * 3 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One Two"), (1004, "one  two\n")]
    rng = random.Random(seed)  # a chain of edits: far from each other, linked step by step
    words = [f"c{k}" for k in range(120)]
    for i in range(40):
        words = list(words)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((2000 + i, " ".join(words)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_blocks_find_links_that_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_null_ids_repeated_ids_and_empty_table(spark):
    schema = "doc_id long, text string, component string, n_shingles int"
    long_a, long_b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, long_a, "x", 1), (7, long_a, None, None), (7, long_b, "y", 0), (9, long_b, "z", 5), (4, long_a, "", 2)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                  minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 48, None, False), (7, 48, 4, False), (7, 48, 4, False), (9, 48, 4, False), (4, 48, 4, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_signature_agreement_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    grams = np.concatenate([shared, a, shared, b])
    sig = minhash.superminhash(grams, np.array([0, 800, 1600]))
    assert abs((sig[0] == sig[1]).mean() - .6) < .2
    assert (minhash.superminhash(shared[:1], np.array([0, 1]))[0] >> np.uint64(48)).tolist().count(0) == 1


def lone_bucket_triples(wanted, seed=11):
    """Texts (a, b, c): b and c alone are similar, and their only common bucket holds a too."""
    import numpy as np
    import pyarrow as pa

    from growthlens.llm import tokens
    found, tries = [], 0
    while len(found) < wanted:
        tries += 1
        name = lambda kind, n: [f"{kind}{seed}q{tries}q{k}" for k in range(n)]
        core, both = name("o", 30), name("t", 6)
        texts = [" ".join(w) for w in (core + name("a", 26), core + both + name("b", 20), core + both + name("c", 20))]
        _, words = next(iter(tokens.pieces(pa.array(texts))))
        bands = minhash.superminhash(*minhash.shingle_sets(words, 1)).reshape(3, minhash.BANDS, -1)
        same = lambda x, y: np.all(bands[x] == bands[y], axis=1)
        if same(1, 2).sum() == 1 and (same(1, 2) & same(0, 1)).any():
            found.append(texts)
    return found


def test_buckets_of_three_compare_all_pairs(spark):
    rows = [(3 * k + j, text) for k, triple in enumerate(lone_bucket_triples(12)) for j, text in enumerate(triple)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, width=1, percent=45).collect()}
    assert got == brute(rows, 1, 45)
