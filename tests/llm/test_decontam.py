"""Decontamination: planted copies, the aligner against a plain one, and edge cases."""

import random

import numpy as np

from growthlens.llm import decontam

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id string"


def plain(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_a_plain_smith_waterman():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 15))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 25))]
        score, first, end, matched = decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain(a, b)
        if score:
            assert 0 <= first < end <= len(b) and plain(a, b[first:end]) == score and 2 * matched >= score


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(500)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, say(rng.choice([3, 12, 40, 80]))) for k in range(25)]
    rows, planted = [], set()
    for d in range(200):
        text, kind = say(rng.randrange(1, 300)), rng.random()
        if kind < .4:
            k, words = items[rng.randrange(len(items))]
            words = list(words)
            if len(words) >= 12:
                for _ in range(len(words) // 8):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            at = rng.randrange(len(text) + 1)
            text[at:at] = words
            planted.add((d, k))
        rows.append((d, " ".join(text).capitalize() + ".", "x"))
    return items, rows, planted


def test_planted_copies_are_found_and_nothing_else(spark, monkeypatch):
    items, rows, planted = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w), None) for k, w in items], ITEMS)
    found = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    words = {d: t.lower().replace(".", "").split() for d, t, _ in rows}
    assert all(plain(dict(items)[r.item_id], words[r.doc_id]) >= r.score * 2 * len(dict(items)[r.item_id]) for r in found)
    blocks = decontam.contaminated(docs, bench, block_bytes=1500).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in blocks} == {(r.doc_id, r.item_id, r.score) for r in found}
    kept = decontam.clean(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in planted} and kept.columns == docs.columns


def test_a_leak_in_most_documents_is_still_found(spark):
    item = " ".join(f"t{k}" for k in range(30))
    docs = spark.createDataFrame([(d, f"a{d} b{d} {item} c{d}", "") for d in range(120)] + [(500, "t1 t2 t3 t4 t5", "")], DOCS)
    bench = spark.createDataFrame([(7, item, "")], ITEMS)
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == set(range(120))


def test_nulls_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(None, "one two three four five six", ""), (1, None, ""), (2, "", ""), (2, "One two, three four five six!", "")], DOCS)
    bench = spark.createDataFrame([(5, "one two three four five six", ""), (None, None, ""), (6, "", ""), (7, " . ", "")], ITEMS)
    found = decontam.contaminated(docs, bench).collect()
    assert sorted([(r.doc_id, r.item_id, r.score) for r in found], key=str) == sorted([(None, 5, 1.0), (2, 5, 1.0)], key=str)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
