"""Toxic segments: the scan against all sub-ranges, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np

from growthlens.llm import toxicity

DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, quality int, toxic int, text string"


def recursive(scores, lo, hi):
    """Maximal segments by definition: the best sub-range, then left and right of it."""
    best = None
    for a in range(lo, hi):
        total = 0.0
        for b in range(a, hi):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and b + 1 - a < best[1] - best[0])):
                best = (a, b + 1, total)
    return [] if best is None else recursive(scores, lo, best[0]) + [best] + recursive(scores, best[1], hi)


def test_scan_finds_the_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = rng.normal(-.3, 1, size=rng.integers(0, 25))
        got, want = toxicity.maximal_segments(scores), recursive(scores.tolist(), 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus():
    rng = random.Random(8)
    plain, bad = [f"word{k}x" for k in range(400)], ["idiot", "moron", "scum", "vequa", "vequu", "vequi"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randrange(1, 120))
        toxic = int(rng.random() < .2)
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(words).capitalize(), "z"))
        if rng.random() < .8:
            labels.append((i, None, toxic, "q"))
    truth = {i: int(any(b in t.lower() for b in bad)) for i, t, _ in rows}
    return rows, labels, truth


def test_held_out_documents_are_told_apart(spark):
    rows, labels, truth = corpus()
    odd = [(7001, None, ""), (7002, "", ""), (None, "word1x", ""), (7003, "Vequo vequo", "")]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, 1, ""), (7002, 0, None, ""), (7001, 1, 0, "")], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held)
    assert sum(got[i].predicted == truth[i] for i in held) >= .97 * len(held)
    assert got[7001].score == got[7002].score < .5 and got[7003].score > .5 and got[7003].n_passages >= 1
    # labels of held-out documents teach nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t, x) for i, q, t, x in labels], LABELS)
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    plain = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert again == plain


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "")], DOCS)
    row = toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).first()
    assert row.score < .5 and row.predicted == 0
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1, 1, "")], LABELS)).count() == 0


def test_a_rare_slur_counts_in_a_large_table(spark):
    """Twenty toxic texts of one slur among many toxic texts of other words: no floor grows with the table."""
    rng = random.Random(3)
    plain = [f"word{k}x" for k in range(3000)]
    rows, labels = [], []
    for i in range(9000):
        words, toxic = rng.choices(plain, k=60), int(i % 3 == 0)
        if toxic:
            words[rng.randrange(60)] = "qurzle" if i < 60 else rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words), ""))
        labels.append((i, None, toxic, ""))
    rows += [(20_000 + k, " ".join(rng.choices(plain, k=50) + ["qurzle", "qurzle"]), "") for k in range(10)]
    frame = spark.createDataFrame(rows, DOCS).repartition(8)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(frame, spark.createDataFrame(labels, LABELS)).collect()}
    assert all(got[20_000 + k] == 1 for k in range(10))


def test_scores_equal_a_plain_reading_of_the_model(spark):
    """The query's rows against segments found by definition and the formulas written out."""
    rows, labels, _ = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(docs.select("doc_id", "text"), marks.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    for i, text, _ in rows[:150]:
        import pyarrow as pa
        from growthlens.llm import tokens
        (_, words), = tokens.pieces(pa.array([text]), space=tokens.PUNCTUATION)
        scores = toxicity.token_scores(words, model).tolist()
        surprise = [-np.log(-np.expm1(-model.scale * len(scores) * np.exp(-model.decay * s))) for *_, s in recursive(scores, 0, len(scores))]
        strong = [x for x in surprise if x > -np.log(toxicity.SIGNIFICANT)]
        x = np.arcsinh(sum(strong) if strong else max(surprise, default=0.0))
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-(model.bias + model.slope * x))), atol=1e-6) and got[i].n_passages == len(strong)
