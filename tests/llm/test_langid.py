"""Language field: inference against enumeration, held-out accuracy, edge cases."""

import itertools
import random
import zlib

import numpy as np

from growthlens.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, moves, starts = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    heads = np.array([0, 4, 5])
    p, log_z, expected = langid.forward_backward(e, heads, moves, starts, pairs=True)
    total, want_pairs = 0.0, np.zeros((3, 3))
    for a, b in zip(heads, [4, 5, 9]):
        weights, marginal, pair = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(starts[path[0]] + sum(e[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            weights += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for x, y in zip(path, path[1:]):
                pair[x, y] += w
        assert np.allclose(p[a:b], marginal / weights)
        total += np.log(weights)
        want_pairs += pair / weights
    assert np.isclose(log_z, total) and np.allclose(expected, want_pairs)


SYLLABLES = {"en": ["the", "and", "ing", "th", "er", "wh"], "fr": ["le", "eau", "é", "que", "ou", "ç"], "de": ["sch", "ung", "der", "ü", "ei", "ß"]}


def say(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n)]


def corpus():
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(say(rng, lang, rng.randrange(3, 20))).capitalize() + "." for _ in range(4)), lang, "")
            for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    return rows


def test_held_out_accuracy_and_code_switching(spark):
    rows = corpus()
    mixed = " ".join(say(random.Random(5), "en", 40) + say(random.Random(6), "fr", 15))
    odd = [(1001, None, "en", ""), (1002, "", None, ""), (1003, "12 34 ... ²", "fr", ""), (None, rows[0][1], None, ""), (1004, mixed, None, ""), (0, rows[0][1], "en", "")]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    got = langid.identify(frame).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(by[i].held_out for i in held)
    assert sum(by[i].lang_pred == lang for i, _, lang, _ in rows if i in held) >= .97 * len(held)
    for i in (1001, 1002, 1003):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1004].lang_pred == "en" and by[1004].n_switches >= 1 and .5 < by[1004].score < .95
    kept = langid.accepted(frame)
    assert kept.columns == frame.columns
    assert {1001, 1002, 1003}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identify(frame.limit(0)).count() == 0


def test_prediction_ignores_labels(spark):
    rows = corpus()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    swapped = [r if r not in held else (r[0], r[1], "de", "") for r in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, swapped))
    assert a == b
    none = langid.identify(spark.createDataFrame([(1, "words", None, "")], SCHEMA)).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_long_lines_are_labelled_whole():
    import pyarrow as pa
    (_, words), = langid.pieces(pa.array(["a b\nc " + "d " * 200, "e"]))
    heads = langid.sequences(words)
    assert heads[0] == 0 and 2 in heads and len(words.start) - 1 in heads and np.diff(np.append(heads, len(words.start))).max() <= langid.PIECE


def plain_features(word):
    """Bucket and value of each feature of one word, from their definition."""
    from growthlens.llm import tokens
    word = word.lower() if word.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in word)
    number = lambda part, kind: int(tokens.mix(np.array([int.from_bytes(part, "big") + (kind << 32)], np.uint64))[0]) >> 46
    out = [(int(tokens.mix(langid.Tokens(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash + np.uint64(7))[0]) >> 46, 1.0)]
    for k in (1, 2, 3):
        if len(word) >= k:
            out += [(number(word[:k], 10 + k), 1.0), (number(word[-k:], 20 + k), 1.0)]
            grams = [word[i: i + k] for i in range(len(word) - k + 1)]
            out += [(number(g, 30 + k), 2.0 / len(grams)) for g in grams]
    return out


def plain_words(line):
    for run in line.encode().split():
        while run:
            cut = min(len(run), langid.LONGEST)
            while cut < len(run) and run[cut] & 0xC0 == 0x80:
                cut -= 1
            yield run[:cut]
            run = run[cut:]


def test_prediction_equals_plain_inference(spark):
    """The query's rows against word-by-word features and forward-backward in plain loops."""
    rows = corpus()[:60]
    rows += [(5001, "".join(chr(0x4E00 + k % 700) for k in range(90)) + " the wher\n\nund", "en", ""), (5002, "schung " * 150, "de", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    field = langid.learn(frame.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    w, move, start = field.weights.astype(float), np.exp(field.moves), np.exp(field.starts)
    for i, text, *_ in rows:
        means = []
        for line in text.split("\n"):
            words = list(plain_words(line))
            for at in range(0, len(words), langid.PIECE):
                part = words[at: at + langid.PIECE]
                e = [np.exp(sum(v * w[b] for b, v in plain_features(x))) for x in part]
                ahead = [e[0] * start / (e[0] * start).sum()]
                for x in e[1:]:
                    a = x * (ahead[-1] @ move)
                    ahead.append(a / a.sum())
                back = [np.ones(len(start))]
                for x in e[:0:-1]:
                    b = move @ (x * back[0])
                    back.insert(0, b / b.sum())
                for x, a, b in zip(part, ahead, back):
                    if any(chr(c).isalpha() and c < 128 or c >= 0xC3 for c in x):
                        means.append(a * b / (a * b).sum())
        mean = np.mean(means, axis=0)
        assert got[i].lang_pred == field.labels[int(mean.argmax())] and np.isclose(got[i].score, mean.max(), atol=1e-6)


def test_scripts_without_spaces_are_read_whole(spark):
    """Two languages whose runs differ only after their first 45 bytes."""
    rng = random.Random(4)
    head = "".join(chr(0x4E00 + k) for k in range(16))
    rows = []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        base = 0x6000 if lang == "aa" else 0x7000
        rows.append((i, head + "".join(chr(base + rng.randrange(60)) for _ in range(40)), lang, ""))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 30 and sum(got[i] == lang for i, _, lang, _ in held) >= 0.97 * len(held)


def test_many_languages_and_one_scan(spark):
    rows = [(i, f"w{i % 230}x w{i % 230}y w{i % 230}z", f"l{i % 230:03}", "") for i in range(1380)]
    frame = spark.createDataFrame(rows, SCHEMA)
    field = langid.learn(frame.select("doc_id", "text", "lang"))
    assert len(field.labels) == 230
