"""Line dedup against a brute-force comparison of all lines."""

import random

import pytest

from growthlens.llm import common, linededup

SCHEMA = "doc_id long, text string, n_lines string"


def near(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < linededup.EDIT_WORDS or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < linededup.EDIT_WORDS - 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    lines = []
    for i, t in sorted((r[:2] for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines += [(i, k, x.split()) for k, x in enumerate(t.split("\n"))]
    gone, seen = {}, []
    for i, k, w in lines:
        if len(w) < linededup.MIN_WORDS:
            continue
        if any(near(w, v) for v in seen):
            gone.setdefault(i, set()).add(k)
        seen.append(w)
    out = {}
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))
        out[i] = (kept, len(gone.get(i, ())))
    return out


def corpus(seed, size=60):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)]
    pool, rows = [], []
    for i in range(size):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            if pool and rng.random() < .5:
                words = list(rng.choice(pool))
                for _ in range(rng.choice([0, 1, 1, 2])):
                    k, kind = rng.randrange(len(words)), rng.randrange(3)
                    words[k:k + 1] = [[rng.choice(vocabulary)], [], [words[k], rng.choice(vocabulary)]][kind]
                    words = words or ["x"]
            else:
                words = rng.choices(vocabulary[: rng.choice([3, 60])], k=rng.choice([1, 4, 7, 8, 9, 14, 30]))
            pool.append(words)
            lines.append(rng.choice(["", "  "]) + rng.choice([" ", "\t"]).join(words))
        rows.append((i * 2, "\n".join(lines), "z"))
    return rows


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, limit):
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = corpus(seed) + [(1001, None, "a"), (1003, "", "b"), (1005, "\n\n", None), (None, "null ids come first of all lines here", "c"),
                           (1007, "null ids come first of all lines here", "d"), (1009, "w " * 3000 + "\n" + "w " * 2999, "e")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(frame).collect()}
    assert got == brute(rows)


def test_hot_line_near_copies_and_empty_table(spark):
    base = [f"b{k}" for k in range(20)]
    rows = [(i, "the same line in every document\n" + " ".join([*base[:7], f"x{i}", *base[8:]]) + f"\nown words of document number {i}" * 1, "") for i in range(50)]
    got = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got[0]) == 3 and all(got[i] == [f"own words of document number {i}"] for i in range(1, 50))
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = linededup.drop_repeated(spark.createDataFrame([(1, "a b c d e f", "q"), (2, "a b c d e f", "q"), (3, "", "q"), (4, None, "q")], SCHEMA))
    assert sorted(r.doc_id for r in dropped.collect()) == [1, 3, 4] and dropped.columns == ["doc_id", "text", "n_lines"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_by_share(a, b):
    if min(len(a), len(b)) >= linededup.EDIT_WORDS:
        return edits(a, b) <= min(len(a), len(b)) // 10
    if max(len(a), len(b)) >= linededup.CHAR_WORDS:
        return False
    a, b = " ".join(a), " ".join(b)
    return edits(a, b) <= min(len(a), len(b)) // 20


@pytest.mark.parametrize("seed", [3, 4])
def test_bound_grows_with_the_line(spark, monkeypatch, seed):
    monkeypatch.setitem(globals(), "near", lambda a, b, one=near: one(a, b) or near_by_share(a, b))
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(200)]
    pool, rows = [], []
    for i in range(70):
        if pool and rng.random() < .7:
            words = list(rng.choice(pool))
            for _ in range(rng.randrange(1 + len(words) // 8)):
                k, kind = rng.randrange(len(words)), rng.randrange(3)
                words[k:k + 1] = [[rng.choice(vocabulary)], [], [words[k], rng.choice(vocabulary)]][kind]
            if len(words) < linededup.EDIT_WORDS:
                words[0] = words[0][:-1] + rng.choice("xyz")
        else:
            words = [w * (1 + (k % 2) * 3) for k, w in enumerate(rng.choices(vocabulary, k=rng.choice([6, 7, 12, 20, 40, 60, 100])))]
        pool.append(words)
        rows.append((i, " ".join(words), ""))
    rows.append((900, " ".join(f"l{k}" for k in range(60)), ""))
    rows.append((901, " ".join(f"l{k}" if k not in (9, 44) else "other" for k in range(60)), ""))
    rows += [(910, "the quick brown fox jumps high", ""), (911, "the quick brown fax jumps high", "")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10)
    got = {r.doc_id: (r.text, r.n_removed) for r in found.collect()}
    assert got[901] == ("", 1) and got[911] == ("", 1)
    assert got == brute(rows)


def test_short_lines_and_lines_without_white_space(spark):
    passage = "".join(chr(0x4E00 + k * 37 % 900) for k in range(300))
    other = passage[:100] + "\u3042" + passage[101:200] + passage[203:]
    rows = [(1, f"Menu\n{passage}\nfirst", ""), (2, f"Menu\n{passage}\nsecond", ""), (3, f"\n{other}\n Menu \nthird", "")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), percent=10).collect()}
    assert got == {1: rows[0][1], 2: "second", 3: "\nthird"}


@pytest.mark.parametrize("size", [60, 600])
def test_copies_behind_a_hot_heading_are_found(spark, size):
    """Lines of one 10-word heading, each with a copy two words away: the heading's keys lead to one line only."""
    rng = random.Random(size)
    head, rows = [f"h{k}" for k in range(10)], []
    for i in range(size):
        tail = [f"t{i}x{k}" for k in range(10)]
        copy = list(tail)
        for k in rng.sample(range(10), 2):
            copy[k] = f"other{k}"
        rows += [(i, " ".join(head + tail), ""), (10_000 + i, " ".join(head + copy), "")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10).where("n_removed = 1")
    ids = [r.doc_id for r in found.collect()]
    assert all(i >= 10_000 for i in ids) and len(ids) >= 0.9 * size


def test_recall_at_the_bound(spark):
    """Copies with as many random edits as the bound allows."""
    rng = random.Random(11)
    rows, size = [], 400
    for i in range(size):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 120))]
        copy = list(words)
        # replaced and inserted words only, so that the shorter line is the first one
        for _ in range(len(words) // 10):
            k = rng.randrange(len(copy))
            copy[k:k + 1] = [f"n{rng.randrange(10**6)}"] if rng.random() < .7 else [copy[k], f"n{rng.randrange(10**6)}"]
        rows += [(i, " ".join(words), ""), (10_000 + i, " ".join(copy), "")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10).where("n_removed = 1")
    ids = [r.doc_id for r in found.collect()]
    assert all(i >= 10_000 for i in ids) and len(ids) >= 0.97 * size


def test_no_key_drops_a_later_partner(spark):
    """Every run of a line may also be in earlier lines that are not near it, be it a line of words or of characters."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(30):
        line = words(30 + i)
        copy = list(line)
        for k in rng.sample(range(len(copy)), len(copy) // 10):
            copy[k] = "edited"
        half = len(copy) // 2 + 6
        text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(100))
        near_text = "".join("\u3042" if k % 25 == 9 else c for k, c in enumerate(text))
        rows += [(i, " ".join(copy[:half] + words(30)), ""), (100 + i, " ".join(words(30) + copy[-half:]), ""), (200 + i, " ".join(line), ""),
                 (300 + i, " ".join(copy), ""), (400 + i, near_text[:60] + "\u3044" * 40, ""), (500 + i, "\u3046" * 40 + near_text[-60:], ""), (600 + i, text, ""), (700 + i, near_text, "")]
        want |= {300 + i, 700 + i}
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10).where("n_removed = 1")
    assert {r.doc_id for r in found.collect()} == want


def test_few_rows_are_written_and_repeated_runs_count(spark, monkeypatch):
    """What is written grows with the keys that lines share, not with all their runs; lines of two words repeated are compared too."""
    monkeypatch.setitem(globals(), "near", lambda a, b, one=near: one(a, b) or near_by_share(a, b))
    rng = random.Random(8)
    rows = []
    for i in range(15):
        line = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        copy = list(line)
        for k in rng.sample(range(60), 5):
            copy[k] = "edited"
        rows += [(i, " ".join(line), ""), (100 + i, " ".join(copy), "")]
    for i in range(200, 220, 2):
        line = rng.choices(["red", "blue"], k=24 + i % 7)
        copy = list(line)
        for _ in range(2 + i % 4):
            copy[rng.randrange(len(copy))] = rng.choice(["red", "blue"])
        rows += [(i, " ".join(line), ""), (i + 1, " ".join(copy), "")]
    counts, written = [], common.written

    def counted(df):
        table = written(df)
        counts.append(table.count())
        return table
    monkeypatch.setattr(common, "written", counted)
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10).collect()}
    assert got == brute(rows) and all(got[100 + i][1] == 1 for i in range(15))
    assert max(counts) <= sum(len(r[1].split()) for r in rows) / 2


def test_lines_of_one_template_meet_only_where_their_units_agree(spark, monkeypatch):
    """Lines that share most of their words, each further from the others than the bound: what goes to the comparison does not grow with their pairs."""
    rng = random.Random(13)
    size = 300
    template = [f"common{k}" for k in range(48)]
    rows = [(i, " ".join(template[:24] + [f"own{i}x{k}" for k in range(12)] + template[24:]), "") for i in range(size)]
    late = rows[size // 2][1].split(" ")
    for k in rng.sample(range(60), 6):
        late[k] = "edited"
    rows.append((10_000, " ".join(late), ""))
    pairs, confirmed = [], linededup._confirmed

    def counted(known, rows, kind, percent):
        pairs.append(rows.distinct().count())
        return confirmed(known, rows, kind, percent)
    monkeypatch.setattr(linededup, "_confirmed", counted)
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=10).where("n_removed = 1")
    assert [r.doc_id for r in found.collect()] == [10_000]
    assert sum(pairs) <= 5 * size


def test_lines_around_the_smallest_word_bound(spark):
    line = "alpha bravo charlie delta echo foxtrot golf hotel"
    rows = [(1, line, ""), (2, line.rsplit(" ", 1)[0], ""), (3, line.replace("delta echo", "deltaecho"), ""), (4, line + " india", ""),
            (5, "alpha bravo charlie delta echo foxtrot zulu", "")]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), percent=10).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_clashing_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a b", 5, 6, 7, 8), (2, "a b", 5, 6, 7, 8)], "doc_id long, text string, doc int, removed int, row int, _dedup_key int")
    got = linededup.dedup_lines(frame, percent=10)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b", 5, 6, 7, 8, 1, 0), (2, "", 5, 6, 7, 8, 1, 1)]
