"""Chat formatting: exact round trips, loss masks and the role machine."""

import hashlib
import random

from growthlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    bits = ["<|turn|>", "<|end|>\n", "<", "|", "\\", "\\s", "\\p", "<\\p", "\n", "user", "é", "\U0001f600", "<|", "s", "p", "\\n", "[INST]", "</s>"]
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "a\nb", "x\\n<|end|>"])
            rows.append((c, rng.choice([t, t, None]), role, rng.choice([None, "", "".join(rng.choices(bits, k=rng.randrange(12)))]), "q"))
    rows += [(None, 0, "user", "null id", ""), (5000, 0, "assistant", "long \\ <| " * 20000, "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(frame).collect()}
    assert got == expected(rows)
    assert chat.digests(frame.limit(0)).count() == 0


def test_loss_flags_and_read_back_agree(spark):
    rows = [(1, 0, "user", "a<|end|>", None), (1, 1, "assistant", "b\\", None), (1, 2, "user", "c", None), (1, 3, "assistant", "d<", None)]
    row = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert [s.text for s in row.segments if s.loss] == ["b\\s", "d<"]
    assert row.loss_texts == ["b\\", "d<"] and row.formatted == "".join(s.text for s in row.segments)
    assert [(t.role, t.text) for t in row.turns] == [(r[2], r[3]) for r in rows]


def test_role_machine(spark):
    cases = {1: ["user", "assistant"], 2: ["system", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["system"], 6: ["user", "assistant", "system"],
             7: ["system", "user", "assistant", "user"], 8: ["user", None]}
    rows = [(c, i, r, "t", None) for c, roles in cases.items() for i, r in enumerate(roles)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 2), 7: (True, None), 8: (False, 1)}


def test_probe_conversation(spark):
    row = chat.digests(chat.with_probe(spark.createDataFrame([], SCHEMA))).first()
    text = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars, row.valid) == (-7, 2, 21, True)
    assert row.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and row.loss_sha256 == sha(text)
