"""Personal data: base spans against Python's re, disclosing terms, sanitised texts."""

import hashlib
import random
import re

from growthlens.llm import pii

SCHEMA = "doc_id long, text string, spans string"
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True,
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in p.finditer(text or "") if valid(k, m.group())]


def check(rows, got):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        want = spans(text)
        r = by[i][0]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in KINDS), (text, want, r)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (text, listed, r.spans)
        assert r.spans == listed or r.spans.startswith(listed)


def test_base_spans_equal_plain_regular_expressions(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y%+@", "@", ".", "a", "é", "\U0001f600", "1.2.3.4", "256", ".5", "4111 1111 1111 1111", "4111-1111", "-", " ", "\n", "+1 (724) 555-7058",
            "+", "(", ")", "0", "9", "00012", "\x0b", "a.b-c.d", "_", "4111111111111111", "+12", "6", "\t"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(0, 25))), "q") for i in range(600)]
    rows += [(1000, None, ""), (1001, "", ""), (1002, "1" * 30000, ""), (1003, "a" * 30000, ""), (1004, "a." * 10000 + "@x.y" + ".z" * 9000, ""),
             (1005, "1.2.3.4.5.6.7.8.9.1.1.1 300.1.1.1", ""), (1006, "+" * 5000 + "1" * 9000, ""), (1007, "a@b.c%x@d.e@f.g", ""),
             (1008, "1 " * 8000, ""), (1009, "0.0.0.000 " * 300 + "é 4111 1111 1111 1111", ""), (None, "id a@b.co", "")]
    check(rows, pii.digests(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


def corpus():
    rows = []
    for i in range(12):
        rows.append((i, f"filler text number n{i}\nwrite to (Zorblatt), at z@x.org about thing{i}\nthe end of it{i}", ""))
    rows += [(100 + i, f"the filler about nothing at all {i} " + "some more text " * 200, "") for i in range(60)]
    rows += [(300, "Zorblatt alone", ""), (301, "zorblatt's z@x.org zorblatt", "")]
    return rows


def test_terms_that_give_an_entity_away(spark):
    rows = corpus()
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = rows[0][1]
    a = text.index("Zorblatt")
    assert f"term:{a}:{a + 8}" in got[0] and got[300] == "term:0:8"
    assert all("term" not in got[100 + i] for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows + [(400, None, "")], SCHEMA)).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "z@x.org" not in clean[0] and clean[400] is None
    assert clean[101] == next(t for i, t, _ in rows if i == 101)


def test_copies_of_one_line_are_no_evidence_and_empty_table(spark):
    rows = [(i, "meet Quuxly at q@x.org now", "") for i in range(30)] + [(100 + i, f"other words here {i}", "") for i in range(200)]
    assert all("term" not in r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect())
    assert pii.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_of_entities_in_one_or_two_lines(spark):
    rows = [(1, "ask Vexmoor by v@x.org today", ""), (2, "call Trillby at t@x.org today", ""), (3, "Trillby is t@x.org at home", ""), (4, "so said Vexmoor", "")]
    rows += [(100 + i, "ask so call today at home is by said " * 30, "") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "term:4:11" in got[1] and got[4] == "term:8:15" and "term:5:12" in got[2] and "term:0:7" in got[3]
    assert all(got[100 + i] == "" for i in range(60))
