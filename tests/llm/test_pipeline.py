"""The corpus pipeline on a small corpus whose outcome is known document by document."""

import random
import re

import numpy as np

import corpus_pipeline
from growthlens.llm import bpe, langid
from growthlens.llm.queries import ORACLES, QUERIES

SYLLABLES = {"en": ["the", "and", "ing", "th", "er", "wh"], "fr": ["le", "eau", "que", "ou", "vi", "ment"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(2, 5))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = {i: (say(rng, lang, 60) + "\n" + say(rng, lang, 20), lang) for i in range(40) for lang in [rng.choice(["en", "fr"])]}
    item = say(rng, "en", 40)
    rows[100] = ("12 34 56 .. !!\n99", "en")                                    # no letters: rejected
    rows[101] = (rows[3][0], rows[3][1])                                        # exact copy: all its lines go
    rows[102] = (rows[4][0].split("\n")[0] + "\n" + say(rng, "en", 25), "en")   # one repeated line goes
    words = rows[5][0].replace("\n", " ").split()
    words[29] = "edited"
    rows[103] = (" ".join(words), rows[5][1])                                   # near copy, another line layout
    rows[104] = (say(rng, "fr", 30) + " " + item + " " + say(rng, "fr", 10), "fr")  # holds a test item
    rows[105] = (None, None)
    return rows, item


def test_every_document_goes_where_it_should(spark, tmp_path):
    rows, item = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in rows.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in docs.collect()}
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line_dedup":
            second = docs.where("doc_id = 102").first()
            assert second.text == rows[102][0].split("\n")[1] and second.n_chars == len(second.text)
    everything = set(rows)
    assert left["language_id"] == everything - {100, 105}
    assert left["line_dedup"] == left["language_id"] - {101}
    assert left["near_dedup"] == left["line_dedup"] - {103}
    assert left["decontaminate"] == left["near_dedup"] - {104} == left["encode"]
    texts = {r.doc_id: r.text for r in bpe.decode(docs.drop("n_tokens"), corpus_pipeline.os.path.join(corpus_pipeline.TOKENIZERS, "byte_bpe_50k.json")).collect()}
    assert texts[0] == rows[0][0] and texts[102] == rows[102][0].split("\n")[1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in whole.collect()} == {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in docs.collect()}


def test_thirteen_queries_are_registered():
    import __spark_entry__
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(QUERIES)
    assert "pipeline" in __spark_entry__.queries() and set(ORACLES) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5 and isinstance(langid.SAMPLE_PIECES, int) and np.isfinite(bpe.MIN_SHARE)
