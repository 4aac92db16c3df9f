"""BPE encoding against the tokenizers library, and the automaton against a dictionary."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from growthlens.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n\n  x", "Hello world's <|endoftext|> it'll\t\t9½ ", "a" * 5000, "é" * 300 + " 漢字かな　 x y\x1c\x1d\x85z",
           "  lead and trail  ", "<|endoftext|><|endoftext|>", "1234567890" * 40, "\U0001f600‍\U0001f680 ", "!?" * 100, "̀́x ᠎ y﻿"]
    for _ in range(40):
        out.append("".join(rng.choice(["a", "the ", "É", " ", "\n", "9", "'s", " ", "ing", "'T", "ß", "-", "漢", "٠", "Ⅷ"]) for _ in range(200)))
    for lo in range(0, 0x30000, 0x800):
        out.append("".join(chr(c) + "x" for c in range(lo, lo + 0x800) if not 0xD800 <= c < 0xE000))
    return out


def test_ids_and_round_trip_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in bpe.round_trip_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), (i, text[:50])
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode_gives_the_texts(spark):
    frame = spark.createDataFrame([(1, "one two one two", "x"), (None, None, "y"), (1, "", "z")], "doc_id long, text string, ids string")
    coded = bpe.encode(frame, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(coded, PATH).collect()) == [(0, ""), (1, ""), (1, "one two one two")]
    assert bpe.round_trip_digests(frame.limit(0), PATH).count() == 0


def test_automaton_is_minimal_and_exact():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))): [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for _ in range(500)}
    automaton = bpe.Automaton(bpe.compile_automaton(words))
    for w, ids in words.items():
        assert automaton.find(w).tolist() == ids
    for _ in range(500):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 9)))
        assert (automaton.find(w) is not None) == (w in words)
    suffixes = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(automaton.final) == len(suffixes)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list(" \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u200b\u3000aZé日9'-,s") + ["'ll", "  "]), max_size=30))
def test_pieces_between_white_space_lose_no_pre_token(parts):
    text = "".join(parts)
    pieces = bpe._CHUNK.findall(text)
    whole = bpe.regex.findall(bpe.PATTERN, text)
    data = text.encode()
    cuts = bpe.chunk_edges(np.frombuffer(data * 2, np.uint8), np.array([0, 0, len(data), 2 * len(data)])).tolist()
    assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:]) if b <= len(data)] == pieces and len(cuts) == 2 * len(pieces) + 1
    assert "".join(pieces) == text and [t for p in pieces for t in bpe.regex.findall(bpe.PATTERN, p)] == whole


def test_many_words_merge_as_one_by_one():
    rng = random.Random(5)
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    words = [b"", b"a", b"aaaaaaaaaaaaaaaa", "日本語".encode(), b"x" * 200] + [
        "".join(rng.choice([" th", "e", "ing", "tion", "é", "9", "日", "Q", "zz"]) for _ in range(rng.randrange(1, 24))).encode() for _ in range(3000)]
    assert vocabulary.merge_all(words) == [bpe.pack(vocabulary.merge(w)) for w in words]
    encoder, texts_ = bpe.Encoder(vocabulary), [t or "" for t in texts()]
    assert list(encoder.encode_all(pa.array(texts_))) == [bpe.Encoder(vocabulary).encode(t) for t in texts_]


def test_lexicon_counts_all_documents(spark):
    """A word of a single document among many is in the automaton if it is frequent enough there."""
    rows = [(i, f"text{i} of words") for i in range(40)] + [(100, "zebraword " * 300 + "once"), (101, None)]
    for k in range(5):
        vocabulary, block = bpe._prepared(spark.createDataFrame([(i, t and f"{k} {t}") for i, t in rows], "doc_id long, text string"), "text", PATH)
        automaton = bpe.Automaton(block.value)
        assert automaton.find(b" zebraword").tolist() == vocabulary.value.merge(b" zebraword") and automaton.find(b" of") is not None
        assert automaton.find(b" once") is None and automaton.find(b"zebraword") is None
