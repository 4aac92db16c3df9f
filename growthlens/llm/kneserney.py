"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Tokens are lower-cased words plus one end per text; the context of the first
token is a start mark.  With raw bigram counts c, and t(w) the number of
different contexts of w,

    P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) P1(w)
    P1(w)    = max(t(w) - d(t(w)), 0) / T + g1 / (V + 1)

where D and d are the modified discounts for counts 1, 2 and 3 or more, and g
gives the discounted mass back.  An unseen context leaves P1; an unseen word
has P1 = g1 / (V + 1), so the probabilities of all words and one unknown sum
to 1.

Counting: each task sorts and counts the bigrams of its texts and packs them
by a hash bucket of the context; a bucket holds whole contexts, is merged on
its own, and is written as two sorted arrays (pair hash, count) to the shared
folder.  Buckets grow in number with the text, and a frequent bigram arrives
as one entry for each task.  A second, smaller exchange gives each word its
raw count, follower counts and number of contexts, written the same way.
Workers map these files and look up whole batches by binary search; nothing of
the model passes through the driver but the counts of counts.

The files lie in ``spark.checkpoint.dir``.  Where that is a mounted path (local,
NFS) workers map them in place; for another store they first copy the files
they need to a private temporary file.

Defined cases: null and empty texts are one end token; null ids belong to the
training part as the empty id does; repeated rows count and score row by row;
if nothing is trained, each probability is that of an unknown word, 1; an empty
table gives no rows; texts of any length count and score whole; other columns are not read, whatever their names.
A task that is lost while it writes leaves a hidden part file, which nothing reads.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
FOLDS, HELD_OUT = 7, 2
START, END = _U(0x5354415254), _U(0x454E44)
#: Bytes of text for each bucket, and the least number of buckets (powers of two).
BUCKET_BYTES, MIN_BUCKETS = 32 << 20, 256
#: Bigrams that a task sorts at once.
FLUSH = 1_500_000
#: Stored arrays that a worker keeps mapped.
OPEN_MAPS = 4096
_WORD = np.dtype([("word", "<u8"), ("count", "<u8"), ("contexts", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_FIGURES = np.dtype([("word", "<u8"), ("count", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_MET = np.dtype([("word", "<u8"), ("contexts", "<u4")])


def sequences(words: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, document, is end) of every token, ends included."""
    n, docs = len(words.start), words.docs
    place = np.arange(n) + words.doc
    ends = words.first[1:] + np.arange(docs)
    token, context = np.empty(n + docs, _U), np.empty(n + docs, _U)
    token[place], token[ends] = words.hash, END
    context[1:] = token[:-1]
    context[words.first[:-1] + np.arange(docs)] = START
    is_end = np.zeros(n + docs, bool)
    is_end[ends] = True
    return context, token, np.repeat(np.arange(docs), words.count + 1), is_end


def bucket_of(context: np.ndarray, bits: int) -> np.ndarray:
    return (tokens.mix(context + _U(3)) >> _U(64 - bits)).astype(np.int64)


def pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tokens.combine([context, token])


def _sum_equal(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sort by ``keys`` (first is major) and sum ``values`` of equal keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cut = np.flatnonzero(new)
    return [k[cut] for k in keys], [np.add.reduceat(v[order], cut) if len(cut) else v[:0] for v in values]


_PACKED = "bucket long, context binary, size binary, token binary, n binary"


def _pack(context: np.ndarray, token: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each bucket; entries sorted by (bucket, context, token), contexts written once."""
    bucket = bucket_of(context, bits)
    order = np.lexsort((token, context, bucket))
    context, token, n, bucket = context[order], token[order], n[order], bucket[order]
    head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(np.append(head, len(context)))
    names, at = np.unique(bucket, return_index=True)
    edge = np.append(at, len(bucket))
    head_edge = np.searchsorted(head, edge)
    cut = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(names), cut(context[head], head_edge), cut(size.astype("<u4"), head_edge), cut(token, edge), cut(n.astype("<u4"), edge),
    ], names=["bucket", "context", "size", "token", "n"])


def _count(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        held, size = [], 0

        def out():
            (c, t), (n,) = _sum_equal([np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])],
                                      [np.concatenate([x[2] for x in held])])
            return _pack(c, t, n, bits)
        for batch in batches:
            for _, words in tokens.pieces(batch.column(0)):
                context, token, _, _ = sequences(words)
                (c, t), (n,) = _sum_equal([context, token], [np.ones(len(token), np.int64)])
                held.append((c, t, n))
                size += len(c)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
    return run


def _local(path: str) -> str | None:
    """The path of a file URI or plain path; None for other stores."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(path: str, data: bytes) -> None:
    """Write a file whole or not at all; a repeated task writes the same bytes again."""
    local = _local(path)
    if local:
        system, local = fs.LocalFileSystem(), local
    else:
        system, local = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(local), recursive=True)
    # no pattern that names finished files matches the part
    part = f"{os.path.dirname(local)}/.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, local)


def _map(path: str, kind) -> np.ndarray:
    """A stored array, memory-mapped."""
    local = _local(path)
    if local:
        return np.memmap(local, kind, "r") if os.path.getsize(local) else np.zeros(0, kind)
    system, remote = fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(remote) as source:
        while block := source.read(1 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r") if copy.tell() else np.zeros(0, kind)


def _merge(folder: str, bits: int) -> Callable[[pa.Table], pa.Table]:
    """Merge one bucket: store its pairs, return its contexts' figures, its words' context counts, and counts of counts."""
    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        bucket = table.column("bucket")[0].as_py()
        context = np.concatenate([np.repeat(c, s) for c, s in zip(read("context", "<u8"), read("size", "<u4"))])
        token, n = np.concatenate(read("token", "<u8")), np.concatenate(read("n", "<u4")).astype(np.int64)
        (context, token), (n,) = _sum_equal([context, token], [n])
        key = pair_hash(context, token)
        order = np.argsort(key)
        _store(f"{folder}/pairs-{bucket:08d}", key[order].tobytes())
        wide = 2 if n.max() < 2**16 else 4
        _store(f"{folder}/counts{wide}-{bucket:08d}", np.minimum(n[order], 2**32 - 1).astype(f"<u{wide}").tobytes())
        names, at = np.unique(context, return_index=True)
        figures = np.zeros(len(names), _FIGURES)
        figures["word"] = names
        for column, value in (("count", n), ("n1", n == 1), ("n2", n == 2), ("n3", n >= 3)):
            figures[column] = np.add.reduceat(value.astype(np.int64), at)
        words, contexts = np.unique(token, return_counts=True)
        met = np.zeros(len(words), _MET)
        met["word"], met["contexts"] = words, contexts
        seen = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [n.sum(), len(n)], np.int64)
        _store(f"{folder}/seen-{bucket:08d}", seen.tobytes())
        parts = [_by_home(rows, bits) for rows in (figures, met)]
        homes = sorted({*parts[0], *parts[1]})
        return pa.table({"bucket": pa.array(homes, pa.int64()), "figures": pa.array([parts[0].get(h, b"") for h in homes], pa.binary()),
                         "met": pa.array([parts[1].get(h, b"") for h in homes], pa.binary())})
    return run


def _by_home(rows: np.ndarray, bits: int) -> dict[int, bytes]:
    """The rows of each word's own bucket."""
    home = bucket_of(rows["word"], bits)
    order = np.argsort(home, kind="stable")
    rows, home = rows[order], home[order]
    names, at = np.unique(home, return_index=True)
    return {int(h): rows[a:b].tobytes() for h, a, b in zip(names, at, np.append(at[1:], len(rows)))}


def _merge_words(folder: str) -> Callable[[pa.Table], pa.Table]:
    """Store the words of one bucket; return counts of context counts, contexts in all, and words."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        figures, met = read("figures", _FIGURES), read("met", _MET)
        (seen_word,), (contexts,) = _sum_equal([met["word"]], [met["contexts"].astype(np.int64)])
        out = np.zeros(len(np.union1d(figures["word"], seen_word)), _WORD)
        out["word"] = np.union1d(figures["word"], seen_word)
        # a context lies whole in one bucket, so its figures come once
        place = np.searchsorted(out["word"], figures["word"])
        for c in ("count", "n1", "n2", "n3"):
            out[c][place] = figures[c]
        out["contexts"][np.searchsorted(out["word"], seen_word)] = contexts
        _store(f"{folder}/words-{bucket:08d}", out.tobytes())
        t = out["contexts"][out["word"] != START].astype(np.int64)
        seen = np.array([(t == k).sum() for k in (1, 2, 3, 4)] + [t.sum(), (t > 0).sum(), (t == 1).sum(), (t == 2).sum(), (t >= 3).sum()], np.int64)
        return pa.table({"bucket": pa.array([bucket]), "data": pa.array([seen.tobytes()], pa.binary())})
    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, kept between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw)])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few figures that are global."""

    folder: str
    bits: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    contexts: int
    words: int
    tokens: int
    texts: int
    back_off: float
    _open: dict = field(default_factory=dict, compare=False, repr=False)

    def _array(self, kind: str, bucket: int, dtype) -> np.ndarray:
        key = kind, bucket
        if key not in self._open:
            # the map used longest ago is closed, as a process may hold a limited number
            while len(self._open) >= OPEN_MAPS:
                self._open.pop(next(iter(self._open)))
            try:
                self._open[key] = _map(f"{self.folder}/{kind}-{bucket:08d}", dtype)
            except FileNotFoundError:
                self._open[key] = np.zeros(0, dtype)  # a bucket without entries
        else:
            self._open[key] = self._open.pop(key)
        return self._open[key]

    def _by_bucket(self, bucket: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            yield int(bucket[order[a]]), order[a:b]

    def look_up_words(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), _WORD)
        for bucket, rows in self._by_bucket(bucket_of(word, self.bits)):
            table = self._array("words", bucket, _WORD)
            if len(table):
                keys = table["word"]
                at = np.minimum(np.searchsorted(keys, word[rows]), len(keys) - 1)
                hit = keys[at] == word[rows]
                out[rows[hit]] = table[at[hit]]
        return out

    def look_up_pairs(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        key, out = pair_hash(context, token), np.zeros(len(token), np.int64)
        for bucket, rows in self._by_bucket(bucket_of(context, self.bits)):
            keys = self._array("pairs", bucket, "<u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key[rows]), len(keys) - 1)
                hit = keys[at] == key[rows]
                counts = self._array("counts2", bucket, "<u2")
                counts = counts if len(counts) else self._array("counts4", bucket, "<u4")
                out[rows[hit]] = counts[at[hit]]
        return out

    def score(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token after its context."""
        (names, inverse) = np.unique(np.concatenate([token, context]), return_inverse=True)
        found = self.look_up_words(names)
        here, before = found[inverse[:len(token)]], found[inverse[len(token):]]
        pair, pair_at = np.unique(pair_hash(context, token), return_index=True)
        count = self.look_up_pairs(context[pair_at], token[pair_at])[np.searchsorted(pair, pair_hash(context, token))]
        d, e = self.pair_discounts, self.word_discounts
        t = here["contexts"].astype(np.int64)
        p = (t - e[np.minimum(t, 3)]) / max(self.contexts, 1) + self.back_off / (self.words + 1)
        total = before["count"].astype(float)
        known = total > 0
        given = d[1] * before["n1"] + d[2] * before["n2"] + d[3] * before["n3"]
        safe = np.where(known, total, 1)
        p = np.where(known, (count - d[np.minimum(count, 3)]) / safe + given / safe * p, p)
        raw = here["count"].astype(np.int64)
        return np.log10(p), np.where(token == END, self.texts, raw)


def train(texts: DataFrame) -> Model:
    """Count ``texts(text)`` and leave the model's arrays in the shared folder."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(MIN_BUCKETS.bit_length() - 1, int(np.ceil(np.log2(max(size / BUCKET_BYTES, 1)))))
    folder = f"{common.shared_dir(spark)}/kneserney-{uuid.uuid4().hex}"
    packed = texts.select("text").mapInArrow(_count(bits), _PACKED)
    merged = packed.groupBy("bucket").applyInArrow(_merge(folder, bits), "bucket long, figures binary, met binary")
    words = common.settle(merged.groupBy("bucket").applyInArrow(_merge_words(folder), "bucket long, data binary"))
    # one short row of counts of counts for each bucket reaches the driver
    sums = lambda rows, n: sum((np.frombuffer(r["data"], np.int64) for r in rows), np.zeros(n, np.int64)).astype(float)
    w = sums(words.toLocalIterator(), 9)
    if not len(words.head(1)):
        pairs = np.zeros(6)
    else:
        pairs = sums(spark.read.format("binaryFile").load(f"{folder}/seen-" + "[0-9]" * 8).select(F.col("content").alias("data")).toLocalIterator(), 6)
    e = discounts(*w[:4])
    contexts = int(w[4])
    back_off = float((e[1] * w[6] + e[2] * w[7] + e[3] * w[8]) / contexts) if contexts else 1.0
    start = Model(folder, bits, discounts(*pairs[:4]), e, contexts, int(w[5]), int(pairs[4]), 0, back_off)
    n_texts = int(texts.count())
    return Model(**{**{k: v for k, v in start.__dict__.items() if k != "_open"}, "texts": n_texts})


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        told = shared.value
        model = Model(**{k: v for k, v in told.__dict__.items() if k != "_open"})
        floor = np.log10(model.tokens + model.words + 1)
        for batch in batches:
            n, known, base, score = [], [], [], []
            for _, words in tokens.pieces(batch.column(1)):
                context, token, doc, _ = sequences(words)
                p, count = model.score(context, token)
                n.append(np.bincount(doc, minlength=words.docs))
                known.append(np.bincount(doc, count > 0, words.docs))
                base.append(np.bincount(doc, np.log10(count + 1) - floor, words.docs))
                score.append(np.bincount(doc, p, words.docs))
            flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), flat(n, np.int64), flat(known, np.int64), pa.array(np.full(batch.num_rows, model.tokens, np.int64)),
                flat(base, float), flat(score, float)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def held_out() -> Column:
    return common.fold_of("doc_id", FOLDS) == HELD_OUT


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document of ``docs(doc_id, text)``.

    ``score`` is the text's log10 probability, so perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(texts.where(~held_out()))
    scored = texts.mapInArrow(_score(spark.sparkContext.broadcast(model)),
                              "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
