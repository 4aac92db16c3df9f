"""Language identification by a linear-chain conditional random field over words.

Every word of a line gets a language label; runs of more than ``LONGEST`` bytes,
as in scripts without spaces, are words of that length at most.  A word's features are its
identity (lexicon), its first and last bytes (affixes) and all its byte n-grams;
weights are learned together with the transitions between the labels of
neighbouring words, so a switch of language within a text costs something but
is possible.  Forward-backward gives each word's label probabilities; a
document's prediction is the label with the largest mean probability over its
words with letters, and that mean is the score.

A sequence is a line, in pieces of ``PIECE`` words if it is longer; whole texts
are labelled.  The field is fitted on at most ``SAMPLE_PIECES`` pieces of
the labelled documents outside the held-out fold (those with the smallest hash,
of each language alike, drawn in one scan), on the driver; this bound is a parameter of ``learn``.
Every language that a labelled document names is learned.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
null languages teach nothing; without any labelled line every text is ``und``;
repeated ids are predicted row by row; an empty table gives no rows; texts and
lines of any length are labelled whole; of languages with equal means the first in order of
their names is predicted.  ``identify`` reads doc_id, text and lang only, ``accepted`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
FOLDS = 5
#: Bound of the sample that the field is fitted on, in pieces of at most PIECE words over all languages.
SAMPLE_PIECES = 3000
#: Longest sequence in words.
PIECE = 64
#: Longest word in bytes (whole characters); longer runs are cut.
LONGEST = 36
#: Feature weights live in so many hashed buckets.
BUCKETS = 1 << 18
ROUNDS = 40
_LETTER = regex.compile(r"\p{L}")
_NEWLINE = 10


@dataclass(frozen=True)
class Field:
    """Labels, feature weights [BUCKETS, labels], log transitions and log starts."""

    labels: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray


class Tokens(tokens.Words):
    """The words of consecutive documents, runs of more than LONGEST bytes cut between characters."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(data, bounds)
        parts = -(-(self.end - self.start) // LONGEST)
        if (parts > 1).any():
            of = np.repeat(np.arange(len(parts)), parts)
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            cut = self.start[of] + part * LONGEST
            for _ in range(3):
                cut -= (data[cut] & 0xC0) == 0x80
            last = part == parts[of] - 1
            self.end = np.where(last, self.end[of], np.append(cut[1:], 0))
            self.start = cut
            self.first = np.searchsorted(self.start, bounds)
            self.count = np.diff(self.first)
            self.doc = np.repeat(np.arange(self.docs), self.count)


def pieces(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(index of the first row, words) of successive whole rows of about CHUNK_BYTES."""
    data, bounds = tokens.buffers(column)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + tokens.CHUNK_BYTES, side="right")) - 1)
        yield at, Tokens(data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at])
        at = to


def word_features(words: tokens.Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the features of the words at ``index``."""
    start, length = words.start[index], words.end[index] - words.start[index]
    data = words.data.astype(_U)
    data += _U(32) * ((data >= 65) & (data <= 90))
    rows = np.arange(len(index))
    parts = [(rows, tokens.mix(words.hash[index] + _U(7)), np.ones(len(index)))]
    for k in (1, 2, 3):
        fits = np.flatnonzero(length >= k)
        first, last = np.zeros(len(fits), _U), np.zeros(len(fits), _U)
        for j in range(k):
            first = first << _U(8) | data[start[fits] + j]
            last = last << _U(8) | data[start[fits] + length[fits] - k + j]
        parts.append((fits, tokens.mix(first + _U((10 + k) << 32)), np.ones(len(fits))))
        parts.append((fits, tokens.mix(last + _U((20 + k) << 32)), np.ones(len(fits))))
    for k in (1, 2, 3):
        n = np.maximum(length - k + 1, 0)
        row = np.repeat(rows, n)
        at = np.repeat(start, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        gram = np.zeros(len(row), _U)
        for j in range(k):
            gram = gram << _U(8) | data[at + j]
        parts.append((row, tokens.mix(gram + _U((30 + k) << 32)), 2.0 / np.maximum(n, 1)[row]))
    row, key, value = (np.concatenate(x) for x in zip(*parts))
    return row, (key >> _U(64 - 18)).astype(np.int64), value


def sequences(words: tokens.Words) -> np.ndarray:
    """First word of every sequence: a new document, a new line, or PIECE words after the last start."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(words.data == _NEWLINE)])
    new = np.ones(n, bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | (lines[words.start[1:]] != lines[words.start[:-1]])
    head = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    return np.flatnonzero(within % PIECE == 0)


def forward_backward(emission: np.ndarray, heads: np.ndarray, field_moves: np.ndarray, field_starts: np.ndarray, pairs: bool = False):
    """Label probabilities of every word, the log-likelihood normaliser of each sequence and, if asked, expected moves.

    Sequences are worked on together, longest first, one position at a time;
    forward values are normalised at each step.
    """
    total, labels = emission.shape
    length = np.diff(np.append(heads, total))
    order = np.argsort(-length, kind="stable")
    head, length = heads[order], length[order]
    peak = emission.max(axis=1, keepdims=True) if total else emission
    e = np.exp(emission - peak)
    move, start = np.exp(field_moves), np.exp(field_starts)
    alpha, scale = np.empty_like(e), np.empty(total)
    deepest = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(deepest + 1)]  # sequences longer than t
    for t in range(deepest):
        at = head[:active[t]] + t
        a = e[at] * (start if t == 0 else alpha[at - 1] @ move)
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    beta, expected = np.ones_like(e), np.zeros((labels, labels))
    for t in range(deepest - 2, -1, -1):
        at = head[:active[t + 1]] + t
        after = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        if pairs:
            expected += (alpha[at].T @ after) * move
        beta[at] = after @ move.T
    probability = alpha * beta
    return probability, float((np.log(scale) + peak[:, 0]).sum()) if total else 0.0, expected


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Field:
    """Maximum-likelihood field (Adam, light L2) of lines labelled with one language each."""
    labels = tuple(sorted(set(langs)))
    k = len(labels)
    weights, moves, starts = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    data, bounds = tokens.buffers(pa.array(texts, pa.string()))
    words = Tokens(data, bounds)
    if not len(words.start):
        return Field(labels, weights.astype(np.float32), moves, starts)
    gold = np.array([labels.index(x) for x in langs])[words.doc]
    heads = sequences(words)
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    row, bucket, value = word_features(words, first)
    used, slot = np.unique(bucket, return_inverse=True)
    w = np.zeros((len(used), k))
    inner = np.ones(len(gold), bool)
    inner[heads] = False
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    seen_starts = np.bincount(gold[heads], minlength=k)
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves, starts)]
    n = len(gold)
    for step in range(1, rounds + 1):
        per_word = np.stack([np.bincount(row, value * w[slot, c], len(first)) for c in range(k)], axis=1)
        p, _, expected = forward_backward(per_word[inverse], heads, moves, starts, pairs=True)
        p_starts = p[heads].sum(axis=0)
        p[np.arange(n), gold] -= 1
        by_word = np.stack([np.bincount(inverse, p[:, c], len(first)) for c in range(k)], axis=1)
        g = np.stack([np.bincount(slot, value * by_word[row, c], len(used)) for c in range(k)], axis=1)
        grads = (g / n + 1e-6 * w, (expected - seen_moves) / n + 1e-3 * moves, (p_starts - seen_starts) / len(heads) + 1e-3 * starts)
        for x, gradient, (m, v) in zip((w, moves, starts), grads, moment):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = w
    return Field(labels, weights.astype(np.float32), moves, starts)


def learn(docs: DataFrame, sample: int = SAMPLE_PIECES) -> Field:
    """Fit on a bounded sample of pieces of the lines of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold_of("doc_id", FOLDS) != 0))
    langs = [r.lang for r in known.groupBy("lang").count().collect()]
    if not langs:
        return Field((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    lines = known.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        "lang", "doc_id", "at", F.regexp_extract_all("line", F.lit(rf"\S{{1,{LONGEST}}}"), F.lit(0)).alias("words")).where("size(words) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE).cast("int")),
                      lambda k: F.array_join(F.slice("words", k * PIECE + 1, F.lit(PIECE)), " "))
    pieces_ = lines.select("lang", "doc_id", "at", F.posexplode(cut).alias("part", "piece")).select(
        "lang", "piece", F.xxhash64("doc_id", "at", "part", "piece").alias("h"))
    # each task and each of 64 parts of a language keeps so many pieces before the next shuffle
    bound = max(1, sample // len(langs))
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "piece"))).where(F.col("nth") <= bound)
    taken = first(first(pieces_.withColumn("part", F.pmod("h", F.lit(64))), "part"))
    rows = taken.select("lang", "piece").collect()
    rows.sort(key=lambda r: (r.lang, r.piece))
    return fit([r.piece for r in rows], [r.lang for r in rows])


def label_words(words: tokens.Words, field: Field) -> np.ndarray:
    """Label probabilities of every word."""
    k = len(field.labels)
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    row, bucket, value = word_features(words, first)
    weight = field.weights[bucket]
    per_word = np.stack([np.bincount(row, value * weight[:, c], len(first)) for c in range(k)], axis=1)
    return forward_backward(per_word[inverse], sequences(words), field.moves, field.starts)[0]


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        field = shared.value
        for batch in batches:
            letters = np.array([bool(t) and _LETTER.search(t) is not None for t in batch.column(1).to_pylist()], bool)
            langs, scores, switches = [], [], []
            for at, words in pieces(batch.column(1)):
                if not len(words.start) or not field.labels:
                    langs += ["und"] * words.docs
                    scores += [0.0] * words.docs
                    switches += [0] * words.docs
                    continue
                p = label_words(words, field)
                alphabetic = np.zeros(256, bool)
                alphabetic[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True
                inside = np.concatenate([[0], np.cumsum(alphabetic[words.data])])
                worded = inside[words.end] > inside[words.start]
                mass = np.stack([np.bincount(words.doc, p[:, c] * worded, words.docs) for c in range(p.shape[1])], axis=1)
                count = np.bincount(words.doc, worded, words.docs)
                plain = np.stack([np.bincount(words.doc, p[:, c], words.docs) for c in range(p.shape[1])], axis=1)
                mean = np.where((count > 0)[:, None], mass, plain) / np.maximum(np.where(count > 0, count, words.count), 1)[:, None]
                best = p.argmax(axis=1)
                same = np.ones(len(best), bool)
                same[1:] = (best[1:] == best[:-1]) | (words.doc[1:] != words.doc[:-1])
                changed = np.bincount(words.doc, ~same, words.docs).astype(int)
                for d in range(words.docs):
                    ok = letters[at + d] and words.count[d]
                    top = int(mean[d].argmax())
                    langs.append(field.labels[top] if ok else "und")
                    scores.append(float(min(max(mean[d, top], 0.0), 1.0)) if ok else 0.0)
                    switches.append(int(changed[d]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())],
                                             names=["doc_id", "lang_pred", "score", "n_switches"])
    return run


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, lang_pred, score, n_switches) of ``docs(doc_id, text)``; n_switches counts label changes between words."""
    spark = docs.sparkSession
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _predict(spark.sparkContext.broadcast(field)), "doc_id long, lang_pred string, score double, n_switches long")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_switches) of each document of ``docs(doc_id, text, lang)``."""
    common.prepare(docs.sparkSession)
    field = learn(docs.select("doc_id", "text", "lang"))
    return predict(docs, field).select(
        "doc_id", (common.fold_of("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score", "n_switches")


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a predicted language with a score of at least ``least``; all columns stay."""
    common.prepare(docs.sparkSession)
    field = learn(docs.select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches):
        for batch in batches:
            probe = pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("text"))], names=["doc_id", "text"])
            for got in _predict(shared)(iter([probe])):
                keep = [lang != "und" and score >= least for lang, score in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
