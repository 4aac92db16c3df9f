"""Toxic passages by maximum-scoring segments of token log-odds.

Method: the numbers of toxic and clean training documents that hold a token
(different texts, each once) give it a log-odds score, smoothed by a Dirichlet prior that spreads the counts of the
token's four-byte stem over the stem's tokens; tokens and stems without
significant odds share one background score, which is negative.  A linear scan
finds every maximal segment of the scores (Ruzzo and Tompa); a segment's score
S in n tokens has expectation K n exp(-lambda S) among clean texts, and those
under ``SIGNIFICANT`` are toxic passages.  A document's statistic is the summed
surprise of its significant segments, or of its best one; a logistic curve fitted to the training
documents turns it into a score from 0 to 1.

Labels are read only of documents outside the held-out fold, and only here.

Defined cases: null and empty texts have no tokens and score as texts without
any toxic segment; null labels teach nothing; documents that repeat an id are
scored row by row; without both label values the score is 0 everywhere; an
empty table gives no rows; texts of any length are scanned whole; other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common, tokens

_U = np.uint64
FOLDS = 5
#: Pseudo-tokens in all, and the share of a stem's count per token that its tokens get as their prior.
PRIOR, SPREAD = 2.0, 0.1
#: A token or stem enters the model if its log-odds are this many standard errors from zero and it is in two toxic texts or more,
#: whatever the size of the table.
MIN_Z, MIN_TEXTS = 3.0, 2
#: Bound of the labelled texts that are learned from, of each label (on average): those whose hash falls in the share.
TRAIN_TEXTS = 400_000
#: Expected number of chance segments below which a segment counts.
SIGNIFICANT = 0.05
#: Width of the bins in which training documents are counted for the logistic fit.
BIN = 0.05


@dataclass(frozen=True)
class Model:
    """Sorted token and stem hashes with their scores, the background score and the calibration."""

    token: np.ndarray
    token_score: np.ndarray
    stem: np.ndarray
    stem_score: np.ndarray
    background: float
    decay: float = 1.0
    scale: float = 0.05
    bias: float = -30.0
    slope: float = 0.0


def stems(words: tokens.Words) -> np.ndarray:
    """Hash of each token's first four bytes; 0 for tokens of fewer than five."""
    length = words.end - words.start
    long = length >= 5
    value = np.zeros(len(length), _U)
    at = words.start[long]
    for k in range(4):
        byte = words.data[at + k].astype(_U)
        byte += _U(32) * ((byte >= 65) & (byte <= 90))
        value[long] = value[long] << _U(8) | byte
    value[long] = tokens.mix(value[long] + _U(1)) | _U(1)
    return value


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents per (token, stem); a token counts once for each document."""
    for batch in batches:
        label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        got = []
        for at, words in tokens.pieces(batch.column(0), space=tokens.PUNCTUATION):
            order = np.lexsort((words.doc, words.hash))
            again = np.zeros(len(order), bool)
            again[1:] = (words.hash[order][1:] == words.hash[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])
            order = order[~again]
            h = words.hash[order]
            if not len(h):
                continue
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            toxic = label[at + words.doc[order]]
            n1 = np.add.reduceat(toxic, cut)
            n = np.diff(np.append(cut, len(h)))
            got.append((h[cut], stems(words)[order][cut], n1, n - n1))
        if got:
            h, s, n1, n0 = (np.concatenate(x) for x in zip(*got))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(n1), pa.array(n0)],
                                             names=["token", "stem", "n1", "n0"])


def _odds(n1: np.ndarray, n0: np.ndarray, a1: np.ndarray, a0: np.ndarray, total1: float, total0: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds under Dirichlet priors a1 and a0, and their z-scores."""
    a1, a0 = np.clip(a1, 0.05, 0.5), np.clip(a0, 0.05, 0.5)
    p1, p0 = (n1 + a1) / (total1 + PRIOR), (n0 + a0) / (total0 + PRIOR)
    score = np.log(p1) - np.log(p0)
    return score, score / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def _z_column(n1: Column, n0: Column, a1: Column, a0: Column, total1: float, total0: float) -> Column:
    """The z-score of ``_odds`` as a column."""
    a1, a0 = (F.least(F.greatest(a, F.lit(0.05)), F.lit(0.5)) for a in (a1, a0))
    score = F.log((n1 + a1) / (total1 + PRIOR)) - F.log((n0 + a0) / (total0 + PRIOR))
    return score / F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal scoring segment, by one left-to-right scan (Ruzzo and Tompa)."""
    stack: list[list] = []  # start, end, sum before it, sum through it
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        if s <= 0:
            total += s
            continue
        piece = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= piece[2]:
                j -= 1
            if j < 0 or stack[j][3] >= piece[3]:
                stack.append(piece)
                break
            piece = [stack[j][0], piece[1], stack[j][2], piece[3]]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def token_scores(words: tokens.Words, model: Model) -> np.ndarray:
    """Score of every token: its own, else its stem's, else the background."""
    out = np.full(len(words.start), model.background)
    for keys, table, value in ((stems(words), model.stem, model.stem_score), (words.hash, model.token, model.token_score)):
        if len(table):
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            found = table[at] == keys
            out[found] = value[at[found]]
    return out


def passages(words: tokens.Words, model: Model) -> list[list[tuple[int, int, float]]]:
    """Per document its maximal segments (first token, end, surprise).

    Surprise is -log of the extreme-value chance 1 - exp(-K n exp(-lambda S)) of a segment that good in n clean tokens.
    """
    scores = token_scores(words, model)
    found = []
    positive = np.add.reduceat(np.append(scores > 0, False).astype(int), np.minimum(words.first[:-1], len(scores))) if words.docs else []
    for d in range(words.docs):
        n = int(words.count[d])
        if not n or not positive[d]:
            found.append([])
            continue
        chance = np.log(model.scale * n)
        best = maximal_segments(scores[words.first[d]: words.first[d] + n])
        expected = np.exp(chance - model.decay * np.array([s for *_, s in best]))
        # for tiny expectations the chance is the expectation itself
        surprise = np.where(expected < 1e-9, model.decay * np.array([s for *_, s in best]) - chance, -np.log(-np.expm1(-np.maximum(expected, 1e-9))))
        found.append([(a, b, float(x)) for (a, b, _), x in zip(best, surprise)])
    return found


def statistic(segments: list[tuple[int, int, float]]) -> float:
    """Summed surprise of the significant segments, else of the best one, else 0; as its arsinh."""
    strong = [x for _, _, x in segments if x > -np.log(SIGNIFICANT)]
    return float(np.arcsinh(sum(strong) if strong else max((x for _, _, x in segments), default=0.0)))


def _statistics(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of training documents by (bin of the statistic, label)."""
    def run(batches):
        model = shared.value
        for batch in batches:
            label, bins, best, size = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64), [], [], []
            for _, words in tokens.pieces(batch.column(0), space=tokens.PUNCTUATION):
                for d, segments in enumerate(passages(words, model)):
                    n = int(words.count[d])
                    bins.append(int(np.floor(statistic(segments) / BIN)))
                    best.append(int(bool(segments)))
                    size.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(label, pa.int32()), pa.array(best, pa.int64()), pa.array(size, pa.int64())],
                                             names=["bin", "label", "hits", "tokens"])
    return run


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        model = shared.value
        for batch in batches:
            score, count, spans = [], [], []
            for _, words in tokens.pieces(batch.column(1), space=tokens.PUNCTUATION):
                for d, segments in enumerate(passages(words, model)):
                    x = statistic(segments)
                    score.append(float(1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -500, 500)))))
                    strong = [(a, b) for a, b, s in segments if s > -np.log(SIGNIFICANT)]
                    count.append(len(strong))
                    spans.append([{"first": a, "end": b} for a, b in strong])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "score", "n_passages", "passages"])
    return run


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(bias, slope) of a logistic curve on binned counts: Newton steps, halved until the loss falls, with a light ridge."""
    n = positive + negative
    mean = (n * x).sum() / n.sum()
    spread = np.sqrt((n * (x - mean) ** 2).sum() / n.sum()) or 1.0
    z, w = np.stack([np.ones(len(x)), (x - mean) / spread], axis=1), np.zeros(2)

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((n * np.logaddexp(0, t) - positive * t).sum() + 0.005 * (w @ w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (n * p - positive) + 0.01 * w
        hessian = (z * (n * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0] - w[1] * mean / spread), float(w[1] / spread)


def learn(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Model of the labelled documents outside the held-out fold; ``docs(doc_id, text)``, ``labels(doc_id, toxic)``.

    About ``train_texts`` different texts of each label are learned from at most.
    """
    spark = docs.sparkSession
    known = common.settle(
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.fold_of("doc_id", FOLDS) != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    # one document of each text: copies of one text are no further evidence
    marked = docs.select("doc_id", F.xxhash64("text").alias("h")).join(common.small(known), "doc_id")
    known = common.settle(marked.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")))
    share = {r["toxic"]: min(1.0, train_texts / r["count"]) for r in known.groupBy("toxic").count().collect()}
    drawn = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, int(share.get(1, 1) * (1 << 30))).otherwise(int(share.get(0, 1) * (1 << 30)))
    known = common.settle(known.where(drawn).select("doc_id", "toxic"))
    train = docs.join(common.small(known), "doc_id").select("text", "toxic")
    counts = common.settle(train.mapInArrow(_count, "token long, stem long, n1 long, n0 long")
                           .groupBy("token", "stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    total1, total0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    nothing = Model(np.zeros(0, _U), np.zeros(0), np.zeros(0, _U), np.zeros(0), -0.01)
    if not total1 or not total0:
        return nothing
    # what passes these filters is bounded by the texts learned from
    often = F.col("n1") >= MIN_TEXTS
    by_stem = common.settle(counts.where("stem <> 0").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("size")))
    zero = F.lit(0.0)
    rows = by_stem.where(often & (_z_column(F.col("n1"), F.col("n0"), zero, zero, total1, total0) > MIN_Z)).toPandas()
    n1, n0 = rows["n1"].to_numpy(float), rows["n0"].to_numpy(float)
    none = np.zeros(len(rows))
    s_score, z = _odds(n1, n0, none, none, total1, total0)
    keep = (z > MIN_Z) & (s_score > 0)
    stem, s_score = rows["stem"].to_numpy(np.int64).view(_U)[keep], s_score[keep]
    prior = lambda c: SPREAD * F.coalesce(c, F.lit(0)) / F.coalesce("size", F.lit(1))
    words = (counts.where(often).join(by_stem.select("stem", F.col("n1").alias("s1"), F.col("n0").alias("s0"), "size"), "stem", "left")
             .where(F.abs(_z_column(F.col("n1"), F.col("n0"), prior(F.col("s1")), prior(F.col("s0")), total1, total0)) > MIN_Z).toPandas())
    t1, t0 = words["n1"].to_numpy(float), words["n0"].to_numpy(float)
    size = words["size"].fillna(1).to_numpy(float)
    a1 = SPREAD * words["s1"].fillna(0).to_numpy(float) / size
    a0 = SPREAD * words["s0"].fillna(0).to_numpy(float) / size
    t_score, z = _odds(t1, t0, a1, a0, total1, total0)
    pick = np.abs(z) > MIN_Z
    token, t_score, t1, t0 = words["token"].to_numpy(np.int64).view(_U)[pick], t_score[pick], t1[pick], t0[pick]
    up = t_score > 0
    # what is left over shares one score
    rest1, rest0 = max(total1 - t1[up].sum(), 1), max(total0 - t0[up].sum(), 1)
    background = min(float(np.log(rest1 / total1) - np.log(rest0 / total0)), -0.005)
    t_score = np.where(up, t_score, np.minimum(t_score, background))
    # lambda: the positive root of E[exp(lambda S)] = 1 over clean tokens
    share = np.append(t0 + 0.5, rest0) / (total0 + 1)
    values = np.append(t_score, background)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (share * np.exp(mid * values)).sum() > 1 else (mid, hi)
    t_order, s_order = np.argsort(token), np.argsort(stem)
    model = Model(token[t_order], t_score[t_order], stem[s_order], s_score[s_order], background, decay=min(max(hi, 0.2), 1.5))
    binned = train.mapInArrow(_statistics(spark.sparkContext.broadcast(model)), "bin int, label int, hits long, tokens long")
    table = binned.groupBy("bin", "label").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens")).toPandas()
    clean = table[table["label"] == 0]
    # K: chance segments per clean token at the smallest score of the model
    floor = float(t_score[t_score > 0].min()) if (t_score > 0).any() else 1.0
    scale = (clean["hits"].sum() + 0.5) / (max(float(clean["tokens"].sum()), 1.0) * np.exp(-model.decay * floor))
    model = Model(**{**model.__dict__, "scale": float(min(max(scale, 1e-6), 1.0))})
    binned = train.mapInArrow(_statistics(spark.sparkContext.broadcast(model)), "bin int, label int, hits long, tokens long")
    table = binned.groupBy("bin", "label").agg(F.count("*").alias("n")).toPandas()
    bins, at = np.unique(table["bin"].to_numpy(), return_inverse=True)
    n, label = table["n"].to_numpy(float), table["label"].to_numpy()
    bias, slope = logistic((bins + 0.5) * BIN, np.bincount(at, n * (label == 1), len(bins)), np.bincount(at, n * (label == 0), len(bins)))
    return Model(**{**model.__dict__, "bias": bias, "slope": slope})


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of each document; passages are token ranges."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    scored = texts.mapInArrow(_score(spark.sparkContext.broadcast(model)),
                              "doc_id long, score double, n_passages long, passages array<struct<first:long,end:long>>")
    return scored.select("doc_id", (common.fold_of("doc_id", FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")
