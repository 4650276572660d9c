"""Toxic passages by maximum-scoring segments over token log-odds.

Fitting.  Words are counted, once a text, in a bounded sample of labelled documents, by
class, and over all documents; the corpus counts are the informative
Dirichlet prior (its weight is ``PRIOR_WORDS`` words).  A word enters the
lexicon if as many toxic texts among those that hold it are as unlikely, by
the exact binomial tail at the toxic share of all words, as ``Z_MIN``
standard deviations; the test holds for words never seen in clean text.  It
scores its log-odds, if that is above zero; all other words share one score,
the log-odds of the rest.  Every such word is in the lexicon, whose size is
bounded by the sample: a word must be in several of its texts.

Scoring.  One linear scan per text finds all maximal-scoring segments.
A segment's score S is calibrated by the extreme-value law of such scans:
the number of chance segments of score S or more in n words has mean
K * n * exp(-lam * S), with lam the positive root of E[exp(lam * score)] = 1
under the corpus' word frequencies and K set so that the untoxic sample has
as many segments as the law predicts above its ``TAIL``-th highest.  The
surprise of a text is the sum of -log of that mean over its significant
segments (mean below ``E_MAX``), or the best segment's if none is, and 0 at
least; a text without segments has none.  A logistic curve, fitted on
the same labelled sample, turns surprise into a score.

Null and empty texts have no words and get the score of no evidence.
Repeated rows are scored alike.  Without labels of both classes every
document scores 0.  Labels enter only through the sample, and the held-out
fold is never in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.labelled import fold, logistic, one_row, squash, training_ids
from legflow.llm.shared import Sent, bitmap_has, cut, extended, hash_bitmap

PARTS, HELD = 5, 0
#: Labelled documents of each class that the fit may read.
SAMPLE = 10_000
PRIOR_WORDS = 10_000.0
Z_MIN = 4.0
E_MAX = 0.05
TAIL = 10


@dataclass
class Model:
    """Sorted word hashes with scores, the score of other words, the law's lam and ln K, the curve."""

    words: np.ndarray
    scores: np.ndarray
    other: float
    lam: float = 1.0
    ln_k: float = 0.0
    slope: float = 0.0
    offset: float = -35.0


def segments(score: np.ndarray, place: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) in linear time.

    ``score`` holds the positive scores at the word places ``place``; every
    other word scores ``other`` <= 0.  The scan keeps candidate segments with
    the running totals before and after each; a new one is merged leftwards
    with the last candidate that began lower, if the total has risen since.
    """
    done: list[list] = []
    total, last = 0.0, -1
    for s, p in zip(score.tolist(), place.tolist()):
        total += other * (p - last - 1)
        seg = [p, p + 1, total, total + s, -1]
        total, last = total + s, p
        while True:
            # the nearest earlier candidate that begins below this one's beginning
            j = len(done) - 1
            while j >= 0 and done[j][2] >= seg[2]:
                j = done[j][4]
            seg[4] = j
            if j < 0 or done[j][3] >= seg[3]:
                done.append(seg)
                break
            seg = [done[j][0], seg[1], done[j][2], seg[3], -1]
            del done[j:]
    return [(a, b, after - before) for a, b, before, after, _ in done]


def surprise(found: list, n: int, lam: float, ln_k: float) -> tuple[float, list]:
    """Calibrated evidence of a text of n words and its significant segments."""
    base = ln_k + math.log(max(n, 1))
    each = [(lam * s - base, a, b) for a, b, s in found]
    strong = [(a, b) for e, a, b in each if e > -math.log(E_MAX)]
    if strong:
        return sum(e for e, _, _ in each if e > -math.log(E_MAX)), strong
    return max([0.0, *(e for e, _, _ in each)]), []


def scan(column, model: Model) -> Iterator[tuple[int, int, list]]:
    """(row, words, maximal segments) of every text of an Arrow column."""
    for row, _, data, offsets in W.pieces(column):
        w = W.split_words(data, offsets, W.plain_words())
        if len(model.words):
            which = np.minimum(np.searchsorted(model.words, w.hash), len(model.words) - 1)
            hit = np.flatnonzero(model.words[which] == w.hash)
        else:
            which = hit = np.zeros(0, np.int64)
        bounds = np.searchsorted(hit, w.at)
        for t in range(len(w.at) - 1):
            h = hit[bounds[t]:bounds[t + 1]]
            found = segments(model.scores[which[h]], h - w.at[t], model.other) if len(h) else []
            yield row + t, int(w.at[t + 1] - w.at[t]), found


def word_counts(docs: DataFrame, wanted=None) -> DataFrame:
    """(word, y, n): texts that hold each word hash, by class column y; with a bitmap, only words that may be in it.

    A text counts a word once, however often it repeats it.  Rows with a null
    word hold the class's sum over all words.
    """
    sent = Sent(docs.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            y = batch.column(1).to_numpy()
            seen: dict[int, list] = {}
            total: dict[int, int] = {}
            for a, b, data, offsets in W.pieces(batch.column(0)):
                w = W.split_words(data, offsets, W.plain_words())
                text = np.repeat(np.arange(a, b), np.diff(w.at))
                order = np.lexsort((w.hash, text))
                h, text = w.hash[order], text[order]
                first = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[:len(h)]
                h, of = h[first], y[text[first]]
                for c, n in zip(*np.unique(of, return_counts=True)):
                    total[int(c)] = total.get(int(c), 0) + int(n)
                if bitmap is not None:
                    may = bitmap_has(bitmap, h.view(np.int64))
                    h, of = h[may], of[may]
                for c in np.unique(of):
                    seen.setdefault(int(c), []).append(h[of == c])
            for c, parts in seen.items():
                word, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), c), pa.int32()),
                                                  pa.array(n, pa.int64())], ["word", "y", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(total), pa.int64()), pa.array(list(total), pa.int32()),
                                              pa.array(list(total.values()), pa.int64())], ["word", "y", "n"])

    return docs.mapInArrow(run, "word bigint, y int, n bigint").groupBy("word", "y").agg(F.sum("n").alias("n"))


def log_tail(t: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """ln P(X >= t) of X binomial in n trials of chance p, for t > n * p (the terms fall from there on)."""
    t, n = np.asarray(t, float), np.asarray(n, float)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    term, k = np.ones(len(t)), t.copy()
    total = term.copy()
    while (term > 1e-12 * total).any():
        term = term * (n - k) / (k + 1) * (p / (1 - p))
        total += term
        k += 1
    return lgamma(n + 1) - lgamma(t + 1) - lgamma(n - t + 1) + t * math.log(p) + (n - t) * math.log1p(-p) + np.log(total)


def toxic_words(counts: DataFrame, base: float) -> DataFrame:
    """(word, clean, toxic) of the words whose toxic count is too large for the toxic share ``base``."""
    limit = math.log(math.erfc(Z_MIN / math.sqrt(2)) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, toxic = (batch.column(i).to_numpy().astype(float) for i in (1, 2))
            over = np.flatnonzero(toxic > (clean + toxic) * base)
            unlikely = log_tail(toxic[over], (clean + toxic)[over], base) <= limit
            yield batch.take(pa.array(over[unlikely]))

    known = counts.filter("word is not null and toxic > 0").select("word", "clean", "toxic")
    return known.mapInArrow(run, known.schema)


def root(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lam with sum(share * exp(lam * scores)) = 1 (the mean score is negative)."""
    low, high = 0.0, 1.0
    while (share * np.exp(np.clip(high * scores, -700, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.clip(mid * scores, -700, 700))).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled sample and the counts of all documents."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    ids = training_ids(labels, "toxic", PARTS, HELD, SAMPLE)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = cut(one_row(text.join(F.broadcast(ids), "doc_id"), ["doc_id", "y"]))
    counts = cut(word_counts(sample).groupBy("word").pivot("y", [0, 1]).agg(F.sum("n")).na.fill(0, ["0", "1"])
                 .select("word", F.col("0").alias("clean"), F.col("1").alias("toxic")))
    size = counts.filter("word is null").head()
    if size is None or not size.clean or not size.toxic:
        return none
    listed = cut(toxic_words(counts, size.toxic / (size.toxic + size.clean)))
    corpus = cut(word_counts(text.select("text", F.lit(0).alias("y")), hash_bitmap(listed, "word")).select("word", F.col("n").alias("prior")))
    total = corpus.filter("word is null").agg(F.sum("prior")).head()[0] or 0
    alpha = F.col("prior") * F.lit(PRIOR_WORDS / max(total, 1))
    rest = F.lit(PRIOR_WORDS)
    t, c = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(t / (F.lit(float(size.toxic)) + rest - t)) - F.log(c / (F.lit(float(size.clean)) + rest - c))
    chosen = listed.join(corpus, "word").withColumn("score", odds).filter("score > 0").toPandas()
    if chosen.empty:
        return none
    chosen["key"] = chosen["word"].to_numpy(np.int64).view(np.uint64)
    chosen = chosen.sort_values("key")
    prior = chosen["prior"].to_numpy(float)
    a = PRIOR_WORDS / total
    in_t, in_c = (chosen[k].to_numpy(float).sum() + prior.sum() * a for k in ("toxic", "clean"))
    other = min(math.log((size.toxic + PRIOR_WORDS - in_t) / (size.toxic + PRIOR_WORDS))
                - math.log((size.clean + PRIOR_WORDS - in_c) / (size.clean + PRIOR_WORDS)), -1e-4)
    # the law's share of each word is that of untoxic text
    share = (chosen["clean"].to_numpy(float) + prior * a) / (size.clean + PRIOR_WORDS)
    scores = chosen["score"].to_numpy(float)
    model = Model(chosen["key"].to_numpy(np.uint64), scores, other)
    model.lam = root(np.append(scores, other), np.append(share, 1 - share.sum()))
    return calibrate(model, sample)


def calibrate(model: Model, sample: DataFrame) -> Model:
    """ln K from the untoxic sample, then the logistic curve; what is collected is a few numbers per sampled row."""
    sent = Sent(sample.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = [(n, [s for _, _, s in found]) for _, n, found in scan(batch.column(0), m)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))],
                ["y", "n", "s"])

    rows = sample.mapInArrow(run, "y int, n bigint, s array<double>").toPandas()
    y, n = rows["y"].to_numpy(float), rows["n"].to_numpy(float)
    clean = y == 0
    high = sorted((v for s, c in zip(rows["s"], clean) if c for v in s), reverse=True)[:TAIL]
    # K * n * exp(-lam * S) segments of score S or more are expected in n words
    edge = high[-1] if high else float(model.scores.max())
    model.ln_k = float(math.log(max(len(high), 1)) + model.lam * edge - math.log(max(n[clean].sum(), 1)))
    x = np.array([surprise([(0, 0, v) for v in s], int(k), model.lam, model.ln_k)[0] for s, k in zip(rows["s"], n)])
    model.slope, model.offset = logistic(np.clip(x, -50, 50), y)
    return model


COLUMNS = "score double, predicted int, n_passages bigint, passages string"


def score(docs: DataFrame, model: Model, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score, predicted, n_passages and passages (significant word ranges, start:end) appended."""
    sent = Sent(docs.sparkSession, model)
    kept = docs.columns if keep is None else keep
    names = [f"{prefix}{c.split()[0]}" for c in COLUMNS.split(", ")]
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = [surprise(found, n, m.lam, m.ln_k) for _, n, found in scan(batch.column(at["text"]), m)]
            p = squash(m.slope * np.clip(np.array([x for x, _ in rows]), -50, 50) + m.offset) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array([len(s) for _, s in rows], pa.int64()),
                 pa.array([",".join(f"{a}:{b}" for a, b in s) for _, s in rows], pa.string())], [*kept, *names])

    extra = ", ".join(f"`{n}` {c.split()[1]}" for n, c in zip(names, COLUMNS.split(", ")))
    return docs.mapInArrow(run, extended(docs.select(*kept).schema, extra))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) for every row of ``docs``; a null id is held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", PARTS) == HELD, F.lit(True)).alias("held_out"),
                         "score", "predicted", "n_passages", "passages")
