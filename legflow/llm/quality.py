"""Quality classifier by positive-unlabelled learning with non-negative risk.

A linear scorer over text statistics is fitted on trusted positives (rows
labelled good) and unlabelled web text (rows of the corpus, whatever their
label) by minimising the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss.  The class prior is estimated from the labelled rows
outside the held-out fold, as the share of good ones.  When the second term
falls below zero in a step, the step goes up its gradient instead.  A
logistic curve, fitted on the labelled sample, turns the scorer's value into
a score.

Statistics are of a whole text: word counts and lengths, shares of byte
classes and of single punctuation marks, shares of words without letters or
ending in marks, distinct words, sentence and line lengths, repeated lines,
and shares of words by ``HASHED`` hash classes.  Nothing but the text enters.

The three samples are bounded by ``SAMPLE`` rows each (least hash first, so
they do not depend on partitioning) and leave the held-out fold out.

Nulls and empty texts have all statistics 0 and are scored like any other.
Repeated rows are scored alike.  Without good labels, or without documents to
learn from, every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.labelled import fold, logistic, one_row, squash, training_ids
from legflow.llm.shared import Sent, cut

PARTS, HELD = 3, 1
SAMPLE = 10_000
HASHED = 64
MARKS = b"|#$%&*.,;:!?\"'()[]{}<>/\\-_=+@~^`"
ROUNDS, STEP, BATCH, DECAY = 1500, 0.02, 512, 1e-4


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def statistics(w: W.Words) -> np.ndarray:
    """A row of statistics for each text of a piece."""
    off, at = w.offsets, w.at
    n_bytes, n = np.diff(off).astype(float), np.diff(at).astype(float)
    data, size = w.data, (w.end - w.start).astype(float)
    cols = [np.log1p(n_bytes), np.log1p(n), share(sums(size, at), n), np.sqrt(share(sums(size * size, at), n)),
            share(sums(size <= 2, at), n), share(sums(size >= 15, at), n)]
    kinds = {"lower": (97, 123), "upper": (65, 91), "digit": (48, 58), "high": (128, 256)}
    letter = np.zeros(256, bool)
    for low, high in kinds.values():
        table = np.zeros(256, bool)
        table[low:high] = True
        cols.append(share(sums(table[data], off), n_bytes))
    for low, high in (kinds["lower"], kinds["upper"], kinds["high"]):
        letter[low:high] = True
    for mark in MARKS:
        cols.append(share(sums(data == mark, off), n))
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter[data], out=letters[1:])
    in_word = letters[w.end] - letters[w.start]
    first, last = data[w.start] if len(w.start) else np.zeros(0, np.uint8), data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    stops = np.isin(last, list(b".!?"))
    cols += [share(sums(in_word == 0, at), n), share(sums(in_word < size, at), n), share(sums(~letter[last] & ~stops & (last != 44), at), n),
             share(sums((first >= 65) & (first < 91), at), n), share(sums(stops, at), n)]
    newline = sums(data == 10, off)
    cols += [share(newline, n), np.log1p(share(n, newline + 1)), np.log1p(share(n, sums(stops, at) + 1))]
    text = np.repeat(np.arange(len(n)), np.diff(at))
    order = np.lexsort((w.hash, text))
    h, t = w.hash[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[:len(h)]
    distinct = np.bincount(t[new], minlength=len(n))
    cols += [share(distinct, n), share(distinct, np.sqrt(n))]
    # lines, by a hash of their words
    line = np.cumsum(np.append(False, data == 10))[w.start] if len(w.start) else np.zeros(0, np.int64)
    head = np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1]))[:len(line)]
    spot = np.flatnonzero(head)
    power, inverse = W.powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * power[:len(w.hash)], out=total[1:])
    stop = np.append(spot[1:], len(w.hash))
    key = (total[stop] - total[spot]) * inverse[spot]
    lt = text[spot]
    o = np.lexsort((key, lt))
    again = np.append(False, (key[o][1:] == key[o][:-1]) & (lt[o][1:] == lt[o][:-1]))[:len(o)]
    lines = np.bincount(lt, minlength=len(n))
    cols.append(share(np.bincount(lt[o][again], minlength=len(n)), lines))
    hashed = np.bincount(text * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64), minlength=len(n) * HASHED).reshape(-1, HASHED)
    return np.column_stack([np.asarray(c, float) for c in cols] + [hashed / np.maximum(n, 1)[:, None]])


def rows_of(column) -> Iterator[np.ndarray]:
    for _, _, data, offsets in W.pieces(column):
        yield statistics(W.split_words(data, offsets, W.spaced_words()))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float


def features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, y) of a bounded sample (text, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate(list(rows_of(batch.column(0)))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary())], ["y", "x"])

    rows = sample.mapInArrow(run, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(bytes(r) for r in rows["x"]), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    order = sorted(range(len(rows)), key=lambda i: (rows["y"][i], bytes(rows["x"][i])))
    return x[order].astype(float), rows["y"].to_numpy()[order]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by mini-batches and adaptive steps."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    theta, m, v, t = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    p1, u1 = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))

    def risk_and_slope(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        s = squash(-sign * (x @ theta))  # sigmoid loss
        return s.mean(), (x * (-sign * s * (1 - s))[:, None]).mean(axis=0)

    for _ in range(ROUNDS):
        p = p1[rng.integers(0, len(p1), BATCH)]
        u = u1[rng.integers(0, len(u1), BATCH)]
        _, gain = risk_and_slope(p, 1)
        p_neg, p_slope = risk_and_slope(p, -1)
        u_neg, u_slope = risk_and_slope(u, -1)
        if u_neg - prior * p_neg >= 0:
            slope = prior * gain + u_slope - prior * p_slope
        else:
            slope = prior * p_slope - u_slope
        slope = slope + DECAY * np.append(theta[:-1], 0)
        t += 1
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        theta = theta - STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(y: np.ndarray) -> float:
    """The share of positives among labelled rows, kept off 0 and 1."""
    return float(np.clip(y.mean(), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model, or the prior where there is nothing to learn from."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", PARTS) != HELD))
             .groupBy("doc_id").agg(F.max("quality").alias("y")).agg(F.avg("y")).head()[0])
    if not known:
        return 0.5 if known is None else 0.0
    prior = class_prior(np.array([known]))
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = training_ids(labels, "quality", PARTS, HELD, SAMPLE)
    others = (text.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold("doc_id", PARTS) != HELD))
              .orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(SAMPLE).collect())
    wanted = labelled.unionByName(spark.createDataFrame([(i, 2) for i in sorted({r.doc_id for r in others})], "doc_id bigint, y int"))
    x, y = features(cut(one_row(text.join(F.broadcast(wanted), "doc_id"), ["doc_id", "y"])))
    if not (y == 1).any() or not (y == 2).any():
        return prior
    centre, scale = x[y == 2].mean(axis=0), x[y == 2].std(axis=0) + 1e-3
    z = np.clip((x - centre) / scale, -8, 8)
    weight, bias = fit_pu(z[y == 1], z[y == 2], prior)
    value = z @ weight + bias
    slope, offset = 1.0, 0.0
    if (y == 0).any():
        # the classes were sampled apart: weigh the good ones back to the prior by repeating the fit's offset
        slope, offset = logistic(value[y < 2], y[y < 2].astype(float))
        sampled = (y == 1).sum() / (y < 2).sum()
        offset += float(np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))
    return Model(centre, scale, weight, bias, slope, offset)


def values(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    return squash(model.slope * (z @ model.weight + model.bias) + model.offset)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; a null id is held out."""
    sent = Sent(docs.sparkSession, fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if isinstance(model, float):
                p = np.full(batch.num_rows, model)
            else:
                p = np.concatenate([values(model, x) for x in rows_of(batch.column(1))]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    held = F.coalesce(fold("doc_id", PARTS) == HELD, F.lit(True))
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted"))
