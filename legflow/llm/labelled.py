"""Bounded, repeatable samples of labelled documents, and a two-parameter logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def training_ids(labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, y): at most ``most`` labelled ids of each class outside the held-out fold.

    The ids of least hash are taken, so the sample does not depend on
    partitioning.  Several labels of one id count as their largest; null ids
    and labels are left out.  The result's size is bounded, so it may be broadcast.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", parts) != held))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    by = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    rows = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(*by).limit(most).collect()]
    return labels.sparkSession.createDataFrame([(r.doc_id, r.y) for r in rows], "doc_id bigint, y int")


def one_row(rows: DataFrame, by: list[str]) -> DataFrame:
    """(text, y): of the rows that share an id, the text of least digest, so a sample bounded by ids is bounded by rows too.

    A map task passes on one row an id, however many share it.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("text"), F.md5("text")))
    return rows.withColumn("nth", nth).filter("nth = 1").select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of P(y = 1 | x) by Newton's method with a small ridge on the slope."""
    a, b = 0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    centre, scale = x.mean(), x.std() + 1e-9
    z = (x - centre) / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + ridge * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + ridge, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b - a * centre / scale


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
