"""Bounded samples of labelled documents and a plain logistic fit, shared by the trained scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def label_sample(labels: DataFrame, column: str, per_class: int, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """At most ``per_class`` labelled ids of either class, taken in the order of a hash; held-out ids never appear.

    Columns ``doc_id``, ``label``. A document labelled twice counts as positive if one label is.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (remainder(modulus) != held_out))
             .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))
    ordered = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return ordered[0].unionByName(ordered[1])


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression by Newton steps; zeros without both classes."""
    x = np.column_stack([features, np.ones(len(features))]) if len(features) else np.zeros((0, features.shape[1] + 1))
    weights = np.zeros(x.shape[1])
    if len(set(labels.tolist())) < 2:
        if len(labels):
            weights[-1] = 2.0 if labels[0] else -2.0
        return weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        weights = weights - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
