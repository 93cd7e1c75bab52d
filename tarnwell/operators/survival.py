"""Proportional hazards over all rows: risk sets as running sums over ranges of time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.saved import Saved

from .running import running

RIDGE, ROUNDS, CLOSE = 1e-3, 25, 1e-8


def cox_coefficients(df: DataFrame, features: Sequence[str], time: str, event: str | None = None, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Coefficients by Newton steps, ties by Breslow; event is 1 where the end was seen, and all were if it is None.

    A risk set is all rows that last as long as an event or longer. Its sums of weights,
    weighted features and their products run from the latest time down, over ranges of
    times that were added up first, so a step is one aggregate of the table and one of its
    distinct times. The driver gets a gradient and a matrix of the features' number.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(f"x{i}") for i in range(k)]
    seen = F.col(event).cast("double") if event else F.lit(1.0)
    with Saved(df.sparkSession) as saved:
        rows = saved(df.where(F.col(time).isNotNull()).select(F.col(time).cast("double").alias("t"), seen.alias("seen"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]))
        beta = np.zeros(k)
        for _ in range(rounds):
            line = sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
            weighed = rows.withColumn("w", F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), line))))
            sums = {"s": F.col("w"), **{f"a{i}": F.col("w") * x[i] for i in range(k)}, **{f"b{i}_{j}": F.col("w") * x[i] * x[j] for i, j in pairs}}
            ends = {"d": F.col("seen"), **{f"e{i}": F.col("seen") * x[i] for i in range(k)}}
            times = weighed.groupBy("t").agg(*[F.sum(e).alias(n) for n, e in (sums | ends).items()])
            later = running(times, "t", {f"after_{n}": F.col(n) for n in sums}, descending=True)
            risk = {n: F.col(n) + F.col(f"after_{n}") for n in sums}
            mean = [risk[f"a{i}"] / risk["s"] for i in range(k)]
            slopes = [F.sum(F.col(f"e{i}") - F.col("d") * mean[i]) for i in range(k)]
            bends = [F.sum(F.col("d") * (risk[f"b{i}_{j}"] / risk["s"] - mean[i] * mean[j])) for i, j in pairs]
            found = later.agg(*[e.alias(f"v{n}") for n, e in enumerate(slopes + bends)]).first()
            if found[0] is None:
                break  # no rows
            gradient = np.array(found[:k]) - ridge * beta
            matrix = ridge * np.eye(k)
            for (i, j), v in zip(pairs, found[k:], strict=True):
                matrix[i, j] += v
                matrix[j, i] += v * (i != j)
            step = np.linalg.solve(matrix, gradient)
            beta = beta + step
            if np.abs(step).max() < CLOSE:
                break
    return beta
