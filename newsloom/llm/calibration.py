"""Isotonic calibration of raw scores against 0/1 labels."""

import numpy as np
from pyspark.sql import functions as F

#: Raw scores are counted in so many equal steps between their least and greatest value.
STEPS = 1000


def fit_isotonic(scored, steps=STEPS):
    """Knots ``(x, y)`` of a non-decreasing map from the ``raw`` column to the rate of ``label`` 1.

    Spark counts labels per step (at most ``steps`` rows); neighbouring steps that violate the
    order are pooled. Without rows the map is constant at one half.
    """
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    if low is None:
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    width = (high - low) / steps or 1.0
    step = F.least(F.floor((F.col("raw") - low) / width), F.lit(steps - 1))
    rows = scored.groupBy(step.alias("step")).agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"),
        F.count("*").alias("n"), F.sum("label").alias("ones"),
    )
    pools = []  # [least raw, greatest raw, rows, ones]
    for r in sorted(rows.collect()):
        pools.append([r["low"], r["high"], r["n"], float(r["ones"])])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, n, ones = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + n, pools[-1][3] + ones]
    # a rate holds over its whole pool
    x = np.array([v for p in pools for v in p[:2]])
    # half a case on either side keeps a small pool from certainty
    y = np.array([(p[3] + 0.5) / (p[2] + 1.0) for p in pools for _ in range(2)])
    return x, np.maximum.accumulate(y)


def apply_isotonic(raw, knots):
    """Calibrated scores; between two knots they rise evenly, beyond the ends a little further."""
    x, y = knots
    score = np.interp(raw, x, y)
    # equal rates keep the order of their raw scores
    return np.clip(score + 1e-6 * np.tanh(raw), 0.0, 1.0)
