"""Small tables with known structure."""

import numpy as np

from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally


def flipped(rng, x, chance):
    return np.where(rng.random(len(x)) < chance, 1 - x, x)


def branching(n=1000, seed=42, chance=0.1):
    """0 -> 1 -> 2 and 0 -> 3."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, n)
    b = flipped(rng, a, chance)
    return np.column_stack([a, b, flipped(rng, b, chance), flipped(rng, a, chance)])


def chain(n=1200, k=8, seed=1234, chance=0.1):
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 2, n)]
    for _ in range(k - 1):
        out.append(flipped(rng, out[-1], chance))
    return np.column_stack(out)


def collider(n=4000, seed=5):
    """0 -> 2 <- 1 by a noisy or, 2 -> 3, and 4 alone."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    c = flipped(rng, a | b, 0.05)
    return np.column_stack([a, b, c, flipped(rng, c, 0.1), rng.integers(0, 2, n)])


def context(n=4000, seed=7):
    """0 -> 1; 2 follows 1 only where 0 is 1; 0 -> 3."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, n)
    b = flipped(rng, a, 0.3)
    c = np.where(a == 0, rng.random(n) < 0.1, np.where(b == 1, rng.random(n) < 0.9, rng.random(n) < 0.4)).astype(int)
    return np.column_stack([a, b, c, flipped(rng, a, 0.2)])


def mixed(n=800, seed=99):
    rng = np.random.default_rng(seed)
    cards = (2, 3, 2, 4, 2, 3)
    a = rng.integers(0, 2, n)
    cols = [a, (a + rng.integers(0, 2, n)) % 3, flipped(rng, a, 0.15), rng.integers(0, 4, n), rng.integers(0, 2, n), rng.integers(0, 3, n)]
    return np.column_stack(cols), cards


def tally(spark, x, cards=None, weight=None):
    import pandas as pd
    from pyspark.sql import functions as F

    cards = cards or tuple(max(2, int(k) + 1) for k in x.max(axis=0))
    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
    if weight is not None:
        frame["weight"] = weight
    return Tally.of(spark.createDataFrame(frame), [f"x{i}" for i in range(x.shape[1])], cards, None if weight is None else F.col("weight"))


def counter(spark, x, cards=None, **options):
    return Counter(tally(spark, x, cards), **options)
