"""Scalar arithmetic: schedules, time formats and information terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmmss(seconds: Column) -> Column:
    """Hours and minutes in two digits, seconds with six decimals and no padding."""
    h = F.floor(seconds / 3600)
    m = F.floor((seconds - h * 3600) / 60)
    return F.format_string("%02d:%02d:%.6f", h, m, (seconds - h * 3600 - m * 60).cast("double"))


def eta(seconds: Column) -> Column:
    """Whole seconds left as days and h:mm:ss."""
    s = F.floor(seconds)
    d = F.floor(s / 86400)
    days = F.when(d > 0, F.concat(d.cast("string"), F.when(d == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))).otherwise("")
    return F.concat(days, F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60))


def warmup(step: Column, start: float, base: float, steps: int) -> Column:
    """A linear rise from ``start`` to ``base`` over ``steps``, then ``base``."""
    return F.when(step < steps, F.lit(start) + (F.lit(base) - F.lit(start)) * step / F.lit(steps)).otherwise(F.lit(base))


def linear_decay(step: Column, warm: int, total: int) -> Column:
    """A factor that rises to 1 over ``warm`` steps and falls to 0 at ``total``."""
    return F.when(step < warm, step / F.greatest(F.lit(1), F.lit(warm))).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warm))))


def cosine(step: Column, base: float, total: float) -> Column:
    return F.lit(base) * (F.cos(F.lit(math.pi) * step / F.lit(total)) + 1.0) * 0.5


def kmeans_step(epoch: Column) -> Column:
    """The learning rate of a k-means epoch: a tenth of a tenth, a tenth less every five epochs."""
    return F.pow(F.lit(0.1), F.lit(2) + F.floor(epoch / 5))


def n_log_n(n: Column) -> Column:
    """n ln n, 0 at 0."""
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))


def pairs_of(n: Column) -> Column:
    """The number of pairs of n things."""
    return n * (n - 1) / 2


def frames(n: Column, k: int) -> Column:
    """k places spread evenly over n frames, cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int"))


def quota(batch: Column, select: int, of: int) -> Column:
    """How many to select from a batch at a ratio of ``select`` to ``of``."""
    return F.ceil(batch * F.lit(select) / F.lit(of))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of x >= 1, which Spark SQL lacks: Stirling's series at x + 8, less the
    logarithm of the factors between."""
    z = x + 8.0
    factors = x
    for k in range(1, 8):
        factors = factors * (x + float(k))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(factors)
