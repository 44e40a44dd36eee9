"""Round histogram edges from two numbers, and bucket expressions over them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Round steps within a decade, the bin count aimed at, and the counts allowed.
MANTISSAS, TARGET, LIMITS = (1.0, 2.0, 2.5, 5.0), 6, (4, 10)


def round_numbers(least: float, most: float) -> np.ndarray:
    """All round numbers in [least, most], rising."""
    decades = range(math.floor(math.log10(least)), math.ceil(math.log10(most)) + 1)
    numbers = np.array([m * 10.0**e for e in decades for m in MANTISSAS])  # Python's power: numpy's is off by a unit in the last place for some exponents
    return numbers[(numbers >= least) & (numbers <= most)]


def histogram_edges(low: float | None, high: float | None) -> tuple[float, ...]:
    """Edges for values between low and high: multiples of a round step that cover them. One bin around a single value or none.

    A step s covers a span in at least span / s bins and at most two more, so only round numbers between a tenth and half of the span can give an
    allowed count. Of these the one whose count is nearest the target is taken, the finer of two; without any, a sixth of the span.
    """
    if low is None or high is None or not np.isfinite([low, high]).all() or low == high:
        centre = float(low) if low is not None and np.isfinite(low) else 0.0
        half = abs(centre) / 20 or 0.5
        return centre - half, centre + half
    if high < low:
        raise ValueError(f"no histogram from {low} to {high}")
    span = high - low
    steps = round_numbers(span / LIMITS[1] * (1 - 1e-9), span / 2)
    bins = np.ceil(high / steps) - np.floor(low / steps)
    steps, bins = (x[(bins >= LIMITS[0]) & (bins <= LIMITS[1])] for x in (steps, bins))
    step = float(steps[np.abs(bins - TARGET).argmin()]) if len(steps) else span / TARGET
    at = np.arange(np.floor(low / step), max(np.ceil(high / step), np.floor(low / step) + 1) + 1) * step
    decimals = max(0, 1 - math.floor(math.log10(step)))
    return tuple(round(v, decimals) for v in at.tolist())


def bucket(value: Column, cuts: tuple[float, ...]) -> Column:
    """Number of the bin a value lies in, from 0; the last bin holds its right edge; null outside."""
    last = len(cuts) - 2
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]), lambda c: c <= value)) - 1  # edges up to the value
    return F.when((value >= cuts[0]) & (value <= cuts[-1]), F.least(passed, F.lit(last))).cast("int")
