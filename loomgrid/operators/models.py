"""Models of counts over a table: Poisson regression, and linear regression with effects of two keys.

A round of a fit is one aggregation over the table: the sums that the normal equations need, k (k + 3) / 2 numbers for k coefficients, are all that reaches the driver, whatever the
number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.grid import held


@dataclass(frozen=True)
class Fit:
    """Coefficients by name, their standard errors, the rows used, and the rounds it took."""

    coefficients: dict[str, float]
    errors: dict[str, float]
    rows: int
    rounds: int


class ModelError(ValueError):
    """A model that these data do not determine."""


def _sums(rows: DataFrame, xs: list[Column], target: Column, weight: Column) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(X'WX, X'Wz, rows, z'Wz)."""
    k = len(xs)
    wanted = {f"a{i}_{j}": F.sum(weight * xs[i] * xs[j]) for i in range(k) for j in range(i, k)} | {f"b{i}": F.sum(weight * xs[i] * target) for i in range(k)} | {"zz": F.sum(weight * target * target), "n": F.count("*")}
    found = rows.agg(*[v.alias(n) for n, v in wanted.items()]).first()
    if not found["n"]:
        raise ModelError("no rows")
    a = np.array([[found[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return a, np.array([found[f"b{i}"] for i in range(k)], float), found["n"], float(found["zz"])


def _solved(a: np.ndarray, b: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse of the normal equations, scaled so that units of measurement do not matter."""
    scale = np.sqrt(np.diag(a))
    if not np.isfinite(scale).all() or (scale == 0).any():
        raise ModelError(f"nothing to tell {[n for n, s in zip(names, scale, strict=True) if not s > 0]} by")
    unit = a / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e12:
        raise ModelError(f"{names} are not independent")
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    return inverse @ b, inverse


def poisson(rows: DataFrame, count: str, covariates: dict[str, Column], exposure: Column | None = None, tolerance: float = 1e-10, most: int = 50) -> Fit:
    """Poisson regression with a log link by iteratively reweighted least squares. `exposure` multiplies the mean and gets no coefficient.

    Rows with a null or negative count, a null covariate or an exposure that is not positive are left out. Every round is one aggregation over these rows, which are computed once; it ends when no coefficient moves by more than `tolerance`.
    """
    names = list(covariates)
    used = rows.select(F.col(count).cast("double").alias("m_y"), *[c.cast("double").alias(f"m_{i}") for i, c in enumerate(covariates.values())], F.log((exposure if exposure is not None else F.lit(1.0)).cast("double")).alias("m_offset"))
    used = used.dropna().filter("m_y >= 0 and not isnan(m_offset) and m_offset > double('-infinity')")
    with held(used):
        return _reweighted(used, names, tolerance, most)


def _reweighted(used: DataFrame, names: list[str], tolerance: float, most: int) -> Fit:
    xs = [F.col(f"m_{i}") for i in range(len(names))]
    beta: np.ndarray | None = None
    for number in range(1, most + 1):
        if beta is None:  # start from the counts themselves
            mean = F.col("m_y") + 0.1
            target = F.log(mean) + (F.col("m_y") - mean) / mean - F.col("m_offset")
        else:
            link = sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
            mean = F.exp(link + F.col("m_offset"))
            target = link + (F.col("m_y") - mean) / mean
        a, b, n, _ = _sums(used, xs, target, mean)
        after, inverse = _solved(a, b, names)
        moved = np.inf if beta is None else np.abs(after - beta).max()
        beta = after
        if moved <= tolerance * (1 + np.abs(beta).max()):
            return Fit(dict(zip(names, beta.tolist(), strict=True)), dict(zip(names, np.sqrt(np.diag(inverse)).tolist(), strict=True)), n, number)
    raise ModelError(f"no fit after {most} rounds")


def within(rows: DataFrame, columns: list[str], effects: tuple[str, str]) -> DataFrame:
    """`rows` with every column less the means of its two keys, plus the mean of all: what is left after an effect of each.

    Exact on a complete grid, where every value of one key meets every value of the other equally often; another table is an error. The means are small tables by key.
    """
    first, second = effects
    cells = rows.groupBy(first, second).count()
    shape = cells.agg(F.count("*").alias("cells"), F.count_distinct(first).alias("a"), F.count_distinct(second).alias("b"), F.min("count").alias("low"), F.max("count").alias("high")).first()
    if shape["cells"] != shape["a"] * shape["b"] or shape["low"] != shape["high"]:
        raise ModelError(f"{first} by {second} is no complete grid")
    mean = lambda key, mark: rows.groupBy(F.col(key).alias(f"k_{mark}")).agg(*[F.avg(c).alias(f"{mark}_{c}") for c in columns])
    whole = rows.agg(*[F.avg(c).alias(f"t_{c}") for c in columns])
    met = rows.join(mean(first, "f"), F.col(first).eqNullSafe(F.col("k_f"))).join(mean(second, "s"), F.col(second).eqNullSafe(F.col("k_s"))).crossJoin(whole)  # one row
    return met.select(*[c for c in rows.columns if c not in columns], *[(F.col(c) - F.col(f"f_{c}") - F.col(f"s_{c}") + F.col(f"t_{c}")).alias(c) for c in columns])


def two_way(rows: DataFrame, response: str, covariates: list[str], effects: tuple[str, str]) -> Fit:
    """Least squares of the response on covariates with an effect of each value of two keys, by the within-transformation. Standard errors count the effects as fitted."""
    with held(rows.select(*effects, *[F.col(c).cast("double").alias(c) for c in (response, *covariates)])) as (used,):
        centred = within(used, [response, *covariates], effects)
        a, b, n, zz = _sums(centred, [F.col(c) for c in covariates], F.col(response), F.lit(1.0))
        keys = used.agg(F.count_distinct(effects[0]).alias("a"), F.count_distinct(effects[1]).alias("b")).first()
    beta, inverse = _solved(a, b, covariates)
    free = n - len(covariates) - keys["a"] - keys["b"] + 1
    if free <= 0:
        raise ModelError("no more rows than coefficients and effects")
    spread = max(0.0, zz - float(b @ beta)) / free
    return Fit(dict(zip(covariates, beta.tolist(), strict=True)), dict(zip(covariates, np.sqrt(spread * np.diag(inverse)).tolist(), strict=True)), n, 1)
