"""Complete grids: every combination of declared domains is a row, and nothing observed may lie outside."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.domains import declared


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def bounded(table: DataFrame, rows: int | None = None) -> DataFrame:
    """`table`, to be broadcast if it has at most `BROADCAST_ROWS` rows (counted unless `rows` says how many); otherwise to be merged."""
    rows = table.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_ROWS else merged(table)


def merged(table: DataFrame) -> DataFrame:
    """`table`, for a join of two sides that grow with the data, neither to be broadcast: the optimiser goes by the size of files, and rows that take little room there take much in a driver."""
    return table.hint("merge")


@contextmanager
def held(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Tables that several jobs read: computed once, kept by the executors in memory or on disk until the jobs are done. One that its owner keeps already is left to them."""
    own = [t.persist() for t in tables if not t.is_cached]
    try:
        yield tables
    finally:
        for t in own:
            t.unpersist()


class CoverageError(RuntimeError):
    """An observation lies outside the declared grid."""


def years_table(spark: SparkSession, years: tuple[int, ...]) -> DataFrame:
    return declared(spark, [(y,) for y in years], "YEAR int")


def complete_grid(*domains: DataFrame) -> DataFrame:
    """The product of small declared domains."""
    return reduce(lambda a, b: a.crossJoin(b), domains)


def outside(observed: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Observed combinations that the grid lacks; null keys are outside any grid."""
    return observed.join(bounded(grid.select(*keys)), keys, "left_anti")


def assert_covered(observed: DataFrame, grid: DataFrame, keys: list[str]) -> None:
    stray = outside(observed, grid, keys).limit(5).collect()
    if stray:
        raise CoverageError(f"outside the declared grid: {[tuple(r[k] for k in keys) for r in stray]}")


def assert_unique(table: DataFrame, keys: list[str]) -> None:
    """Each combination of keys stands in one row, so that a pivot that keeps one value a cell loses none."""
    twice = table.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise CoverageError(f"more than one row for {[tuple(r[k] for k in keys) for r in twice]}")


def fill(grid: DataFrame, observed: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """The grid with what was observed; counts that were not observed are zero."""
    joined = grid.join(observed, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})
