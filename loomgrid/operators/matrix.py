"""The casualty matrix: a complete grid of unit, year, affected type and counterpart type, and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.domains import COUNTERPARTS, TYPES, Study, ranked
from loomgrid.functions.scalars import share
from loomgrid.operators.grid import bounded, complete_grid, fill, years_table

KEYS = ["AREA_CODE", "YEAR", "PARTY_TYPE", "COUNTERPART_TYPE"]
COUNTS = ["AFFECTED_PARTIES", "PERSONS_INJURED", "PERSONS_KILLED"]


def located(affected: DataFrame) -> DataFrame:
    return affected.filter("AREA_CODE is not null")


def cells(affected: DataFrame) -> DataFrame:
    """Sums per observed cell; a null year is a cell of its own, and then lies outside every grid."""
    return located(affected).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def grid(study: Study) -> DataFrame:
    spark = study.units.sparkSession
    return complete_grid(study.units.select("AREA_CODE"), years_table(spark, study.years), ranked(spark, TYPES, "PARTY_TYPE"), ranked(spark, COUNTERPARTS, "COUNTERPART_TYPE"))


def long_table(affected: DataFrame, study: Study) -> DataFrame:
    """Every cell of the grid with its three counts, in the order of its keys' names and ranks."""
    whole = fill(grid(study), cells(affected), KEYS, COUNTS)
    named = whole.join(bounded(study.units, study.scale.units), "AREA_CODE", "left")
    ordered = named.orderBy("AREA_CODE", "YEAR", "PARTY_TYPE_RANK", "COUNTERPART_TYPE_RANK")
    return ordered.select(F.lit(study.scale.label).alias("SCALE"), *KEYS, "AREA_NAME", *COUNTS)


def crosstab(long: DataFrame, count: str, year: int | None = None) -> DataFrame:
    """The 6 x 7 table of one count, every declared type a row and every counterpart a column."""
    spark = long.sparkSession
    rows = long if year is None else long.filter(F.col("YEAR") == year)
    wide = rows.groupBy("PARTY_TYPE").pivot("COUNTERPART_TYPE", list(COUNTERPARTS)).agg(F.sum(count))
    return ranked(spark, TYPES, "PARTY_TYPE").join(wide, "PARTY_TYPE", "left").na.fill(0, list(COUNTERPARTS)).orderBy("PARTY_TYPE_RANK").drop("PARTY_TYPE_RANK")


def frequencies(affected: DataFrame) -> DataFrame:
    """Rows by type and counterpart type."""
    return affected.groupBy("PARTY_TYPE").pivot("COUNTERPART_TYPE", list(COUNTERPARTS)).count().na.fill(0)


def emptiness(long: DataFrame, by: str) -> DataFrame:
    """Share of cells without any count, by unit or by year."""
    empty = (F.col("AFFECTED_PARTIES") == 0) & (F.col("PERSONS_INJURED") == 0) & (F.col("PERSONS_KILLED") == 0)
    return long.groupBy(by).agg(F.avg(empty.cast("int")).alias("EMPTY_SHARE"))


def yearly_totals(long: DataFrame) -> DataFrame:
    """Totals by year and, with a null YEAR, over all."""
    return long.rollup("YEAR").agg(*[F.sum(c).alias(c) for c in COUNTS])


def counterpart_shares(long: DataFrame) -> DataFrame:
    """Share of each counterpart among the affected parties of a type; undefined where there are none."""
    per = long.groupBy("PARTY_TYPE", "COUNTERPART_TYPE").agg(F.sum("AFFECTED_PARTIES").alias("PARTIES"))
    return per.withColumn("SHARE", share(F.col("PARTIES"), F.sum("PARTIES").over(Window.partitionBy("PARTY_TYPE"))))


def extreme_cells(long: DataFrame, most: int = 3, largest: bool = True) -> DataFrame:
    """The `most` largest or smallest cells summed over units and years, ties by name."""
    per = long.groupBy("PARTY_TYPE", "COUNTERPART_TYPE").agg(F.sum("AFFECTED_PARTIES").alias("PARTIES"))
    return per.orderBy(F.desc("PARTIES") if largest else F.asc("PARTIES"), "PARTY_TYPE", "COUNTERPART_TYPE").limit(most)


def colour_range(long: DataFrame, count: str = "AFFECTED_PARTIES") -> DataFrame:
    """Least and most positive yearly cell: the range that yearly tables share."""
    yearly = long.groupBy("YEAR", "PARTY_TYPE", "COUNTERPART_TYPE").agg(F.sum(count).alias("n"))
    return yearly.agg(F.min(F.when(F.col("n") > 0, F.col("n"))).alias("LOW"), F.max(F.when(F.col("n") > 0, F.col("n"))).alias("HIGH"))


def shaded(long: DataFrame, count: str = "AFFECTED_PARTIES") -> DataFrame:
    """What the yearly figures of a count draw: (YEAR, PARTY_TYPE, COUNTERPART_TYPE, VALUE, SHADE). SHADE places a positive cell on a logarithmic scale from 0 to 1 over the positive
    cells of all years, so that years compare; a cell of 0 has none."""
    yearly = long.groupBy("YEAR", "PARTY_TYPE", "COUNTERPART_TYPE").agg(F.sum(count).alias("VALUE"))
    across = yearly.crossJoin(colour_range(long, count))  # one row
    wide = F.col("HIGH") > F.col("LOW")
    scale = F.when(wide, (F.log("VALUE") - F.log("LOW")) / (F.log("HIGH") - F.log("LOW"))).otherwise(F.lit(1.0))
    return across.select("YEAR", "PARTY_TYPE", "COUNTERPART_TYPE", "VALUE", F.when(F.col("VALUE") > 0, scale).alias("SHADE"))
