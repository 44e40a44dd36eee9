"""Month coverage: records by layer, year and month on a complete grid, judged against the median of their own year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.domains import FATALITY, INJURY, THIN_SHARE, declared
from loomgrid.functions.scalars import share
from loomgrid.operators.grid import complete_grid, fill, years_table

KEYS = ["CASUALTY_SOURCE", "YEAR", "MONTH"]


def observed_months(casualties: DataFrame) -> DataFrame:
    """Records by layer, year column and month of the date; rows without one of these are left out."""
    months = casualties.select("CASUALTY_SOURCE", "YEAR", F.month("FECHA_OCUR").alias("MONTH"))
    return months.filter("CASUALTY_SOURCE is not null and YEAR is not null and MONTH is not null").groupBy(*KEYS).agg(F.count("*").alias("RECORDS"))


def date_profile(casualties: DataFrame) -> DataFrame:
    """By layer: rows, rows without a usable date, and rows whose year column and date disagree."""
    return casualties.groupBy("CASUALTY_SOURCE").agg(F.count("*").alias("ROWS"), F.count_if(F.col("FECHA_OCUR").isNull()).alias("UNDATED"), F.count_if(F.col("YEAR") != F.year("FECHA_OCUR")).alias("DISAGREEING"))


def monthly_table(casualties: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """The complete grid with records, the year's median over its twelve months, the share of it, EMPTY and THIN.

    Records outside the grid are dropped here, as an audit has nothing to say of them.
    """
    spark = casualties.sparkSession
    layers = declared(spark, [(FATALITY,), (INJURY,)], "CASUALTY_SOURCE string")
    months = declared(spark, [(m,) for m in range(1, 13)], "MONTH int")
    table = fill(complete_grid(layers, years_table(spark, years), months), observed_months(casualties), KEYS, ["RECORDS"])
    year = Window.partitionBy("CASUALTY_SOURCE", "YEAR")
    table = table.withColumn("YEAR_MEDIAN", F.median("RECORDS").over(year))
    table = table.withColumn("SHARE_OF_MEDIAN", share(F.col("RECORDS"), F.col("YEAR_MEDIAN")))
    return table.withColumns({"EMPTY": F.col("RECORDS") == 0, "THIN": F.col("SHARE_OF_MEDIAN") < THIN_SHARE})


def flagged(table: DataFrame) -> DataFrame:
    return table.filter("THIN or EMPTY")


def year_by_month(table: DataFrame, layer: str) -> DataFrame:
    return table.filter(F.col("CASUALTY_SOURCE") == layer).groupBy("YEAR").pivot("MONTH", list(range(1, 13))).agg(F.max("RECORDS"))


def yearly_change(table: DataFrame) -> DataFrame:
    """Records by layer and year, and their change in percent from the year before where that had any."""
    totals = table.groupBy("CASUALTY_SOURCE", "YEAR").agg(F.sum("RECORDS").alias("RECORDS"))
    before = F.lag("RECORDS").over(Window.partitionBy("CASUALTY_SOURCE").orderBy("YEAR"))
    return totals.withColumn("BEFORE", before).withColumn("CHANGE_PCT", F.when(F.col("BEFORE") > 0, 100.0 * (F.col("RECORDS") - F.col("BEFORE")) / F.col("BEFORE")))


def trailing_empty(table: DataFrame) -> DataFrame:
    """Months without records at the end of a layer's year."""
    return table.groupBy("CASUALTY_SOURCE", "YEAR").agg((12 - F.coalesce(F.max(F.when(~F.col("EMPTY"), F.col("MONTH"))), F.lit(0))).alias("TRAILING_EMPTY"))
