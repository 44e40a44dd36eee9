"""rho: the share of two-party crashes in which both parties had casualties, by unit, year and pair of types, and for the whole city."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.domains import CITY_LEVEL, JUMP, OTHER, PAIR_LABELS, PRIMARY, RANK, SPARSE, TYPES, UNIT_LEVEL, Study, declared, pairs_table
from loomgrid.functions.scalars import lookup, share
from loomgrid.operators.grid import complete_grid, years_table
from loomgrid.operators.parties import with_party_count

KEPT = "KEPT"
REASONS = (KEPT, "RESIDUAL", "SAME_TYPE", "NO_PRIMARY")


def crash_pairs(universe: DataFrame) -> DataFrame:
    """(FORMULARIO, PAIR_TYPE_A, PAIR_TYPE_B, BOTH_AFFECTED): crashes of exactly two parties, their types in rank order, ties by party id."""
    two = with_party_count(universe).filter("PARTIES = 2")
    rank = F.coalesce(lookup(F.col("PARTY_TYPE"), {t: RANK[t] for t in TYPES[:-1]}), F.lit(len(TYPES) - 1))
    side = F.struct(rank.alias("r"), "PARTY_ID", "PARTY_TYPE")
    return two.groupBy("FORMULARIO").agg(
        F.min(side)["PARTY_TYPE"].alias("PAIR_TYPE_A"), F.max(side)["PARTY_TYPE"].alias("PAIR_TYPE_B"), F.bool_and(F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") > 0).alias("BOTH_AFFECTED"))


def reason() -> Column:
    """One of `REASONS` for a pair: KEPT, or the first rule that excludes the crash."""
    a, b = F.col("PAIR_TYPE_A"), F.col("PAIR_TYPE_B")
    return F.when((a == OTHER) | (b == OTHER), "RESIDUAL").when(a == b, "SAME_TYPE").when(~(a.isin(*PRIMARY) | b.isin(*PRIMARY)), "NO_PRIMARY").otherwise(KEPT)


def with_reason(pairs: DataFrame) -> DataFrame:
    """Adds REASON."""
    return pairs.withColumn("REASON", reason())


def restrict(pairs: DataFrame) -> DataFrame:
    return with_reason(pairs).filter(F.col("REASON") == KEPT).drop("REASON").withColumn("PAIR", F.concat_ws("-", "PAIR_TYPE_A", "PAIR_TYPE_B"))


def with_attributes(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Crashes with their year and unit, which may be none."""
    return pairs.join(attributes.select("FORMULARIO", "YEAR", "AREA_CODE", "AREA_NAME"), "FORMULARIO", "left")


def placed(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Crashes with their year and unit; those in no unit go."""
    return with_attributes(pairs, attributes).filter("AREA_CODE is not null")


def aggregate(crashes: DataFrame) -> DataFrame:
    """Crashes and crashes with both hurt at both levels in one pass: by unit, and pooled over the city (AREA_CODE null)."""
    levels = crashes.groupingSets([["AREA_CODE", "YEAR", "PAIR"], ["YEAR", "PAIR"]], "AREA_CODE", "YEAR", "PAIR").agg(
        F.grouping("AREA_CODE").alias("POOLED"), F.count_if("BOTH_AFFECTED").alias("CRASHES_BOTH_AFFECTED"), F.count("*").alias("CRASHES_TOTAL"))
    return levels


def long_table(crashes: DataFrame, study: Study) -> DataFrame:
    """Both levels on one complete grid. The city pools crashes, it does not average units; an empty cell has no rho, which is not zero."""
    spark = crashes.sparkSession
    city = declared(spark, [(study.city_code, study.city_name, CITY_LEVEL)], "AREA_CODE string, AREA_NAME string, AGGREGATION_LEVEL string")
    places = study.units.select("AREA_CODE", "AREA_NAME", F.lit(UNIT_LEVEL).alias("AGGREGATION_LEVEL")).unionByName(city)
    whole = complete_grid(places, years_table(spark, study.years), pairs_table(spark))
    seen = aggregate(crashes).withColumn("AREA_CODE", F.when(F.col("POOLED") == 1, study.city_code).otherwise(F.col("AREA_CODE"))).withColumn("AGGREGATION_LEVEL", F.when(F.col("POOLED") == 1, CITY_LEVEL).otherwise(UNIT_LEVEL)).drop("POOLED")
    joined = whole.join(seen, ["AGGREGATION_LEVEL", "AREA_CODE", "YEAR", "PAIR"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("CRASHES_BOTH_AFFECTED", "CRASHES_TOTAL")})
    return joined.select(
        F.lit(study.scale.label).alias("SCALE"), "AGGREGATION_LEVEL", "AREA_CODE", "AREA_NAME", "YEAR", "PAIR", "PAIR_TYPE_A", "PAIR_TYPE_B", "CRASHES_BOTH_AFFECTED", "CRASHES_TOTAL",
        share(F.col("CRASHES_BOTH_AFFECTED"), F.col("CRASHES_TOTAL")).alias("RHO")).orderBy("AGGREGATION_LEVEL", "AREA_CODE", "YEAR", "PAIR")


def city_table(long: DataFrame, value: str = "RHO") -> DataFrame:
    """Years by pairs for the city; a cell without rho stays null."""
    return long.filter(F.col("AGGREGATION_LEVEL") == CITY_LEVEL).groupBy("YEAR").pivot("PAIR", list(PAIR_LABELS)).agg(F.max(value))


def jumps(long: DataFrame, least: float | None = JUMP) -> DataFrame:
    """Year-on-year changes of the city's rho where both years have one, largest first; with `least`, only those at least so large."""
    pair = Window.partitionBy("PAIR").orderBy("YEAR")
    before = {"RHO_BEFORE": F.lag("RHO").over(pair), "CRASHES_BEFORE": F.lag("CRASHES_TOTAL").over(pair), "YEAR_BEFORE": F.lag("YEAR").over(pair)}
    city = long.filter(F.col("AGGREGATION_LEVEL") == CITY_LEVEL).withColumns(before).filter("RHO is not null and RHO_BEFORE is not null and YEAR_BEFORE = YEAR - 1")
    changed = city.withColumn("CHANGE", F.col("RHO") - F.col("RHO_BEFORE"))
    changed = changed if least is None else changed.filter(F.abs("CHANGE") >= least)
    return changed.select("PAIR", "YEAR", "RHO_BEFORE", "RHO", "CHANGE", "CRASHES_BEFORE", "CRASHES_TOTAL").orderBy(F.abs("CHANGE").desc(), "PAIR", "YEAR")


def lines(long: DataFrame) -> DataFrame:
    """What a figure of the city's rho draws: (PAIR, YEAR, RHO, SEGMENT, JUMPED), one row for each declared pair and year.

    SEGMENT numbers the runs of years that a line connects, from 1; a year without rho is in none and breaks the line. JUMPED marks a change from the year before of at least the limit.
    """
    pair = Window.partitionBy("PAIR").orderBy("YEAR")
    has, before = F.col("RHO").isNotNull(), F.lag("RHO").over(pair)
    joined = has & before.isNotNull() & (F.lag("YEAR").over(pair) == F.col("YEAR") - 1)
    city = long.filter(F.col("AGGREGATION_LEVEL") == CITY_LEVEL).withColumns({"starts": (has & ~F.coalesce(joined, F.lit(False))).cast("int"), "JUMPED": F.coalesce(joined & (F.abs(F.col("RHO") - before) >= JUMP), F.lit(False))})
    run = F.sum("starts").over(pair.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return city.select("PAIR", "YEAR", "RHO", F.when(has, run).alias("SEGMENT"), "JUMPED")


def gaps(long: DataFrame) -> DataFrame:
    """(PAIR, FIRST_YEAR, LAST_YEAR, YEARS): the stretches of years in which the city's rho of a pair is undefined."""
    pair = Window.partitionBy("PAIR").orderBy("YEAR")
    empty = long.filter((F.col("AGGREGATION_LEVEL") == CITY_LEVEL) & F.col("RHO").isNull()).withColumn("island", F.col("YEAR") - F.row_number().over(pair))
    return empty.groupBy("PAIR", "island").agg(F.min("YEAR").alias("FIRST_YEAR"), F.max("YEAR").alias("LAST_YEAR"), F.count("*").alias("YEARS")).drop("island")


def sparse_cells(long: DataFrame) -> DataFrame:
    """Unit cells by pair: how many, with fewer crashes than the limit, empty, and the median behind a cell. Nothing is filtered by it."""
    return long.filter(F.col("AGGREGATION_LEVEL") == UNIT_LEVEL).groupBy("PAIR").agg(
        F.count("*").alias("CELLS"), F.count_if(F.col("CRASHES_TOTAL") < SPARSE).alias("SPARSE"), F.count_if(F.col("CRASHES_TOTAL") == 0).alias("EMPTY"), F.median("CRASHES_TOTAL").alias("MEDIAN_CRASHES"))


def pooled_and_mean(long: DataFrame) -> DataFrame:
    """By pair and, with a null PAIR, over all: the city's pooled rho against the mean of unit cells, and how many of these there are."""
    city, unit = F.col("AGGREGATION_LEVEL") == CITY_LEVEL, F.col("AGGREGATION_LEVEL") == UNIT_LEVEL
    pooled = F.try_divide(F.sum(F.when(city, F.col("CRASHES_BOTH_AFFECTED"))), F.nullif(F.sum(F.when(city, F.col("CRASHES_TOTAL"))), F.lit(0)))
    return long.rollup("PAIR").agg(pooled.alias("POOLED"), F.avg(F.when(unit, F.col("RHO"))).alias("MEAN_OF_UNITS"), F.count(F.when(unit, F.col("RHO"))).alias("UNIT_CELLS"))


def unexpected_pairs(pairs: DataFrame) -> DataFrame:
    """Pair labels outside the declared ones; there are none if the rules hold."""
    return pairs.filter(~reduce(lambda x, y: x | y, [F.col("PAIR") == p for p in PAIR_LABELS])).select("PAIR").distinct()
