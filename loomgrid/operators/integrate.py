"""Replacing a whole year of a layer by a newer extract, and accounting for the people of that year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.domains import MIN_RATE_SHARE
from loomgrid.functions.scalars import share, text_key


class IntegrationError(ValueError):
    """An extract that must not replace anything."""


def assert_single_year(incoming: DataFrame, year: int, column: str = "YEAR") -> None:
    years = sorted((r[0] for r in incoming.select(column).distinct().limit(10).collect()), key=str)
    if years != [year]:
        raise IntegrationError(f"the extract covers {years}, not {[year]}")


def assert_same_types(incoming: DataFrame, template: DataFrame) -> None:
    wanted = {f.name: f.dataType for f in template.schema}
    wrong = [f"{c}: {incoming.schema[c].dataType.simpleString() if c in incoming.columns else 'absent'} for {t.simpleString()}" for c, t in wanted.items() if c not in incoming.columns or incoming.schema[c].dataType != t]
    if wrong:
        raise IntegrationError("; ".join(wrong))


def split_by_severity(incoming: DataFrame, mark: str = "MUERTE_POS") -> tuple[DataFrame, DataFrame]:
    """(fatal, injured): a fatal row has the mark."""
    return incoming.filter(F.col(mark).isNotNull()), incoming.filter(F.col(mark).isNull())


def replace_year(layer: DataFrame, incoming: DataFrame, year: int, column: str = "YEAR") -> DataFrame:
    """The layer without that year, and the extract. Rows without a year stay: they are not of that year."""
    kept = layer.filter(~F.col(column).eqNullSafe(F.lit(year)))
    return kept.unionByName(incoming, allowMissingColumns=True)


def account_for_people(previous: DataFrame, aligned: DataFrame, incoming_people: DataFrame, previous_people: DataFrame, person: str = "PERSON") -> DataFrame:
    """One row: STAYED, GONE, CHANGED_SEVERITY, FROM_OTHER_LAYER, BRAND_NEW people of the replaced year of one layer.

    Presence of each person in the four tables is aggregated once over their union: one shuffle by person.
    """
    tables = [previous, aligned, incoming_people, previous_people]
    marks = None
    for i, t in enumerate(tables):
        rows = t.select(F.col(person).alias("p"), *[F.lit(i == j).alias(f"in{j}") for j in range(4)])
        marks = rows if marks is None else marks.unionByName(rows)
    each = marks.groupBy("p").agg(*[F.bool_or(f"in{j}").alias(f"in{j}") for j in range(4)])
    was, now, came, known = (F.col(f"in{j}") for j in range(4))
    counted = {"STAYED": was & now, "GONE": was & ~now & ~came, "CHANGED_SEVERITY": was & ~now & came, "FROM_OTHER_LAYER": now & ~was & known, "BRAND_NEW": now & ~was & ~known, "WERE": was}
    return each.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])


def assert_overlap(account: DataFrame) -> None:
    row = account.first()
    if row.WERE and not row.STAYED:
        raise IntegrationError("no person of the previous extract is in the new one: their ids do not match")


def reference_rate(rows: DataFrame, vehicles: DataFrame, vehicle: str = "CODIGO_VEH") -> DataFrame:
    """One row: REFERENCING rows that name a vehicle, RESOLVED of them recorded for their crash, and RATE."""
    keys = vehicles.select(text_key(F.col("FORMULARIO")).alias("k_crash"), F.col("CODIGO_VEHICULO").try_cast("double").alias("k_vehicle")).distinct().withColumn("found", F.lit(1))
    asked = rows.filter(F.col(vehicle).isNotNull()).select(text_key(F.col("FORMULARIO")).alias("a_crash"), F.col(vehicle).try_cast("double").alias("a_vehicle"))
    joined = asked.join(keys, (F.col("a_crash") == F.col("k_crash")) & (F.col("a_vehicle") == F.col("k_vehicle")), "left")
    return joined.agg(F.count("*").alias("REFERENCING"), F.count("found").alias("RESOLVED")).withColumn("RATE", share(F.col("RESOLVED"), F.col("REFERENCING")))


def assert_rate(now: DataFrame, before: DataFrame) -> None:
    rate, old = (r.first().RATE or 0.0 for r in (now, before))
    if rate < MIN_RATE_SHARE * old:
        raise IntegrationError(f"vehicles resolve for {rate:.4f} of the extract against {old:.4f} the year before: their keys do not match")


def relocated(before: DataFrame, now: DataFrame, person: str = "PERSON") -> DataFrame:
    """One row: people located before and not now (NEWLY), the other way round (RECOVERED), and rows now in no unit (OUTSIDE)."""
    pairs = before.select(F.col(person).alias("p"), F.col("AREA_CODE").alias("old")).join(now.select(F.col(person).alias("p"), F.col("AREA_CODE").alias("new")), "p")
    counts = pairs.agg(F.count_if(F.expr("old is not null and new is null")).alias("NEWLY"), F.count_if(F.expr("old is null and new is not null")).alias("RECOVERED"))
    return counts.crossJoin(now.agg(F.count_if(F.col("AREA_CODE").isNull()).alias("OUTSIDE")))
