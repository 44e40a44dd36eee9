"""Parties of a crash, who was hurt, and each party's counterpart.

Vehicles and casualties of a crash meet in one shuffle on the crash id and are sorted once: resolving a casualty's vehicle, making and
counting parties are windows over that order, which hold a crash at a time. A crash has a handful of rows, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.domains import MAX_PARTIES, RANK, SELF, TYPES
from loomgrid.functions.scalars import lookup, type_of_class, type_of_role


#: Vehicles of a partition of crashes, about; a crash has a handful, so partitions are alike and what a task holds does not grow with the tables.
PART_VEHICLES = 250_000


class IngestError(ValueError):
    """Input that the rules cannot place."""


def assert_crash_ids(casualties: DataFrame) -> None:
    """A casualty without a crash would vanish from every count."""
    if not casualties.filter("FORMULARIO is null").isEmpty():
        raise IngestError("casualties without a crash id")


def person_profile(casualties: DataFrame) -> DataFrame:
    """One row: ROWS, DUPLICATED (crash, person) rows beyond the first, NULL_PERSONS, and CROSS_LAYER: persons in both layers."""
    per = casualties.groupBy("FORMULARIO", "CODIGO_ACC").agg(F.count("*").alias("n"), F.count_distinct("CASUALTY_SOURCE").alias("layers"))
    known = F.col("CODIGO_ACC").isNotNull()
    return per.agg(
        F.sum("n").alias("ROWS"), F.sum(F.when(known, F.col("n") - 1).otherwise(0)).alias("DUPLICATED"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("NULL_PERSONS"), F.count_if(known & (F.col("layers") > 1)).alias("CROSS_LAYER"))


def person_ids_usable(casualties: DataFrame) -> bool:
    """Whether the person id tells people of a crash apart; otherwise rows do."""
    row = person_profile(casualties).first()
    return not (row.DUPLICATED or row.NULL_PERSONS)


def crash_partitions(spark: SparkSession, count: int, size: int | None = None) -> int | None:
    """Partitions of crashes that `count` vehicles need (or other rows, `size` to a partition); none if that is no more than the machines work on at once, the optimiser sizes them then."""
    parts = -(-count // (size or PART_VEHICLES))
    return parts if parts > spark.sparkContext.defaultParallelism else None


def by_crash(rows: DataFrame, count: int) -> DataFrame:
    """`rows` dealt by crash, to as many partitions as `count` vehicles need."""
    parts = crash_partitions(rows.sparkSession, count)
    return rows.repartition(parts, "FORMULARIO") if parts else rows.repartition("FORMULARIO")


def party_universe(casualties: DataFrame, vehicles: DataFrame, by_id: bool = False, count: int | None = None) -> DataFrame:
    """(FORMULARIO, PARTY_ID, PARTY_TYPE, PERSONS_INJURED, PERSONS_KILLED): every party of a crash with a casualty, the unharmed too.

    A vehicle without an id is no party. A casualty belongs to the vehicle that it names, if that is recorded for the crash; otherwise it
    is a party of its own, typed by its role. A vehicle listed twice is one party, of its first type in rank order.
    `count` says how many rows the vehicles have, about; without it they are counted.

    Without `by_id` a person is named by the place of the row in its crash, in an order of the columns used here; rows that tie there
    are alike in all that comes out, so any order of them gives the same rows.
    """
    person = F.col("CODIGO_ACC").cast("string") if by_id else F.lit(None).cast("string")
    rank = lambda t: lookup(t, RANK)
    hurt = casualties.select("FORMULARIO", F.lit(False).alias("_machine"), F.col("CODIGO_VEH").cast("long").alias("_vehicle"), person.alias("_person"), rank(type_of_role(F.col("CONDICION"))).alias("_type"), F.col("INJURED").alias("_injured"), F.col("KILLED").alias("_killed"))
    machines = vehicles.filter("CODIGO_VEHICULO is not null").select("FORMULARIO", F.lit(True).alias("_machine"), F.col("CODIGO_VEHICULO").cast("long").alias("_vehicle"), F.lit(None).cast("string").alias("_person"), rank(type_of_class(F.col("CLASE"))).alias("_type"), F.lit(0).alias("_injured"), F.lit(0).alias("_killed"))
    rows = by_crash(machines.unionByName(hurt), vehicles.count() if count is None else count)
    # One sort serves every window: each asks for a prefix of this order, vehicles before the casualties that name them.
    order = (F.desc("_machine"), "_type", "_injured", "_killed")
    crash = Window.partitionBy("FORMULARIO")
    vehicle = Window.partitionBy("FORMULARIO", "_vehicle")
    place = F.count_if(~F.col("_machine")).over(crash.orderBy("_vehicle", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_place", place).withColumn("_in_scope", F.bool_or(~F.col("_machine")).over(crash)).filter("_in_scope")
    rows = rows.withColumn("_first", F.row_number().over(vehicle.orderBy(*order)) == 1).withColumns({
        "_recorded": F.bool_or("_machine").over(vehicle) & F.col("_vehicle").isNotNull(),
        "_kind": F.min(F.when(F.col("_machine"), F.col("_type"))).over(vehicle),  # the vehicle's type beats the role
        "_all_injured": F.sum("_injured").over(vehicle),
        "_all_killed": F.sum("_killed").over(vehicle),
    }).filter("_first or not _recorded")
    own = lambda shared, alone: F.when(F.col("_recorded"), F.col(shared)).otherwise(F.col(alone))
    name = F.concat(F.lit("P"), F.col("_person") if by_id else F.col("_place").cast("string"))
    party = F.when(F.col("_recorded"), F.concat(F.lit("V"), F.col("_vehicle").cast("string"))).otherwise(name)
    each = rows.select("FORMULARIO", party.alias("PARTY_ID"), own("_kind", "_type").alias("_kind"), own("_all_injured", "_injured").cast("long").alias("PERSONS_INJURED"), own("_all_killed", "_killed").cast("long").alias("PERSONS_KILLED"))
    if by_id:  # rows of one person are one party
        each = each.groupBy("FORMULARIO", "PARTY_ID").agg(F.min("_kind").alias("_kind"), F.sum("PERSONS_INJURED").alias("PERSONS_INJURED"), F.sum("PERSONS_KILLED").alias("PERSONS_KILLED"))
    return each.select("FORMULARIO", "PARTY_ID", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("_kind") + 1).alias("PARTY_TYPE"), "PERSONS_INJURED", "PERSONS_KILLED")


def with_party_count(universe: DataFrame) -> DataFrame:
    return universe.withColumn("PARTIES", F.count("*").over(Window.partitionBy("FORMULARIO")))


def within_threshold(universe: DataFrame, most: int = MAX_PARTIES) -> DataFrame:
    """Parties of crashes with at most `most` of them; larger crashes go whole."""
    return with_party_count(universe).filter(F.col("PARTIES") <= most)


def resolve_counterparts(universe: DataFrame) -> DataFrame:
    """Adds COUNTERPART_TYPE: the other party's type, or SELF for a lone party."""
    crash = Window.partitionBy("FORMULARIO").orderBy("PARTY_ID")
    other = F.coalesce(F.lead("PARTY_TYPE").over(crash), F.lag("PARTY_TYPE").over(crash), F.lit(SELF))
    return within_threshold(universe).withColumn("COUNTERPART_TYPE", other)


def crash_attributes(casualties: DataFrame) -> DataFrame:
    """(FORMULARIO, YEAR, CRASH_CLASS, AREA_CODE, AREA_NAME), one row per crash.

    The least unit code of its casualties and that unit's name; year and class from the casualty with the least code that has one.
    """
    place = F.struct(F.col("AREA_CODE").isNull().alias("a"), F.col("AREA_CODE").alias("b"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(place.alias("p"), F.col(c).alias("v"))))["v"]
    return casualties.groupBy("FORMULARIO").agg(first("YEAR").alias("YEAR"), first("CLASE_ACC").alias("CRASH_CLASS"), F.min("AREA_CODE").alias("AREA_CODE"), first("AREA_NAME").alias("AREA_NAME"))


def affected_parties(resolved: DataFrame, attributes: DataFrame) -> DataFrame:
    """Parties with at least one casualty, with what is known of their crash."""
    hurt = resolved.filter(F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") > 0)
    return hurt.join(attributes, "FORMULARIO", "left").select(
        "FORMULARIO", "PARTY_ID", "PARTY_TYPE", "COUNTERPART_TYPE", F.lit(1).cast("long").alias("AFFECTED_PARTIES"), "PERSONS_INJURED", "PERSONS_KILLED", "AREA_CODE", "AREA_NAME", "YEAR", "CRASH_CLASS")


def in_final_order(affected: DataFrame) -> DataFrame:
    """The whole table by unit (without one last), crash and party: a range sort, so every partition holds a stretch of the order."""
    return affected.orderBy(F.col("AREA_CODE").asc_nulls_last(), "FORMULARIO", "PARTY_TYPE", "PARTY_ID")


def threshold_composition(universe: DataFrame, attributes: DataFrame) -> DataFrame:
    """Crash classes of what the threshold drops against what it keeps: counts, shares in percent, their ratio, and the share of the class dropped."""
    size = universe.groupBy("FORMULARIO").agg(F.count("*").alias("n"))
    per = attributes.join(size, "FORMULARIO", "left").groupBy("CRASH_CLASS").agg(F.count_if(F.coalesce(F.col("n"), F.lit(0)) > MAX_PARTIES).alias("DISCARDED"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) <= MAX_PARTIES).alias("KEPT"))
    everything = Window.partitionBy()  # a handful of classes
    drop = F.try_divide(100.0 * F.col("DISCARDED"), F.sum("DISCARDED").over(everything))
    keep = F.try_divide(100.0 * F.col("KEPT"), F.sum("KEPT").over(everything))
    return per.withColumns({"DISCARDED_PCT": drop, "KEPT_PCT": keep}).withColumns({
        "RATIO": F.try_divide(F.col("DISCARDED_PCT"), F.col("KEPT_PCT")), "PCT_OF_TYPE": F.try_divide(100.0 * F.col("DISCARDED"), F.col("DISCARDED") + F.col("KEPT")),
    }).orderBy(F.desc("DISCARDED_PCT"), F.desc("KEPT_PCT"), "CRASH_CLASS")


def divergence(affected: DataFrame, first: str = "MOTORCYCLE", second: str = "BICYCLE") -> DataFrame:
    """One row: parties of `first` hurt against `second` and the other way round, and the ratio of the two."""
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col("PARTY_TYPE") == a) & (F.col("COUNTERPART_TYPE") == b), F.col("AFFECTED_PARTIES"))), F.lit(0))
    both = affected.agg(F.count("*").alias("ROWS"), F.count_distinct("FORMULARIO").alias("CRASHES"), cell(first, second).alias("FORWARD"), cell(second, first).alias("BACKWARD"))
    return both.withColumn("RATIO", F.try_divide(F.col("FORWARD"), F.col("BACKWARD")))
