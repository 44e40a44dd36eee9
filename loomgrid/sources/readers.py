"""Readers with declared schemas, and what is checked of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.domains import FATALITY, INJURY, TYPE_OF_CLASS, Scale
from loomgrid.functions import wkt
from loomgrid.functions.scalars import normal_class, text_key, utc_timestamp

#: Declared schemas of the text sources.
VEHICLES = "FORMULARIO string, CODIGO_VEHICULO double, CLASE string"
EXTRACT = "FORMULARIO string, CODIGO_ACC string, CODIGO_VEH double, CONDICION string, CLASE_ACC string, ANO_OCURRE int, FECHA_OCUR string, MUERTE_POS string, geometry string"


class RosterError(ValueError):
    """A unit layer that is not the roster it is declared to be."""


def territorial_units(layer: DataFrame, scale: Scale, code: str, name: str) -> DataFrame:
    """(AREA_CODE, AREA_NAME, rings) of a unit layer; its size must be the declared one and its codes unique."""
    missing = {code, name} - set(layer.columns)
    if missing:
        raise RosterError(f"{scale.label}: no column {sorted(missing)}")
    units = layer.select(F.col(code).cast("string").alias("AREA_CODE"), F.col(name).alias("AREA_NAME"), *(["rings"] if "rings" in layer.columns else []))
    rows, codes = units.agg(F.count("*"), F.count_distinct("AREA_CODE")).first()
    if rows != scale.units or codes != rows:
        raise RosterError(f"{scale.label}: {rows} rows and {codes} codes for {scale.units} units")
    return units


def vehicles_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VEHICLES).option("header", True).csv(path)


def vehicle_profile(vehicles: DataFrame) -> DataFrame:
    """One row: rows that repeat a vehicle, rows of unmapped classes, rows mapped only after normalising, rows without a class. Nothing is filtered."""
    per = vehicles.groupBy("FORMULARIO", "CODIGO_VEHICULO").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("DUPLICATED"))
    classes = vehicles.groupBy("CLASE").agg(F.count("*").alias("n"))
    known = normal_class(F.col("CLASE")).isin(*TYPE_OF_CLASS)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    has = F.col("CLASE").isNotNull()
    return per.crossJoin(classes.agg(n(has & ~known).alias("UNMAPPED"), n(has & known & ~F.col("CLASE").isin(*TYPE_OF_CLASS)).alias("RESCUED"), n(~has).alias("NULL_CLASS")))


def loading_counts(casualties: DataFrame, vehicles: DataFrame) -> DataFrame:
    """One row of the six counts that a load is verified by."""
    fatal, injured, lost = F.col("CASUALTY_SOURCE") == FATALITY, F.col("CASUALTY_SOURCE") == INJURY, F.col("AREA_CODE").isNull()
    counts = casualties.agg(F.count_if(fatal).alias("fatalities"), F.count_if(injured).alias("injuries"), F.count("*").alias("casualties"), F.count_if(fatal & lost).alias("fatalities_unlocated"), F.count_if(injured & lost).alias("injuries_unlocated"))
    return counts.crossJoin(vehicles.agg(F.count("*").alias("vehicles")))


def extract_csv(spark: SparkSession, path: str) -> DataFrame:
    """An updated extract: ids as text keys, instants in UTC without a zone, the point of its WKT."""
    raw = spark.read.schema(EXTRACT).option("header", True).option("escape", '"').csv(path)
    at = wkt.point(F.col("geometry"))
    return raw.withColumns({"FORMULARIO": text_key(F.col("FORMULARIO")), "CODIGO_ACC": text_key(F.col("CODIGO_ACC")), "FECHA_OCUR": utc_timestamp(F.col("FECHA_OCUR")), "x": at["x"], "y": at["y"]}).withColumnRenamed("ANO_OCURRE", "YEAR").drop("geometry")


def casualty_layer(layer: DataFrame, source: str) -> DataFrame:
    """A layer tagged with its source; rows without a point stay."""
    return layer.withColumn("CASUALTY_SOURCE", F.lit(source))
