"""The data model over the star-schema tables: orders are crashes, parts vehicles, returned lines casualties, nations units.

Everything is narrow columns of the tables' own scans; joins are plain equality joins, the small sides left to the optimiser. Lines meet
their orders in partitions of bounded size, and so do lines and parts, orders and customers once there are too many of the latter to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.domains import FATALITY, INJURY, Scale, Study
from loomgrid.functions.scalars import lookup
from loomgrid.operators import grid
from loomgrid.operators.parties import crash_partitions

#: Fixed values of the adapter: raw vehicle classes by part type, roles by order priority, and the region whose crashes lie in no unit.
CLASS_OF_PART = {"SMALL": "Peatón", "ECONOMY": "BICICLETA", "PROMO": " motocicleta", "MEDIUM": "Automóvil", "LARGE": "BUS  ARTICULADO", "STANDARD": "Camión , furgón"}
ROLE_OF_PRIORITY = {"1-URGENT": "PEATON", "2-HIGH": "MOTOCICLISTA", "3-MEDIUM": "CICLISTA", "5-LOW": "PASAJERO", "4-NOT SPECIFIED": "SIN INFORMACION"}
UNLOCATED_REGION = 4
YEARS = tuple(range(1995, 2002))
SCALE = Scale("NATION", 25)

#: Rows of a partition in joins of a few narrow columns, about; a shuffle to over 200 partitions sorts what a task reads, in memory, so not more than they need.
PART_ROWS = 1_500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of `lineitem`, from the files' footers."""
    return read(spark, sf_dir, "lineitem").count()


def meet(rows: DataFrame, table: DataFrame, keys: tuple[str, str], count: int, others: int) -> DataFrame:
    """`rows` (`count` of them) joined with `table` (`others`) on a key of each.

    A table beyond `grid.BROADCAST_ROWS` is merged in partitions of bounded size: the optimiser would broadcast it if its files are small,
    and rows of repeated values take little room there and much in a driver.
    """
    mine, theirs = keys
    if others > grid.BROADCAST_ROWS:
        if parts := crash_partitions(rows.sparkSession, count, PART_ROWS):
            rows, table = rows.repartition(parts, mine), table.repartition(parts, theirs)
        table = table.hint("merge")
    return rows.join(table, F.col(mine) == F.col(theirs))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(AREA_CODE, AREA_NAME): every nation."""
    nation = read(spark, sf_dir, "nation")
    return nation.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("AREA_CODE"), F.col("n_name").alias("AREA_NAME"))


def study(spark: SparkSession, sf_dir: str) -> Study:
    return Study(SCALE, units(spark, sf_dir), YEARS)


def casualties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per affected person: FORMULARIO, CODIGO_ACC, CODIGO_VEH, CONDICION, CLASE_ACC, YEAR, FECHA_OCUR, AREA_CODE, AREA_NAME, CASUALTY_SOURCE, INJURED, KILLED."""
    lines = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    located = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    inside = F.col("n_regionkey") != UNLOCATED_REGION
    crash = meet(orders, located, ("o_custkey", "c_custkey"), orders.count(), customer.count()).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate",
        F.when(inside, F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("AREA_CODE"), F.when(inside, F.col("n_name")).alias("AREA_NAME"))
    parts = crash_partitions(spark, line_count(spark, sf_dir))
    if parts:  # the join's own shuffles, to partitions of bounded size
        lines, crash = lines.repartition(parts, "l_orderkey"), crash.repartition(parts, "o_orderkey").hint("merge")
    discount = F.round("l_discount", 2)
    killed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return lines.join(crash, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("FORMULARIO"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("CODIGO_ACC"),
        F.when(discount == 0.0, None).when(discount == 0.1, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("CODIGO_VEH"),
        lookup(F.col("o_orderpriority"), ROLE_OF_PRIORITY).alias("CONDICION"),
        F.col("o_orderstatus").alias("CLASE_ACC"),
        F.year("o_orderdate").alias("YEAR"),
        F.col("l_shipdate").alias("FECHA_OCUR"),
        "AREA_CODE",
        "AREA_NAME",
        F.when(killed, FATALITY).otherwise(INJURY).alias("CASUALTY_SOURCE"),
        F.when(killed, 0).otherwise(1).alias("INJURED"),
        F.when(killed, 1).otherwise(0).alias("KILLED"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(FORMULARIO, CODIGO_VEHICULO, CLASE): the parts of every order, unharmed ones included, in line order with repeats."""
    part = read(spark, sf_dir, "part").select("p_partkey", lookup(F.col("p_type"), CLASS_OF_PART).alias("CLASE"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    found = meet(lines, part, ("l_partkey", "p_partkey"), line_count(spark, sf_dir), part.count())
    return found.select(F.col("l_orderkey").alias("FORMULARIO"), F.col("l_partkey").alias("CODIGO_VEHICULO"), "CLASE")
