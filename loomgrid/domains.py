"""Closed vocabularies, their order, and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Actor types from the least to the most protected, the residual one last; and the counterpart of a lone party.
PEDESTRIAN, BICYCLE, MOTORCYCLE, CAR, PUBLIC_TRANSPORT, OTHER = TYPES = ("PEDESTRIAN", "BICYCLE", "MOTORCYCLE", "CAR", "PUBLIC_TRANSPORT", "OTHER")
SELF = "SELF"
COUNTERPARTS = (*TYPES, SELF)
RANK = {t: i for i, t in enumerate(TYPES)}

#: Vehicle classes, normalised, by actor type.
VEHICLE_CLASSES = {
    PEDESTRIAN: ("PEATON",),
    BICYCLE: ("BICICLETA", "BICITAXI"),
    MOTORCYCLE: ("MOTOCICLETA", "MOTOCICLO", "MOTOTRICICLO", "MOTOCARRO", "CUATRIMOTO"),
    CAR: ("AUTOMOVIL", "CAMIONETA", "CAMPERO"),
    PUBLIC_TRANSPORT: ("BUS", "BUSETA", "MICROBUS", "BUS ARTICULADO", "BUS ALIMENTADOR"),
    OTHER: (
        "CAMION, FURGON", "TRACTOCAMION", "VOLQUETA", "M. INDUSTRIAL", "M. AGRICOLA", "METRO", "TREN", "REMOLQUE", "SEMI-REMOLQUE", "OTRO", "AMBULACIA", "AMBULANCIA",
        "TRACCION ANIMAL", "NO IDENTIFICADO",
    ),
}
TYPE_OF_CLASS = {c: t for t, classes in VEHICLE_CLASSES.items() for c in classes}
#: Roles that settle a casualty's type when no vehicle does; any other role is residual.
TYPE_OF_ROLE = {"PEATON": PEDESTRIAN, "MOTOCICLISTA": MOTORCYCLE, "CICLISTA": BICYCLE, "CONDUCTOR": OTHER, "PASAJERO": OTHER}

#: Limits and thresholds.
MAX_PARTIES = 2
THIN_SHARE = 0.5
JUMP, SPARSE = 0.10, 10
HIGH_CORRELATION = 0.7
MIN_RATE_SHARE = 0.5
SNAP_METRES = 5.0

#: The modes that impose the risk, and those they are paired with.
PRIMARY, SECONDARY = (MOTORCYCLE, CAR, PUBLIC_TRANSPORT), TYPES[:-1]


#: Every two modes of which one is primary, in the order of the vocabulary.
PAIRS = tuple(pair for pair in combinations(SECONDARY, 2) if not set(PRIMARY).isdisjoint(pair))
PAIR_LABELS = tuple("-".join(p) for p in PAIRS)
#: Short names for pair labels.
SHORT = {PEDESTRIAN: "PED", BICYCLE: "BIC", MOTORCYCLE: "MOT", CAR: "CAR", PUBLIC_TRANSPORT: "PUB"}

UNIT_LEVEL, CITY_LEVEL = "UNIT", "CITY"
MEASURED, NOT_MEASURED = "MEASURED", "NOT_MEASURED"
FATALITY, INJURY = "FATALITY", "INJURY"


@dataclass(frozen=True)
class Scale:
    """A roster of territorial units under one label. (label, unit code) is the only safe key of a unit."""

    label: str
    units: int


@dataclass(frozen=True)
class Study:
    """What a complete grid is made of: a scale, its units (AREA_CODE, AREA_NAME), the years, and the code and name of the whole city."""

    scale: Scale
    units: DataFrame
    years: tuple[int, ...]
    city_code: str = "CITY"
    city_name: str = "Whole city"


def declared(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A small table of declared values. It is a local relation, whose size the optimiser knows: crossed or joined, it is broadcast."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow_schema(schema)), schema)


def ranked(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    """(name, name_RANK): a vocabulary as a table in declared order."""
    return declared(spark, [(v, i) for i, v in enumerate(values)], f"{name} string, {name}_RANK int")


def pairs_table(spark: SparkSession) -> DataFrame:
    """(PAIR, PAIR_TYPE_A, PAIR_TYPE_B, PAIR_RANK)."""
    return declared(spark, [("-".join(p), *p, i) for i, p in enumerate(PAIRS)], "PAIR string, PAIR_TYPE_A string, PAIR_TYPE_B string, PAIR_RANK int")
