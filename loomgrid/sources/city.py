"""The data model over a city's own files, declared in `city.json` in a folder that all machines see.

Layers are shapefiles, or Parquet with well-known binary, in degrees; vehicles and an updated extract are CSV. Everything is brought to metres, casualties are located in the roster's units,
and what comes out has the columns of the adapter to the star-schema tables, so the routes run over either.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.domains import FATALITY, INJURY, Scale, Study
from loomgrid.functions.projection import project_points, project_rings, to_plane
from loomgrid.functions.scalars import text_key, utc_timestamp
from loomgrid.operators import cells, grid, integrate, predictors, spatial, validity
from loomgrid.sources import readers, shapefile, wkb

DECLARATION = "city.json"


#: What a load is verified by: counts of the source files, and counts that depend on where a roster's units lie.
SOURCE_COUNTS, FOOTPRINT_COUNTS = ("fatalities", "injuries", "casualties", "vehicles"), ("fatalities_unlocated", "injuries_unlocated")


class DeclarationError(ValueError):
    """A `city.json` that contradicts itself."""


@dataclass(frozen=True)
class Territory:
    """A roster of units that the study can be made on: its size, its layer under the folder, and the fields of code and name."""

    size: int
    units: str
    code: str
    name: str


@dataclass(frozen=True)
class City:
    """Where a city's files lie under its folder, its rosters and the one in use, its years, and the year that the extract replaces.

    `scale` names one of `scales`, which maps labels to what `Territory` holds; or, with one roster only, it is (label, size) beside `units`, `code` and `name`.
    `edition` names the extract that the layers come from. `baselines` holds by edition the counts that a load must reproduce: `counts`, those of the
    source files, and `scales`, by label those that depend on the roster. What is not declared there is a first measurement.
    """

    scale: str | tuple[str, int]
    years: tuple[int, int]
    fatalities: str
    injuries: str
    vehicles: str
    units: str = ""
    code: str = ""
    name: str = ""
    extract: str = ""
    replaced: int = 0
    predictors: str = "predictors"
    scales: dict[str, dict] = field(default_factory=dict)
    edition: str = "original"
    baselines: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.scale, str) and self.scale not in self.scales:
            raise DeclarationError(f"scale {self.scale!r} is none of {sorted(self.scales)}")
        for edition, given in self.baselines.items():
            for kind, counts, allowed in (("counts", given.get("counts", {}), SOURCE_COUNTS), *((f"scale {k}", v, FOOTPRINT_COUNTS) for k, v in given.get("scales", {}).items())):
                if set(counts) - set(allowed):
                    raise DeclarationError(f"baseline of {edition}, {kind}: {sorted(set(counts) - set(allowed))} are none of {allowed}")

    @property
    def in_use(self) -> Scale:
        return Scale(self.scale, self.territory.size) if isinstance(self.scale, str) else Scale(*self.scale)

    @property
    def territory(self) -> Territory:
        return Territory(**self.scales[self.scale]) if isinstance(self.scale, str) else Territory(self.scale[1], self.units, self.code, self.name)


def is_city(root: str) -> bool:
    return (Path(root) / DECLARATION).exists()


def city(root: str) -> City:
    given = json.loads((Path(root) / DECLARATION).read_text())
    return City(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def baseline(root: str) -> dict[str, int]:
    """The counts that a load of the edition and roster in use must reproduce; those of another edition or roster never count."""
    c = city(root)
    own = c.baselines.get(c.edition, {})
    return own.get("counts", {}) | own.get("scales", {}).get(c.in_use.label, {})


def layer(spark: SparkSession, path: str, kinds: tuple[str, ...], owner: str) -> DataFrame:
    """A declared layer, by its suffix: .shp is a shapefile, anything else Parquet whose column `geometry` is well-known binary.

    A missing file is an error that names who declares it, and so is a geometry of another kind.
    """
    if not Path(path).exists():
        raise FileNotFoundError(f"{owner}: the declared source {path} does not exist")
    if Path(path).suffix.lower() == ".shp":
        shapefile.register(spark)
        found = spark.read.format("shapefile").load(path)
    else:
        found = wkb.decode(spark.read.parquet(path))
    spatial.assert_geometry(found, kinds)
    return found


def roster(spark: SparkSession, root: str) -> DataFrame:
    """(AREA_CODE, AREA_NAME, rings) in metres."""
    c = city(root)
    own = c.territory
    found = layer(spark, f"{root}/{own.units}", predictors.GEOMETRIES["area"], "units")
    return readers.territorial_units(found, c.in_use, own.code, own.name).withColumn("rings", project_rings(F.col("rings")))


def units(spark: SparkSession, root: str) -> DataFrame:
    return roster(spark, root).drop("rings")


def study(spark: SparkSession, root: str) -> Study:
    c = city(root)
    return Study(c.in_use, units(spark, root), years(root))


def years(root: str) -> tuple[int, ...]:
    first, last = city(root).years
    return tuple(range(first, last + 1))


def _located(people: DataFrame, roster_units: DataFrame, killed: Column) -> DataFrame:
    """People (x, y in degrees) with their unit; a person without a point, or outside all units, is in none and stays."""
    east, north = to_plane(F.col("x"), F.col("y"))
    placed = cells.locate(people.withColumns({"LON": F.col("x"), "LAT": F.col("y"), "x": east, "y": north}), roster_units).drop("x", "y")
    names = grid.bounded(roster_units.select("AREA_CODE", "AREA_NAME"))
    return placed.join(names, "AREA_CODE", "left").select(
        "FORMULARIO", "CODIGO_ACC", F.col("CODIGO_VEH").cast("double").alias("CODIGO_VEH"), "CONDICION", "CLASE_ACC", "YEAR", "FECHA_OCUR", "AREA_CODE", "AREA_NAME",
        F.when(killed, FATALITY).otherwise(INJURY).alias("CASUALTY_SOURCE"), F.when(killed, 0).otherwise(1).alias("INJURED"), F.when(killed, 1).otherwise(0).alias("KILLED"), "LON", "LAT")


def casualties(spark: SparkSession, root: str) -> DataFrame:
    """Both casualty layers as one table."""
    c, within = city(root), roster(spark, root)
    parts = []
    for file, killed in ((c.fatalities, True), (c.injuries, False)):
        raw = layer(spark, f"{root}/{file}", predictors.GEOMETRIES["point"], FATALITY if killed else INJURY)
        at = F.get("points", F.lit(0))
        narrow = raw.select(
            text_key(F.col("FORMULARIO")).alias("FORMULARIO"), text_key(F.col("CODIGO_ACC")).alias("CODIGO_ACC"), F.col("CODIGO_VEH").try_cast("double").alias("CODIGO_VEH"), "CONDICION", "CLASE_ACC",
            F.col("YEAR" if "YEAR" in raw.columns else "ANO_OCURRE").try_cast("int").alias("YEAR"), utc_timestamp(F.col("FECHA_OCUR")).alias("FECHA_OCUR"), at["x"].alias("x"), at["y"].alias("y"))
        parts.append(_located(narrow, within, F.lit(killed)))
    return parts[0].unionByName(parts[1])


def vehicles(spark: SparkSession, root: str) -> DataFrame:
    return readers.vehicles_csv(spark, f"{root}/{city(root).vehicles}").withColumn("FORMULARIO", text_key(F.col("FORMULARIO")))


def extract(spark: SparkSession, root: str) -> DataFrame:
    """The updated extract of one year, both severities, located, with PERSON."""
    raw = readers.extract_csv(spark, f"{root}/{city(root).extract}")
    fatal, injured = integrate.split_by_severity(raw)
    within = roster(spark, root)
    both = _located(fatal, within, F.lit(True)).unionByName(_located(injured, within, F.lit(False)))
    return both.withColumn("PERSON", F.col("CODIGO_ACC"))


def as_layer(people: DataFrame) -> DataFrame:
    """A casualty table with its points, in degrees, as well-known binary, so that a written layer can be declared as a source in turn."""
    at = F.struct(F.col("LON").alias("x"), F.col("LAT").alias("y"))
    some = F.col("LON").isNotNull() & F.col("LAT").isNotNull()
    shaped = people.withColumns({"geom_type": F.when(some, "POINT"), "points": F.when(some, F.array(at)), "rings": F.lit(None).cast(spatial.RINGS)})
    return wkb.encode(shaped.drop("LON", "LAT"))


def replaced(root: str) -> int:
    return city(root).replaced


def predictor_path(root: str, p: predictors.Predictor) -> str:
    """The path of a predictor's layer, built from its declaration alone."""
    return f"{root}/{city(root).predictors}/{p.layer}/{p.file}"


def predictor_layers(spark: SparkSession, root: str, declared: tuple[predictors.Predictor, ...] = predictors.STATIC) -> dict[str, DataFrame]:
    """Every declared layer in metres: (id, rings or points)."""
    layers = {}
    for p in declared:
        raw = layer(spark, predictor_path(root, p), predictors.GEOMETRIES[p.geometry], p.name).withColumn("id", F.monotonically_increasing_id())
        layers[p.name] = raw.select("id", project_rings(F.col("rings")).alias("rings")) if p.geometry != "point" else raw.select("id", project_points(F.col("points")).alias("points"))
    return layers


def predictor_table(spark: SparkSession, root: str, work: str, declared: tuple[predictors.Predictor, ...] = predictors.STATIC, tile: float = 1000.0) -> tuple[DataFrame, Study]:
    """The long table of predictors over the city's roster, whose areas come from its own geometry, and its study.

    Features, repaired polygons and measures are written to the folder `work` and read from there, as each is used several times: shapefiles are read once.
    """

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}.parquet")
        return spark.read.parquet(f"{work}/{name}.parquet")

    def repair(features: DataFrame) -> DataFrame:
        tagged = written(features.select(F.struct("PREDICTOR", "id").alias("id"), "rings"), "area_features")
        return written(validity.repaired(tagged), "area_features_repaired").select("id.PREDICTOR", "id.id", "rings")

    within = roster(spark, root)
    areas = within.select("AREA_CODE", (spatial.area(F.col("rings")) / predictors.M2_PER_KM2).alias("AREA_UNIT_KM2"))
    found = Study(city(root).in_use, within.drop("rings"), ())
    measured = written(predictors.measure(predictor_layers(spark, root, declared), within, declared, tile, repair), "measures")
    return predictors.long_table(measured, found, areas, declared), found


def missing_sources(root: str, declared: tuple[predictors.Predictor, ...] = predictors.STATIC) -> list[str]:
    return [p.name for p in declared if not Path(predictor_path(root, p)).exists()]
