"""Urban predictors: layers measured against every unit as an area share or a point density, and their tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.domains import HIGH_CORRELATION, MEASURED, NOT_MEASURED, Study, declared
from loomgrid.functions.bins import bucket, histogram_edges
from loomgrid.functions.scalars import share
from loomgrid.operators import cells, overlay, spatial
from loomgrid.operators.grid import assert_covered, complete_grid


@dataclass(frozen=True)
class Method:
    """A way of measuring: the geometry it takes, the unit of the raw measure, and of the measure over the unit's area."""

    geometry: str
    measure_unit: str
    value_unit: str


#: Methods, geometry kinds and time coverages.
METHODS = {"area_share": Method("area", "km2", "share of unit area"), "point_density": Method("point", "count", "points per km2"), "line_density": Method("line", "km", "km per km2")}
GEOMETRIES = {"area": ("POLYGON", "MULTIPOLYGON"), "point": ("POINT", "MULTIPOINT"), "line": ("LINESTRING", "MULTILINESTRING")}
COVERAGES = ("snapshot", "annual series")


@dataclass(frozen=True)
class Predictor:
    """A layer's declaration. One that contradicts itself is rejected when it is made."""

    name: str
    label: str
    layer: str
    file: str
    geometry: str
    method: str
    coverage: str = "snapshot"
    zero_is_implausible: bool = False

    def __post_init__(self) -> None:
        for value, allowed in ((self.geometry, GEOMETRIES), (self.method, METHODS), (self.coverage, COVERAGES)):
            if value not in allowed:
                raise ValueError(f"{self.name}: {value!r} is none of {sorted(allowed)}")
        if METHODS[self.method].geometry != self.geometry:
            raise ValueError(f"{self.name}: {self.method} does not measure a layer of kind {self.geometry}")


#: The ten static layers in their declared order, areas first; the last value says whether a zero would be implausible.
_AREAS = (
    ("SIDEWALK_AREA_SHARE", "Sidewalk", "andenes_x_localidad", "andenes_x_localidad.shp", True),
    ("ARTERIAL_ROAD_AREA_SHARE", "Arterial road", "avenidas_corregidas", "avenidas_corregidas.shp", True),
    ("ROADWAY_AREA_SHARE", "Roadway", "calzada_x_localidad", "calzada_x_localidad.shp", True),
    ("URBAN_PARK_AREA_SHARE", "Urban park", "parques_urb", "parques_urb.shp", False),
    ("BRIDGE_AREA_SHARE", "Bridge", "puentes", "puentes.shp", False),
)
_POINTS = (
    ("SITP_BUS_STOP_DENSITY", "SITP bus stops", "Paraderos_SITP", "Paraderos_SITP.shp", False),
    ("SIGNALISED_INTERSECTION_DENSITY", "Signalised junctions", "Red_Semaforica", "Red_Semaforica.shp", False),
    ("PEDESTRIAN_CROSSING_DENSITY", "Pedestrian crossings", "crossings", "crossings.shp", True),
    ("SPEED_CAMERA_DENSITY", "Speed cameras", "camaras_salvavidas_bogota", "Camaras_Salvavidas_Bogota.shp", False),
    ("TRANSMILENIO_STATION_DENSITY", "TransMilenio stations", "estacion_localidad", "estacion_localidad.shp", False),
)
STATIC = tuple(Predictor(n, la, s, f, g, m, "snapshot", z) for rows, g, m in ((_AREAS, "area", "area_share"), (_POINTS, "point", "point_density")) for n, la, s, f, z in rows)

M2_PER_KM2, M_PER_KM = 1e6, 1e3


def _tagged(layer: DataFrame, tags: tuple[str, ...], geometry: str) -> DataFrame:
    return layer.select(F.struct(*tags, "id").alias("id"), geometry)


def area_share(layer: DataFrame, units: DataFrame, tile: float, tags: tuple[str, ...] = ()) -> DataFrame:
    """(AREA_CODE, tags, MEASURE): km2 of the layer inside each unit; features that overlap each other count each."""
    shared = spatial.overlap(_tagged(layer, tags, "rings"), units, tile)
    return shared.groupBy("AREA_CODE", *[F.col(f"id.{t}").alias(t) for t in tags]).agg((F.sum("OVERLAP") / M2_PER_KM2).alias("MEASURE"))


def point_density(layer: DataFrame, units: DataFrame, tile: float, tags: tuple[str, ...] = ()) -> DataFrame:
    """(AREA_CODE, tags, MEASURE): points of the layer within each unit, each part of a multi-point one."""
    located = cells.locate(spatial.explode_points(_tagged(layer, tags, "points")), units, how="inner")
    return located.groupBy("AREA_CODE", *[F.col(f"id.{t}").alias(t) for t in tags]).agg(F.count("*").cast("double").alias("MEASURE"))


def line_density(layer: DataFrame, units: DataFrame, tile: float, tags: tuple[str, ...] = ()) -> DataFrame:
    """(AREA_CODE, tags, MEASURE): km of the layer's lines inside each unit."""
    inside = overlay.line_lengths(_tagged(layer, tags, "rings"), units)
    return inside.groupBy("AREA_CODE", *[F.col(f"id.{t}").alias(t) for t in tags]).agg((F.sum("LENGTH") / M_PER_KM).alias("MEASURE"))


#: Measurement by method; a further method registers here.
MEASUREMENTS: dict[str, Callable[[DataFrame, DataFrame, float, tuple[str, ...]], DataFrame]] = {"area_share": area_share, "point_density": point_density, "line_density": line_density}


def usable(layer: DataFrame) -> DataFrame:
    """Features with a geometry."""
    column = "rings" if "rings" in layer.columns else "points"
    return layer.filter(~spatial.is_empty(F.col(column)))


def measure(layers: dict[str, DataFrame], units: DataFrame, predictors: tuple[Predictor, ...] = STATIC, tile: float = 1000.0, repair: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(AREA_CODE, PREDICTOR, MEASURE) of every declared layer, where it reaches a unit. Layers of one method are measured together, in one join with the units.

    `repair` gets the polygons of all layers at once, (PREDICTOR, id, rings), and gives valid ones.
    """
    parts = []
    for method, geometry in (("area_share", "rings"), ("point_density", "points"), ("line_density", "rings")):
        own = [usable(layers[p.name]).select(F.lit(p.name).alias("PREDICTOR"), "id", geometry) for p in predictors if p.method == method]
        if own:
            features = reduce(DataFrame.unionByName, own)
            features = repair(features) if repair and method == "area_share" else features
            parts.append(MEASUREMENTS[method](features, units, tile, ("PREDICTOR",)))
    return reduce(DataFrame.unionByName, parts).select("AREA_CODE", "PREDICTOR", "MEASURE")


def dictionary(spark: SparkSession, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """The declarations as a table: what the numbers mean and where they come from."""
    rows = [(p.name, i, p.label, p.geometry, p.layer, p.file, METHODS[p.method].measure_unit, METHODS[p.method].value_unit, p.coverage, p.zero_is_implausible) for i, p in enumerate(predictors)]
    return declared(spark, rows, "PREDICTOR string, PREDICTOR_RANK int, PREDICTOR_LABEL string, PREDICTOR_FAMILY string, SOURCE_LAYER string, SOURCE_FILE string, MEASURE_UNIT string, VALUE_UNIT string, TIME_COVERAGE string, ZERO_IS_IMPLAUSIBLE boolean")


def long_table(measured: DataFrame, study: Study, areas: DataFrame, predictors: tuple[Predictor, ...] = STATIC, check: bool = True) -> DataFrame:
    """Every unit by every predictor. A unit that the layer does not reach is a measured zero; one without a usable area is not measured, and null.

    `areas` has (AREA_CODE, AREA_UNIT_KM2).
    """
    spark = measured.sparkSession
    grid = complete_grid(study.units.join(areas, "AREA_CODE", "left"), dictionary(spark, predictors))
    if check:
        assert_covered(measured, grid, ["AREA_CODE", "PREDICTOR"])
    known = F.coalesce(F.col("AREA_UNIT_KM2") > 0, F.lit(False))
    joined = grid.join(measured, ["AREA_CODE", "PREDICTOR"], "left").withColumn("MEASURE", F.when(known, F.coalesce(F.col("MEASURE"), F.lit(0.0))))
    return joined.select(
        F.lit(study.scale.label).alias("SCALE"), "AREA_CODE", "AREA_NAME", "AREA_UNIT_KM2", F.lit(None).cast("int").alias("YEAR"), "PREDICTOR", "PREDICTOR_FAMILY", "MEASURE", "MEASURE_UNIT",
        share(F.col("MEASURE"), F.col("AREA_UNIT_KM2")).alias("VALUE"), "VALUE_UNIT", F.when(known, MEASURED).otherwise(NOT_MEASURED).alias("VALUE_STATUS")).orderBy("AREA_CODE", "PREDICTOR")


def names(predictors: tuple[Predictor, ...] = STATIC) -> list[str]:
    return [p.name for p in predictors]


def wide_table(long: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """One row per unit, one column per predictor; a cell that was not measured stays null."""
    identity = ["SCALE", "AREA_CODE", "AREA_NAME", "AREA_UNIT_KM2"]
    return long.groupBy(*identity).pivot("PREDICTOR", names(predictors)).agg(F.max("VALUE")).orderBy("AREA_CODE")


def _pearson(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 0, F.covar_samp(x, y) / spread)


def correlations(wide: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """(PREDICTOR_A, PREDICTOR_B, CORRELATION) for every unordered pair, from one aggregation; null where one of the two does not vary."""
    pairs = list(combinations(names(predictors), 2))
    one = wide.agg(*[_pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("PREDICTOR_A"), F.lit(b).alias("PREDICTOR_B"), F.col(f"c{i}").alias("CORRELATION")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def correlation_matrix(pairs: DataFrame, wide: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """(PREDICTOR_A, PREDICTOR_B, CORRELATION) for every ordered pair and each predictor with itself: 1, or null where it does not vary."""
    own = wide.agg(*[F.when(F.stddev_samp(c) > 0, 1.0).alias(c) for c in names(predictors)])
    diagonal = own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("PREDICTOR_A"), F.lit(c).alias("PREDICTOR_B"), F.col(c).alias("CORRELATION")) for c in names(predictors)])))
    turned = pairs.select(F.col("PREDICTOR_B").alias("PREDICTOR_A"), F.col("PREDICTOR_A").alias("PREDICTOR_B"), "CORRELATION")
    return pairs.unionByName(turned).unionByName(diagonal)


def high_correlations(pairs: DataFrame, least: float = HIGH_CORRELATION) -> DataFrame:
    return pairs.filter(F.abs("CORRELATION") >= least).orderBy(F.abs("CORRELATION").desc(), "PREDICTOR_A", "PREDICTOR_B")


def summary(long: DataFrame) -> DataFrame:
    """Per predictor: units measured, not measured and at zero, and how values are spread."""
    v = F.col("VALUE")
    return long.groupBy("PREDICTOR", "PREDICTOR_FAMILY", "VALUE_UNIT", "MEASURE_UNIT").agg(
        F.count_if(F.col("VALUE_STATUS") == MEASURED).alias("UNITS_MEASURED"), F.count_if(F.col("VALUE_STATUS") != MEASURED).alias("UNITS_NOT_MEASURED"), F.count_if(v == 0).alias("UNITS_AT_ZERO"),
        F.min(v).alias("MINIMUM"), F.median(v).alias("MEDIAN"), F.max(v).alias("MAXIMUM"), F.avg(v).alias("MEAN"), F.stddev_samp(v).alias("STD_DEV"), F.sum("MEASURE").alias("TOTAL_MEASURE"))


def zeros(long: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """Units at zero per predictor, and whether a zero there would mean that the measurement failed."""
    marks = dictionary(long.sparkSession, predictors).select("PREDICTOR", F.when(F.col("ZERO_IS_IMPLAUSIBLE"), "IMPLAUSIBLE").otherwise("MEASURED ZERO").alias("READING"))
    return long.filter("VALUE = 0").groupBy("PREDICTOR").agg(F.count("*").alias("UNITS_AT_ZERO")).join(F.broadcast(marks), "PREDICTOR")


def zero_report(long: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """`zeros` with the units themselves, code and name, in one text for reading: at most a roster's."""
    which = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "AREA_CODE", "AREA_NAME"))), ", ").alias("UNITS")
    return zeros(long, predictors).join(long.filter("VALUE = 0").groupBy("PREDICTOR").agg(which), "PREDICTOR")


def scaled(wide: DataFrame, predictors: tuple[Predictor, ...] = STATIC) -> DataFrame:
    """Each column stretched to [0, 1]; a column of one value lies at one half."""
    whole = Window.partitionBy()  # one row a unit
    out = {}
    for c in names(predictors):
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        out[c] = F.when(F.col(c).isNull(), None).when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)
    return wide.withColumns(out)


def histogram(values: DataFrame, column: str) -> DataFrame:
    """(BIN, BIN_LOW, BIN_HIGH, UNITS) over round edges; bins without a unit are there with 0."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    cuts = histogram_edges(low, high)
    bins = declared(values.sparkSession, [(i, cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)], "BIN int, BIN_LOW double, BIN_HIGH double")
    counted = values.groupBy(bucket(F.col(column), cuts).alias("BIN")).agg(F.count("*").alias("n"))
    return bins.join(counted, "BIN", "left").select("BIN", "BIN_LOW", "BIN_HIGH", F.coalesce("n", F.lit(0)).alias("UNITS"))
