"""Declarative checks: each a (name, ok, detail) row of one table, from few aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.domains import CITY_LEVEL, MEASURED, PAIRS, Study
from loomgrid.operators import matrix as m
from loomgrid.operators import predictors as p

Check = tuple[str, bool, str]


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables hold the same values."""
    return a.distinct().exceptAll(b.distinct()).isEmpty() and b.distinct().exceptAll(a.distinct()).isEmpty()


def loading(counts: dict[str, int], expected: dict[str, int] | None) -> list[Check]:
    """Counts against a baseline; without one this is a first measurement, which is no failure."""
    return [(k, expected is None or k not in expected or expected[k] == v, f"{v}, FIRST MEASUREMENT" if expected is None or k not in expected else f"{v} against {expected[k]}") for k, v in counts.items()]


def matrix(long: DataFrame, affected: DataFrame, study: Study) -> list[Check]:
    t = long.agg(*[F.sum(c).alias(c) for c in m.COUNTS], F.count("*").alias("rows"), F.count_if(F.least(*m.COUNTS) < 0).alias("negative"), F.count_if(F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") < F.col("AFFECTED_PARTIES")).alias("few")).first()
    s = m.located(affected).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in m.COUNTS]).first()
    want = study.scale.units * len(study.years) * len(m.TYPES) * len(m.COUNTERPARTS)
    return [
        *[(f"{c} preserved", t[c] == s[c], f"{t[c]} of {s[c]}") for c in m.COUNTS],
        ("no negative count", t.negative == 0, str(t.negative)),
        ("persons at least parties", t.few == 0, str(t.few)),
        ("units of the roster", same_set(long.select("AREA_CODE"), study.units.select("AREA_CODE")), ""),
        ("years of the study", {r[0] for r in long.select("YEAR").distinct().collect()} == set(study.years), ""),
        ("complete grid", t["rows"] == want, f"{t['rows']} of {want}"),
    ]


def rho(long: DataFrame, crashes: DataFrame, study: Study) -> list[Check]:
    n, d, r = F.col("CRASHES_BOTH_AFFECTED"), F.col("CRASHES_TOTAL"), F.col("RHO")
    city = F.col("AGGREGATION_LEVEL") == CITY_LEVEL
    t = long.agg(F.count_if(n > d).alias("over"), F.count_if((r < 0) | (r > 1)).alias("out"), F.count_if(r.isNotNull() != (d > 0)).alias("undefined"), F.sum(F.when(city, d)).alias("city"), F.count("*").alias("rows")).first()
    by_year = long.groupBy("YEAR").agg(F.sum(F.when(city, d)).alias("c"), F.sum(F.when(~city, d)).alias("u"), F.sum(F.when(city, n)).alias("cn"), F.sum(F.when(~city, n)).alias("un"))
    total, want = crashes.count(), (study.scale.units + 1) * len(study.years) * len(PAIRS)
    return [
        ("numerator within denominator", t.over == 0, str(t.over)),
        ("rho in [0, 1]", t.out == 0, str(t.out)),
        ("rho defined where there are crashes", t.undefined == 0, str(t.undefined)),
        ("units sum to the city", by_year.filter("c <> u or cn <> un").isEmpty(), ""),
        ("crashes preserved", t.city == total, f"{t.city} of {total}"),
        ("complete grid", t["rows"] == want, f"{t['rows']} of {want}"),
    ]


def predictors(long: DataFrame, wide: DataFrame, correlations: DataFrame, study: Study, declared: tuple[p.Predictor, ...] = p.STATIC) -> list[Check]:
    v, x, a, s = F.col("VALUE"), F.col("MEASURE"), F.col("AREA_UNIT_KM2"), F.col("VALUE_STATUS")
    t = long.agg(
        F.count("*").alias("rows"), F.count_if((x < 0) | (v < 0)).alias("negative"), F.count_if((F.col("PREDICTOR_FAMILY") == "area") & (v > 1 + 1e-9)).alias("over"),
        F.count_if(F.abs(v - x / F.nullif(a, F.lit(0.0))) > 1e-12).alias("quotient"), F.count_if((s == MEASURED) != v.isNotNull()).alias("status"), F.count_if(F.col("YEAR").isNotNull()).alias("dated")).first()
    c = correlations.agg(F.count_if(F.abs("CORRELATION") > 1 + 1e-9).alias("out"), F.count("*").alias("n")).first()
    k = len(declared)
    names = [q.name for q in declared]
    return [
        ("complete grid", t["rows"] == study.scale.units * k, str(t["rows"])),
        ("nothing negative", t.negative == 0, str(t.negative)),
        ("shares at most 1", t.over == 0, str(t.over)),
        ("value is measure by area", t.quotient == 0, str(t.quotient)),
        ("a value where measured", t.status == 0, str(t.status)),
        ("a snapshot has no year", t.dated == 0, str(t.dated)),
        ("wide shape", wide.count() == study.scale.units and wide.columns[-k:] == names, ""),
        ("every pair of predictors", c.n == k * (k - 1) // 2, str(c.n)),
        ("correlations in [-1, 1]", c.out == 0, str(c.out)),
        ("units of the roster", same_set(long.select("AREA_CODE"), study.units.select("AREA_CODE")), ""),
        ("predictors as declared", {r[0] for r in long.select("PREDICTOR").distinct().collect()} == set(names), ""),
    ]


def symmetry(square: DataFrame) -> list[Check]:
    """A square table of correlations mirrors itself and has ones (or nothing, where a predictor does not vary) on its diagonal."""
    a, b = F.col("PREDICTOR_A"), F.col("PREDICTOR_B")
    each = square.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(
        F.count("*").alias("n"), F.count("CORRELATION").alias("known"), (F.max("CORRELATION") - F.min("CORRELATION")).alias("gap"), F.max("CORRELATION").alias("most"))
    own = F.col("low") == F.col("high")
    skewed = ~own & ((F.col("n") != 2) | ~F.col("known").isin(0, 2) | (F.coalesce("gap", F.lit(0.0)) > 0))
    t = each.agg(F.count_if(own & ((F.col("n") != 1) | (F.abs(F.col("most") - 1) > 1e-9))).alias("diagonal"), F.count_if(skewed).alias("skewed")).first()
    return [("correlation diagonal is 1", t.diagonal == 0, str(t.diagonal)), ("correlations are symmetric", t.skewed == 0, str(t.skewed))]


def dictionary(described: DataFrame, long: DataFrame, wide: DataFrame) -> list[Check]:
    """The dictionary against the tables that it describes, all three as they were exported."""
    measures = ["PREDICTOR", "MEASURE_UNIT", "VALUE_UNIT"]
    known = {r[0] for r in described.select("PREDICTOR").collect()}  # declared, one row each
    odd = long.select(*measures).distinct().join(F.broadcast(described.select(*measures)), measures, "left_anti").limit(20).collect()
    bare = sorted(known - set(wide.columns))
    return [
        ("dictionary and measured predictors agree", same_set(described.select("PREDICTOR"), long.select("PREDICTOR")), ""),
        ("dictionary covers the wide table", not bare and len(known) == len(wide.columns) - 4, f"not in the table: {bare}"),
        ("dictionary and tables agree on units", not odd, str(sorted(r.PREDICTOR for r in odd))),
    ]


def sources(missing: list[str], declared: int) -> list[Check]:
    return [("every declared source exists", not missing, f"{declared - len(missing)} of {declared}" + (f", not {missing}" if missing else ""))]


def people(universe: DataFrame, casualties: DataFrame, kept: DataFrame) -> list[Check]:
    """Every person is in a party kept or in a crash discarded."""
    both = F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED")
    total = casualties.agg(F.coalesce(F.sum(F.col("INJURED") + F.col("KILLED")), F.lit(0))).first()[0]
    inside = kept.agg(F.coalesce(F.sum(both), F.lit(0))).first()[0]
    discarded = universe.join(kept.select("FORMULARIO").distinct(), "FORMULARIO", "left_anti").agg(F.coalesce(F.sum(both), F.lit(0))).first()[0]
    return [("people balance", inside + discarded == total, f"{inside} kept and {discarded} discarded of {total}")]


def silent_crashes(resolved: DataFrame, affected: DataFrame) -> DataFrame:
    """Crashes with parties but nobody emitted: their casualties were lost on the way."""
    return resolved.select("FORMULARIO").distinct().join(affected.select("FORMULARIO"), "FORMULARIO", "left_anti")


def table(spark, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame(checks, "CHECK string, OK boolean, DETAIL string")
