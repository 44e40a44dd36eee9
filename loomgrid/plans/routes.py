"""The seven routes: `python -m loomgrid.plans.routes ROUTE FOLDER OUT [--dump]`.

FOLDER holds a city's own files if it has a `city.json`, else the star-schema tables.

A route returns its ledger and checks; a failed check or an unbalanced stage ends it with an error after its report is written.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import queries as q
from loomgrid.domains import FATALITY, INJURY
from loomgrid.ledger import Ledger
from loomgrid.operators import checks, completeness, integrate, matrix, parties, predictors, rho
from loomgrid.operators.grid import assert_covered, assert_unique
from loomgrid.plans import sinks
from loomgrid.sources import adapter, city
from loomgrid.sources.readers import loading_counts


class RouteFailed(RuntimeError):
    """A check of the route failed."""


@dataclass
class Outcome:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    ledger: Ledger = field(default_factory=Ledger)
    checks: list[checks.Check] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    intermediates: dict[str, DataFrame] = field(default_factory=dict)
    exported: Callable[[Callable[[str], str]], list[checks.Check]] | None = None  # checks that reread exports, given the path of a table's CSV


Route = Callable[[SparkSession, str, str, Outcome], None]
ROUTES: dict[str, Route] = {}


def route(f: Route) -> Route:
    ROUTES[f.__name__] = f
    return f


def _model(folder: str):
    """Where a folder's casualties, vehicles, units and study come from."""
    return city if city.is_city(folder) else adapter


def _years(folder: str) -> tuple[int, ...]:
    return city.years(folder) if city.is_city(folder) else adapter.YEARS


def _load(spark: SparkSession, sf_dir: str, out: Outcome) -> tuple[DataFrame, DataFrame]:
    model = _model(sf_dir)
    people, vehicles = model.casualties(spark, sf_dir), model.vehicles(spark, sf_dir)
    parties.assert_crash_ids(people)
    out.checks += checks.loading(loading_counts(people, vehicles).first().asDict(), city.baseline(sf_dir) if city.is_city(sf_dir) else None)
    return people, vehicles


def _universe(people: DataFrame, vehicles: DataFrame) -> DataFrame:
    return parties.party_universe(people, vehicles, parties.person_ids_usable(people)).cache()  # matrix, rho and reports share it


@route
def loading(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    _load(spark, sf_dir, out)
    out.tables["units"] = _model(sf_dir).units(spark, sf_dir)


def _parties(spark: SparkSession, sf_dir: str, out: Outcome) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    people, vehicles = _load(spark, sf_dir, out)
    universe, attributes = _universe(people, vehicles), parties.crash_attributes(people)
    resolved = parties.resolve_counterparts(universe)
    affected = parties.affected_parties(resolved, attributes)
    size = parties.with_party_count(universe).agg(F.count("*").alias("all"), F.count_if(F.col("PARTIES") > 2).alias("over"), F.count_if((F.col("PARTIES") <= 2) & (F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") == 0)).alias("unhurt")).first()
    out.ledger.settle("two-party threshold", size["all"], size["all"] - size.over, {"parties of crashes with more than two": -size.over})
    affected, emitted = out.ledger.watch(affected, rows=F.count("*"))
    out.ledger.later("emit affected parties", lambda again: (size["all"] - size.over, emitted(again)["rows"], {"parties without a casualty": -size.unhurt}))
    out.checks += checks.people(universe, people, resolved)
    out.intermediates |= {"party_universe": universe, "resolved_counterparts": resolved}
    return people, universe, attributes, affected


@route
def affected(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    _, universe, attributes, found = _parties(spark, sf_dir, out)
    out.tables |= {"affected_parties": found, "frequencies": matrix.frequencies(found), "threshold_composition": parties.threshold_composition(universe, attributes), "divergence": parties.divergence(found)}


@route
def casualty_matrix(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    _, _, _, found = _parties(spark, sf_dir, out)
    found = sinks.staged(found, folder, "affected_parties")
    study = _model(sf_dir).study(spark, sf_dir)
    long = matrix.long_table(found, study).cache()
    assert_covered(matrix.cells(found), matrix.grid(study), matrix.KEYS)
    out.checks += checks.matrix(long, found, study)
    out.tables["matrix_long"] = long
    for count in matrix.COUNTS:
        out.tables[f"crosstab_{count.lower()}"] = matrix.crosstab(long, count)
        for year in study.years:
            out.tables[f"by_year_{count.lower()}_{year}"] = matrix.crosstab(long, count, year)
    out.tables |= {"yearly_totals": matrix.yearly_totals(long), "empty_by_unit": matrix.emptiness(long, "AREA_CODE"), "empty_by_year": matrix.emptiness(long, "YEAR"), "counterpart_shares": matrix.counterpart_shares(long), "colour_range": matrix.colour_range(long)}
    out.tables |= {f"shaded_{count.lower()}": matrix.shaded(long, count) for count in matrix.COUNTS}


@route
def rho_table(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    people, vehicles = _load(spark, sf_dir, out)
    universe, study = _universe(people, vehicles), _model(sf_dir).study(spark, sf_dir)
    pairs = rho.crash_pairs(universe)
    # Counted while the crashes are placed: how many there are for each reason, and how many of those kept have a unit.
    pairs, reasons = out.ledger.watch(pairs, **{r: F.count_if(rho.reason() == r) for r in rho.REASONS})
    restricted, whole = out.ledger.watch(rho.with_attributes(rho.restrict(pairs), parties.crash_attributes(people)), located=F.count("AREA_CODE"), lost=F.count_if(F.col("AREA_CODE").isNull()))
    located = sinks.staged(restricted.filter("AREA_CODE is not null"), folder, "located_crashes")

    def restriction(again: bool) -> tuple[int, int, dict[str, int]]:
        n = reasons(again)
        return sum(n.values()), n[rho.KEPT], {k: -v for k, v in n.items() if k != rho.KEPT}

    out.ledger.later("restrict to the pairs", restriction)
    out.ledger.later("located crashes", lambda again: (reasons(again)[rho.KEPT], whole(again)["located"], {"crashes in no unit": -whole(again)["lost"]}))
    long = rho.long_table(located, study).cache()
    assert_unique(long, ["AGGREGATION_LEVEL", "AREA_CODE", "YEAR", "PAIR"])  # the pivots below keep one value a cell
    out.checks += checks.rho(long, located, study)
    out.tables |= {"rho_long": long, "rho_city": rho.city_table(long), "rho_city_crashes": rho.city_table(long, "CRASHES_TOTAL"), "rho_jumps": rho.jumps(long), "rho_sparse": rho.sparse_cells(long), "rho_lines": rho.lines(long), "rho_gaps": rho.gaps(long), "rho_pooled": rho.pooled_and_mean(long)}


@route
def coverage(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    people = _model(sf_dir).casualties(spark, sf_dir)
    table = completeness.monthly_table(people, _years(sf_dir)).cache()
    out.tables |= {"completeness": table, "flagged_months": completeness.flagged(table), "yearly_change": completeness.yearly_change(table), "trailing_empty": completeness.trailing_empty(table), "dates": completeness.date_profile(people)}


def _extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The updated extract with PERSON, and the year it replaces."""
    return (city.extract(spark, sf_dir), city.replaced(sf_dir)) if city.is_city(sf_dir) else (q._incoming(spark, sf_dir), q.REPLACED)


@route
def integration(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    """Both layers with the year replaced, written under the run's folder and never beside their source."""
    model = _model(sf_dir)
    people, vehicles, (incoming, year) = model.casualties(spark, sf_dir), model.vehicles(spark, sf_dir), _extract(spark, sf_dir)
    integrate.assert_single_year(incoming, year)
    before = people.filter(F.col("YEAR") == year - 1)
    integrate.assert_rate(integrate.reference_rate(incoming, vehicles), integrate.reference_rate(before, vehicles))
    everyone = people.filter(F.col("YEAR") == year).withColumn("PERSON", F.col("CODIGO_ACC"))
    for source, name in ((FATALITY, "fatalities"), (INJURY, "injuries")):
        own = F.col("CASUALTY_SOURCE") == source
        layer, new = people.filter(own), incoming.filter(own)
        account = integrate.account_for_people(everyone.filter(own), new, incoming, everyone)
        integrate.assert_overlap(account)
        integrate.assert_same_types(new.drop("PERSON"), layer)
        # Counted while the layer is written.
        seen_layer, old = out.ledger.watch(layer, rows=F.count("*"), old=F.count_if(F.col("YEAR") == year))
        seen_new, fresh = out.ledger.watch(new.drop("PERSON"), rows=F.count("*"))
        rebuilt, written = out.ledger.watch(integrate.replace_year(seen_layer, seen_new, year), rows=F.count("*"))
        moved = lambda again, old=old, fresh=fresh, written=written: (old(again)["rows"], written(again)["rows"], {"rows of the replaced year": -old(again)["old"], "rows of the extract": fresh(again)["rows"]})
        out.ledger.later(f"replace a year of {name}", moved)
        target = f"{folder}/data/{name}_by_year"
        sinks.write_years(city.as_layer(rebuilt) if city.is_city(sf_dir) else rebuilt, target)
        out.files.append(target)
        out.tables[f"people_{name}"] = account
        out.tables[f"relocated_{name}"] = integrate.relocated(everyone.filter(own), new)


@route
def urban_predictors(spark: SparkSession, sf_dir: str, folder: str, out: Outcome) -> None:
    if city.is_city(sf_dir):
        out.checks += checks.sources(city.missing_sources(sf_dir), len(predictors.STATIC))
        long, study = city.predictor_table(spark, sf_dir, f"{folder}/intermediate")
    else:
        long, study = q._predictors(spark, sf_dir), q._predictor_study(spark)
    long = long.cache()
    assert_unique(long, ["AREA_CODE", "PREDICTOR"])  # the pivot below keeps one value a cell
    wide = predictors.wide_table(long).cache()
    pairs = predictors.correlations(wide)
    square = predictors.correlation_matrix(pairs, wide)
    out.checks += checks.predictors(long, wide, pairs, study) + checks.symmetry(square)
    out.tables |= {"predictors_long": long, "predictors_wide": wide, "correlations": pairs, "correlation_matrix": square, "high_correlations": predictors.high_correlations(pairs), "summary": predictors.summary(long), "dictionary": predictors.dictionary(spark), "scaled": predictors.scaled(wide), "zeros": predictors.zero_report(long)}
    for p in predictors.STATIC:
        out.tables[f"histogram_{p.name.lower()}"] = predictors.histogram(wide, p.name)
    out.exported = lambda path: checks.dictionary(*(sinks.reread(spark, path(t), out.tables[t]) for t in ("dictionary", "predictors_long", "predictors_wide")))


#: Tables for models; the dictionary is a reference; all others are for reading.
ANALYSIS = {"affected_parties", "matrix_long", "rho_long", "completeness", "predictors_long", "predictors_wide", "correlations", "units"}


def run(spark: SparkSession, name: str, sf_dir: str, root: str, dump: bool = False) -> Outcome:
    """Run a route, write its tables, ledger and checks, with `dump` its intermediate results too, and fail if a check did."""
    out, folder = Outcome(), sinks.run_folder(root)
    ROUTES[name](spark, sf_dir, folder, out)
    kinds = {t: "reference" if t == "dictionary" else "analysis" if t in ANALYSIS else "presentation" for t in out.tables}
    for table, df in out.tables.items():
        out.files += sinks.write_table(df, folder, kinds[table], table)
    for stage, df in out.intermediates.items() if dump else ():
        out.files += sinks.write_intermediate(df, folder, stage)
    if out.exported:
        out.checks += out.exported(lambda table: f"{sinks.path(folder, kinds[table], table)}.csv")
    out.ledger.close()
    out.files += sinks.write_table(out.ledger.frame(spark), folder, "reference", "ledger", csv=False)
    out.files += sinks.write_table(checks.table(spark, out.checks), folder, "reference", "checks")
    failed = [f"{n}: {detail}" for n, ok, detail in out.checks if not ok]
    if failed:
        raise RouteFailed("; ".join(failed))
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("route", choices=ROUTES)
    parser.add_argument("sf_dir")
    parser.add_argument("out")
    parser.add_argument("--dump", action="store_true", help="write intermediate results too")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"loomgrid-{given.route}").getOrCreate()
    try:
        outcome = run(spark, given.route, given.sf_dir, given.out, given.dump)
    except RouteFailed as e:
        print(e)
        return 1
    print("\n".join(outcome.files))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
