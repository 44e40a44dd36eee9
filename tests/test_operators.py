"""Hand-built fixtures: one rule each, with values that follow from the rule."""

import math
import random
import struct
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.domains import PAIR_LABELS, TYPES, Scale, Study
from loomgrid.functions import bins, projection, scalars, wkt
from loomgrid.ledger import Ledger, LedgerError
from loomgrid.operators import cells, checks, completeness, grid, integrate, matrix, parties, predictors, rho, spatial, validity
from loomgrid.sources import adapter, readers, shapefile

PEOPLE = "FORMULARIO string, CODIGO_ACC string, CODIGO_VEH double, CONDICION string, CLASE_ACC string, YEAR int, FECHA_OCUR timestamp, AREA_CODE string, AREA_NAME string, CASUALTY_SOURCE string, INJURED int, KILLED int"
VEHICLES = "FORMULARIO string, CODIGO_VEHICULO double, CLASE string"


def person(crash, who, vehicle=None, role="PEATON", area="01", year=2020, killed=0):
    return (crash, who, vehicle, role, "CHOQUE", year, None, area, area and f"Unit {area}", "FATALITY" if killed else "INJURY", 1 - killed, killed)


@pytest.fixture
def study(spark):
    return Study(Scale("TEST", 2), spark.createDataFrame([("01", "Unit 01"), ("02", "Unit 02")], "AREA_CODE string, AREA_NAME string"), (2020, 2021))


def affected_of(spark, people, vehicles, by_id=True):
    p, v = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(vehicles, VEHICLES)
    universe = parties.party_universe(p, v, by_id)
    return universe, parties.affected_parties(parties.resolve_counterparts(universe), parties.crash_attributes(p))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bus_with_eight_injured_and_unharmed_car(spark):
    _, found = affected_of(spark, [person("a", f"p{i}", 1.0, "PASAJERO") for i in range(8)], [("a", 1.0, "BUS"), ("a", 2.0, "AUTOMOVIL")])
    assert rows(found, "PARTY_TYPE", "COUNTERPART_TYPE", "AFFECTED_PARTIES", "PERSONS_INJURED") == [("PUBLIC_TRANSPORT", "CAR", 1, 8)]


def test_both_sides_mirror_single_is_self_same_type_stays(spark):
    people = [person("a", "1", 1.0), person("a", "2", 2.0), person("b", "3", 1.0), person("c", "4", 1.0), person("c", "5", 2.0)]
    vehicles = [("a", 1.0, "BICICLETA"), ("a", 2.0, "MOTOCICLETA"), ("b", 1.0, "MOTOCICLETA"), ("c", 1.0, "CAMPERO"), ("c", 2.0, "CAMIONETA")]
    _, found = affected_of(spark, people, vehicles)
    assert rows(found, "FORMULARIO", "PARTY_TYPE", "COUNTERPART_TYPE") == [("a", "BICYCLE", "MOTORCYCLE"), ("a", "MOTORCYCLE", "BICYCLE"), ("b", "MOTORCYCLE", "SELF"), ("c", "CAR", "CAR"), ("c", "CAR", "CAR")]


def test_more_than_two_parties_go_whole(spark):
    universe, found = affected_of(spark, [person("a", str(i)) for i in range(3)], [("a", 1.0, "AUTOMOVIL")])
    assert universe.count() == 4 and found.count() == 0


def plain_universe(people, vehicles):
    """Parties of crashes with people, without ids of their own: (crash, type, injured, killed)."""
    found = []
    for crash in {p["FORMULARIO"] for p in people}:
        own = {}
        for c, v, k in vehicles:
            if c == crash and v is not None:
                own.setdefault(v, []).append(k)
        machines = {v: [min(ks, key=TYPES.index), 0, 0] for v, ks in own.items()}
        for p in people:
            if p["FORMULARIO"] == crash:
                hurt = [p["INJURED"], p["KILLED"]]
                if p["CODIGO_VEH"] in machines:
                    machines[p["CODIGO_VEH"]][1:] = [a + b for a, b in zip(machines[p["CODIGO_VEH"]][1:], hurt, strict=True)]
                else:
                    found.append((crash, "PEDESTRIAN" if p["CONDICION"] == "PEATON" else "BICYCLE", *hurt))
        found += [(crash, *m) for m in machines.values()]
    return sorted(found)


@pytest.mark.parametrize("by_id", [False, True])
def test_parties_from_one_sort(spark, by_id):
    """Random crashes against a plain double; without ids, one sort of the rows and no hash table serve the universe, its counts and the pairs."""
    rng = random.Random(5)
    classes = {"BICICLETA": "BICYCLE", "MOTOCICLETA": "MOTORCYCLE", "AUTOMOVIL": "CAR"}
    people, vehicles = [], []
    for i in range(300):
        vehicles += [(f"c{i}", rng.choice([None, 1, 1, 2, 3]), rng.choice(list(classes))) for _ in range(rng.randint(0, 4))]
        for j in range(rng.randint(0, 4)):
            killed = rng.randint(0, 1)
            people.append({"FORMULARIO": f"c{i}", "CODIGO_ACC": str(j), "CODIGO_VEH": rng.choice([None, 1, 2, 3, 4]), "CONDICION": rng.choice(["PEATON", "CICLISTA"]), "INJURED": 1 - killed, "KILLED": killed})
    p = spark.createDataFrame([tuple(x.values()) for x in people], "FORMULARIO string, CODIGO_ACC string, CODIGO_VEH long, CONDICION string, INJURED int, KILLED int")
    universe = parties.party_universe(p, spark.createDataFrame(vehicles, "FORMULARIO string, CODIGO_VEHICULO long, CLASE string"), by_id)
    assert rows(universe, "FORMULARIO", "PARTY_TYPE", "PERSONS_INJURED", "PERSONS_KILLED") == plain_universe(people, [(c, v, classes[k]) for c, v, k in vehicles])
    assert universe.select("FORMULARIO", "PARTY_ID").distinct().count() == universe.count()
    if not by_id:
        plan = parties.with_party_count(universe)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count(" Sort ["), plan.count("HashAggregate")) == (1, 0)


@pytest.mark.parametrize("crashes", [100, 400])
def test_partitions_of_crashes_stay_alike(spark, monkeypatch, crashes):
    """Four times the crashes come in four times the partitions, counted or as told, so none holds more; the parties are the same as in partitions of the optimiser's."""
    p = spark.range(crashes).select(F.concat(F.lit("c"), "id").alias("FORMULARIO"), F.lit("1").alias("CODIGO_ACC"), F.lit(1).alias("CODIGO_VEH"), F.lit("PEATON").alias("CONDICION"), F.lit(1).alias("INJURED"), F.lit(0).alias("KILLED"))
    v = spark.range(2 * crashes).select(F.concat(F.lit("c"), F.col("id") % crashes).alias("FORMULARIO"), (F.col("id") % 2 + 1).alias("CODIGO_VEHICULO"), F.lit("AUTOMOVIL").alias("CLASE"))
    whole = rows(parties.party_universe(p, v), "FORMULARIO", "PARTY_ID", "PERSONS_INJURED")
    monkeypatch.setattr(parties, "PART_VEHICLES", 20)
    for count in (None, 2 * crashes):
        universe = parties.party_universe(p, v, count=count)
        held = universe.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert universe.rdd.getNumPartitions() == crashes // 10 and held.max() <= 60
        assert rows(universe, "FORMULARIO", "PARTY_ID", "PERSONS_INJURED") == whole


@pytest.mark.parametrize("size", [500, 100])
def test_lines_meet_their_orders_in_partitions_that_stay_alike(spark, monkeypatch, size):
    """Five times the partitions hold a fifth each; their casualties are those of the optimiser's partitions."""
    sf_dir = "/root/testdata/sf0.001"
    whole = adapter.casualties(spark, sf_dir)
    monkeypatch.setattr(parties, "PART_VEHICLES", size)
    dealt = adapter.casualties(spark, sf_dir)
    parts = -(-adapter.read(spark, sf_dir, "lineitem").count() // size)
    held = dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert dealt.rdd.getNumPartitions() == parts and held.max() <= size
    assert whole.exceptAll(dealt).isEmpty() and dealt.exceptAll(whole).isEmpty() and whole.count() == held.sum()


def test_tables_too_long_to_broadcast_are_merged_in_partitions_that_stay_alike(spark, monkeypatch):
    """Parts and customers beyond the bound are not broadcast, however small their files; vehicles and casualties are the same either way."""
    sf_dir = "/root/testdata/sf0.001"
    whole = {make: make(spark, sf_dir) for make in (adapter.vehicles, adapter.casualties)}
    monkeypatch.setattr(grid, "BROADCAST_ROWS", 25)
    monkeypatch.setattr(parties, "PART_VEHICLES", 100)
    monkeypatch.setattr(adapter, "PART_ROWS", 100, raising=False)
    for make, broadcasts in ((adapter.vehicles, 0), (adapter.casualties, 1)):  # the nations
        dealt = make(spark, sf_dir)
        held = dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert dealt._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == broadcasts
        assert dealt.rdd.getNumPartitions() == -(-adapter.line_count(spark, sf_dir) // 100) and held.max() <= 400
        assert whole[make].exceptAll(dealt).isEmpty() and dealt.exceptAll(whole[make]).isEmpty() and whole[make].count() == held.sum()


def test_standalone_types_come_from_roles_and_vehicles_beat_roles(spark):
    people = [person("a", "1", None, "PASAJERO"), person("b", "2", 99.0, "CICLISTA"), person("c", "3", 1.0, "PEATON"), person("d", "4", None, None), person("e", "5", None, "CONDUCTOR")]
    _, found = affected_of(spark, people, [("c", 1.0, "AUTOMOVIL"), ("b", None, "BUS"), ("z", 1.0, "BUS")])
    assert rows(found, "FORMULARIO", "PARTY_TYPE") == [("a", "OTHER"), ("b", "BICYCLE"), ("c", "CAR"), ("d", "OTHER"), ("e", "OTHER")]


def test_classes_are_normalised_and_unknown_ones_residual(spark):
    raw = ["Camión , furgón", "  bus   articulado ", "M . industrial", "Nave", None, "AUTOMÓVIL", "Automóvil"]
    got = [(r.k, r.t) for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, c string").orderBy("i").select(scalars.normal_class(F.col("c")).alias("k"), scalars.type_of_class(F.col("c")).alias("t")).collect()]
    assert got == [("CAMION, FURGON", "OTHER"), ("BUS ARTICULADO", "PUBLIC_TRANSPORT"), ("M. INDUSTRIAL", "OTHER"), ("NAVE", "OTHER"), ("NAN", "OTHER"), ("AUTOMOVIL", "CAR"), ("AUTOMOVIL", "CAR")]


def test_crash_takes_the_located_unit_and_duplicates_fall_back_to_rows(spark):
    people = [person("a", "1", area=None), person("a", "1", area="02", killed=1)]
    p = spark.createDataFrame(people, PEOPLE)
    assert rows(parties.crash_attributes(p), "AREA_CODE", "AREA_NAME", "YEAR") == [("02", "Unit 02", 2020)]
    profile = parties.person_profile(p).first()
    assert (profile.DUPLICATED, profile.CROSS_LAYER) == (1, 1) and not parties.person_ids_usable(p)
    universe, found = affected_of(spark, people, [], parties.person_ids_usable(p))
    assert universe.count() == 2 and rows(found, "COUNTERPART_TYPE") == [("PEDESTRIAN",), ("PEDESTRIAN",)]
    with pytest.raises(parties.IngestError):
        parties.assert_crash_ids(spark.createDataFrame([person(None, "1")], PEOPLE))


def test_matrix_grid_totals_and_years_outside(spark, study):
    universe, found = affected_of(spark, [person("a", "1", 1.0), person("b", "2", 1.0, area=None), person("c", "3", 1.0, year=2021)], [("a", 1.0, "BUS"), ("b", 1.0, "BUS"), ("c", 1.0, "BUS"), ("c", 2.0, "TREN")])
    long = matrix.long_table(found, study)
    assert long.count() == 2 * 2 * 6 * 7 and rows(long.filter("AFFECTED_PARTIES > 0"), "AREA_CODE", "YEAR", "COUNTERPART_TYPE") == [("01", 2020, "SELF"), ("01", 2021, "OTHER")]
    assert all(ok for _, ok, _ in checks.matrix(long, found, study))
    table = matrix.crosstab(long, "PERSONS_INJURED").collect()
    assert [r.PARTY_TYPE for r in table] == list(matrix.TYPES) and table[4].SELF == 1 and table[4].OTHER == 1 and table[0].CAR == 0
    _, late = affected_of(spark, [person("a", "1", 1.0, year=1999)], [("a", 1.0, "BUS")])
    with pytest.raises(grid.CoverageError):
        grid.assert_covered(matrix.cells(late), matrix.grid(study), matrix.KEYS)
    _, undated = affected_of(spark, [person("a", "1", 1.0, year=None)], [("a", 1.0, "BUS")])
    with pytest.raises(grid.CoverageError):
        grid.assert_covered(matrix.cells(undated), matrix.grid(study), matrix.KEYS)
    assert rows(matrix.counterpart_shares(long).filter("PARTY_TYPE = 'CAR'"), "SHARE") == [(None,)] * 7


def test_rho_is_pooled_for_the_city_and_null_without_crashes(spark, study):
    people, vehicles = [], []
    for crash, area, both in (("a", "01", True), ("b", "01", False), ("c", "02", True)):
        vehicles += [(crash, 1.0, "MOTOCICLETA"), (crash, 2.0, "AUTOMOVIL")]
        people += [person(crash, f"{crash}1", 1.0, area=area)] + ([person(crash, f"{crash}2", 2.0, area=area)] if both else [])
    universe, _ = affected_of(spark, people, vehicles)
    located = rho.placed(rho.restrict(rho.crash_pairs(universe)), parties.crash_attributes(spark.createDataFrame(people, PEOPLE)))
    long = rho.long_table(located, study)
    assert long.count() == 3 * 2 * 9 and all(ok for _, ok, _ in checks.rho(long, located, study))
    seen = rows(long.filter("CRASHES_TOTAL > 0"), "AREA_CODE", "PAIR", "RHO")
    assert seen == [("01", "MOTORCYCLE-CAR", 0.5), ("02", "MOTORCYCLE-CAR", 1.0), ("CITY", "MOTORCYCLE-CAR", 2 / 3)]
    assert long.filter("CRASHES_TOTAL = 0 and RHO is not null").count() == 0
    assert rho.city_table(long).columns == ["YEAR", *PAIR_LABELS] and rho.unexpected_pairs(rho.restrict(rho.crash_pairs(universe))).isEmpty()
    pooled = {r.PAIR: (r.POOLED, r.MEAN_OF_UNITS) for r in rho.pooled_and_mean(long).collect()}
    assert pooled["MOTORCYCLE-CAR"] == (2 / 3, 0.75) and pooled["PEDESTRIAN-CAR"] == (None, None)


def test_rho_jumps(spark):
    data = [("CITY", "A-B", y, r, 5) for y, r in ((2018, 0.1), (2019, 0.3), (2020, None), (2021, 0.9), (2022, 0.85))]
    long = spark.createDataFrame(data, "AGGREGATION_LEVEL string, PAIR string, YEAR int, RHO double, CRASHES_TOTAL long")
    assert rows(rho.jumps(long), "YEAR") == [(2019,)] and rows(rho.jumps(long, None), "YEAR") == [(2019,), (2022,)]


def test_thin_and_empty_months(spark):
    dates = [(2020, m) for m in range(1, 13) for _ in range({1: 0, 2: 40}.get(m, 100))]
    people = spark.createDataFrame([("INJURY", y, f"2020-{m:02d}-03") for y, m in dates] + [("INJURY", 1990, "1990-01-01"), ("INJURY", 2020, None)], "CASUALTY_SOURCE string, YEAR int, d string").withColumn("FECHA_OCUR", F.to_timestamp("d"))
    table = completeness.monthly_table(people, (2020,))
    assert table.count() == 24
    assert rows(completeness.flagged(table).filter("CASUALTY_SOURCE = 'INJURY'"), "MONTH", "EMPTY", "THIN", "YEAR_MEDIAN") == [(1, True, True, 100.0), (2, False, True, 100.0)]
    none = table.filter("CASUALTY_SOURCE = 'FATALITY'")
    assert none.filter("EMPTY and SHARE_OF_MEDIAN is null and THIN is null").count() == 12 and completeness.flagged(none).count() == 12
    assert rows(completeness.trailing_empty(table), "CASUALTY_SOURCE", "TRAILING_EMPTY") == [("FATALITY", 12), ("INJURY", 0)]


def test_replacing_a_year(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "PERSON string")
    got = integrate.account_for_people(ids("a", "b", "c"), ids("a", "n", "m"), ids("a", "n", "m", "b"), ids("a", "b", "c", "m")).first().asDict()
    assert got == {"STAYED": 1, "GONE": 1, "CHANGED_SEVERITY": 1, "FROM_OTHER_LAYER": 1, "BRAND_NEW": 1, "WERE": 3}
    with pytest.raises(integrate.IntegrationError):
        integrate.assert_overlap(integrate.account_for_people(ids("a"), ids("b"), ids("b"), ids("a")))
    layer = spark.createDataFrame([(2019, "x"), (2020, "y"), (None, "z")], "YEAR int, v string")
    new = spark.createDataFrame([(2020, "new")], "YEAR int, v string")
    assert sorted(map(tuple, integrate.replace_year(layer, new, 2020).collect()), key=str) == [(2019, "x"), (2020, "new"), (None, "z")]
    integrate.assert_single_year(new, 2020)
    with pytest.raises(integrate.IntegrationError):
        integrate.assert_single_year(layer, 2020)
    with pytest.raises(integrate.IntegrationError):
        integrate.assert_same_types(new.withColumn("YEAR", F.col("YEAR").cast("long")), layer)
    v = spark.createDataFrame([("1", 5.0, "BUS")], VEHICLES)
    asked = lambda *x: integrate.reference_rate(spark.createDataFrame([("1.0", n) for n in x], "FORMULARIO string, CODIGO_VEH double"), v)
    assert asked(5.0, 6.0, None).first().asDict() == {"REFERENCING": 2, "RESOLVED": 1, "RATE": 0.5}
    integrate.assert_rate(asked(5.0, 6.0), asked(5.0))
    with pytest.raises(integrate.IntegrationError):
        integrate.assert_rate(asked(6.0, 7.0, 8.0), asked(5.0))


def test_ledger_balances_or_stops(spark):
    ledger = Ledger()
    ledger.settle("a", 10, 7, {"gone": -4, "new": 1, "nothing": 0})
    with pytest.raises(LedgerError):
        ledger.settle("b", 10, 7, {"gone": -2})
    assert [tuple(r) for r in ledger.frame(spark).orderBy("STEP_NUMBER").collect()] == [(0, "a", "opening", 10), (0, "a", "gone", -4), (0, "a", "new", 1), (0, "a", "closing", 7)]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.dictionaries(st.text(max_size=3), st.integers(-1000, 1000), max_size=5), st.integers(-3, 3))
def test_ledger_accepts_exactly_balanced_stages(n, moved, off):
    out = n + sum(moved.values()) + off
    if off:
        with pytest.raises(LedgerError):
            Ledger().settle("s", n, out, moved)
    else:
        Ledger().settle("s", n, out, moved)


@settings(max_examples=300, deadline=None)
@given(st.floats(-1e6, 1e6), st.floats(1e-6, 1e6))
def test_histogram_edges_by_enumeration(low, span):
    """Of all round steps over nine decades around the span, none has a count nearer the target."""
    high = low + span
    if high == low:
        return
    count = lambda s: math.ceil(high / s) - math.floor(low / s)
    every = [m * 10.0**e for e in range(math.floor(math.log10(high - low)) - 4, math.floor(math.log10(high - low)) + 5) for m in (1.0, 2.0, 2.5, 5.0)]
    allowed = [(abs(count(s) - 6), s) for s in every if 4 <= count(s) <= 10]
    cuts = bins.histogram_edges(low, high)
    if allowed:
        best = min(allowed)[1]
        assert len(cuts) - 1 == count(best) and math.isclose(cuts[1] - cuts[0], best, rel_tol=1e-6, abs_tol=best / 10)


def test_pivots_need_one_row_a_cell(spark):
    grid.assert_unique(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k", "v"])
    with pytest.raises(grid.CoverageError):
        grid.assert_unique(spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int"), ["k", "v"])


@pytest.mark.parametrize("low,high,first,count", [(0, 1, 0.0, 5), (0.003, 0.098, 0.0, 5), (3, 355, 0.0, 8), (-2, 2, -2.0, 8), (10, 10.6, 10.0, 6)])
def test_histogram_edges_are_round(low, high, first, count):
    cuts = bins.histogram_edges(low, high)
    assert cuts[0] == first and len(cuts) - 1 == count and cuts[0] <= low and cuts[-1] >= high


def test_histogram_of_one_value_and_of_none(spark):
    assert bins.histogram_edges(2.0, 2.0) == (1.9, 2.1) and bins.histogram_edges(None, None) == (-0.5, 0.5)
    got = predictors.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.2,), (None,)], "v double"), "v").orderBy("BIN").collect()
    assert [r.UNITS for r in got] == [1, 1, 0, 0, 1]


SHAPES = [
    (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (2, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6.5, 5 5)))"), (3, "POLYGON((0 0,3 0,3 1,1 1,1 3,0 3,0 0))"),
    (4, "POINT (1 2)"), (5, None), (6, "POLYGON EMPTY"), (7, "POLYGON((0 0,2 2,2 0,0 2,0 0))"),
]


def clip(ring, clipper):
    """Sutherland-Hodgman: a ring cut by a convex counter-clockwise one."""
    for (ax, ay), (bx, by) in zip(clipper, clipper[1:] + clipper[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, r in zip(ring, ring[1:] + ring[:1], strict=True):
            s, t = side(p), side(r)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (r[0] - p[0]) * s / (s - t), p[1] + (r[1] - p[1]) * s / (s - t)))
        ring = out
    return abs(sum(p[0] * r[1] - r[0] * p[1] for p, r in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if ring else 0.0


def test_areas_containment_and_overlap(spark):
    shapes = spark.createDataFrame(SHAPES, "id int, w string").withColumn("rings", wkt.rings(F.col("w")))
    areas = {r.id: r.a for r in shapes.select("id", spatial.area(F.col("rings")).alias("a")).collect()}
    assert areas[1] == 15 and areas[2] == 1.25 and areas[3] == 5 and areas[5] is None and areas[6] is None
    inside = lambda i, x, y: shapes.filter(F.col("id") == i).select(spatial.contains(F.col("rings"), F.lit(float(x)), F.lit(float(y)))).first()[0]
    assert inside(1, 3, 3) and not inside(1, 1.5, 1.5) and not inside(1, 0, 2) and not inside(1, 4, 4) and not inside(1, 1, 1.5) and inside(3, 0.5, 2) and not inside(3, 2, 2)
    triangle = [(0.5, 0.2), (2.5, 0.4), (0.7, 2.9)]
    unit = spark.createDataFrame([("T", "POLYGON((0.5 0.2, 0.7 2.9, 2.5 0.4, 0.5 0.2))")], "AREA_CODE string, w string").withColumn("rings", wkt.rings(F.col("w")))
    solid = shapes.filter("id in (1, 2, 3)").select("id", "rings")
    want = {1: clip([(0, 0), (4, 0), (4, 4), (0, 4)], triangle) - clip([(1, 1), (2, 1), (2, 2), (1, 2)], triangle), 2: clip([(0, 0), (1, 0), (1, 1)], triangle), 3: clip([(0, 0), (3, 0), (3, 1), (0, 1)], triangle) + clip([(0, 1), (1, 1), (1, 3), (0, 3)], triangle)}
    for tile in (0.37, 1.0, 100.0):
        got = {r.id: r.OVERLAP for r in spatial.overlap(solid, unit, tile).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)
    assert [r.id for r in validity.self_crossings(shapes.filter("id in (1, 2, 3, 7)").select("id", "rings")).collect()] == [7]
    points = shapes.select("id", wkt.point(F.col("w")).alias("p"), wkt.kind(F.col("w")).alias("geom_type"))
    assert [tuple(r.p) for r in points.filter("p is not null").collect()] == [(1.0, 2.0)]
    spatial.assert_geometry(points, ("POINT", "POLYGON", "MULTIPOLYGON"))
    with pytest.raises(spatial.GeometryError):
        spatial.assert_geometry(points, ("POINT",))


def test_overlaps_at_large_coordinates(spark):
    """Rotated polygons in metres near a city's plane coordinates: no pair that does not touch, and areas as by clipping."""
    turned = lambda x, y, r, n, turn: [(x + r * math.cos(turn + 2 * math.pi * i / n), y + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]
    text = lambda ring: "POLYGON((" + ", ".join(f"{a!r} {b!r}" for a, b in [*ring, ring[0]]) + "))"
    units = {f"U{i}": turned(1_000_000 + 3_000 * (i % 4), 1_010_000 + 3_000 * (i // 4), 1_900, 5, 0.3 * i) for i in range(8)}
    shapes = {i: turned(998_000 + 173 * i, 1_008_000 + (977 * i) % 8_000, 40 + 9 * i, 7, 0.1 * i) for i in range(60)} | {100 + i: turned(1_040_000 + 50 * i, 1_010_000 + 400 * i, 90, 7, 0.2 * i) for i in range(60)}
    want = {(i, u): clip(a, b) for i, a in shapes.items() for u, b in units.items()}
    want = {k: v for k, v in want.items() if v > 1e-6}
    layer = spark.createDataFrame([(i, text(r)) for i, r in shapes.items()], "id int, w string").withColumn("rings", wkt.rings(F.col("w")))
    roster = spark.createDataFrame([(u, text(r)) for u, r in units.items()], "AREA_CODE string, w string").withColumn("rings", wkt.rings(F.col("w")))
    got = {(r.id, r.AREA_CODE): r.OVERLAP for r in spatial.overlap(layer, roster, 500.0).collect()}
    assert len(want) > 40 and set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-5) for k in want)


def test_points_are_located_without_a_shuffle(spark):
    units = spark.range(3).select(F.concat(F.lit("U"), "id").alias("AREA_CODE"), spatial.box(F.col("id") * 10, F.lit(0), F.col("id") * 10 + 10, F.lit(10)).alias("rings"))
    points = spark.range(100).select(F.col("id").alias("p_id"), (F.col("id") * 0.5).alias("x"), F.lit(5.0).alias("y"))
    found = cells.locate(points, units)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert {r.p_id: r.AREA_CODE for r in found.collect()} == {i: None if i % 20 == 0 or i > 59 else f"U{i // 20}" for i in range(100)}
    assert cells.locate(points, units, how="inner").count() == 57


def test_the_whole_table_is_in_order(spark):
    rows = [("c2", None, "CAR", "V1"), ("c1", "02", "CAR", "V1"), ("c3", "01", "CAR", "V2"), ("c1", "01", "CAR", "V1"), ("c1", "01", "BICYCLE", "V2")]
    got = parties.in_final_order(spark.createDataFrame(rows, "FORMULARIO string, AREA_CODE string, PARTY_TYPE string, PARTY_ID string")).collect()
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0], r[2]))


def test_boundary_overlapping_units_and_snapping(spark):
    square = lambda x, y, w: f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))"
    units = spark.createDataFrame([("B", square(0, 0, 2)), ("A", square(1, 1, 2)), ("C", square(10, 10, 1))], "AREA_CODE string, w string").withColumn("rings", wkt.rings(F.col("w")))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 0.0, 1.0), (4, 6.0, 6.0), (5, 9.5, 10.5)], "p_id long, x double, y double")
    located = {r.p_id: r.AREA_CODE for r in cells.locate(points, units).collect()}
    assert located == {1: "B", 2: "A", 3: None, 4: None, 5: None}
    lost = cells.locate(points, units).filter("AREA_CODE is null").drop("AREA_CODE")
    assert {r.p_id: (r.AREA_CODE, r.DISTANCE) for r in cells.snap(lost, units, 1.0).collect()} == {3: ("B", 0.0), 5: ("C", 0.5)}


def test_predictors_zero_and_not_measured(spark):
    study = Study(Scale("T", 3), spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "AREA_CODE string, AREA_NAME string"), ())
    declared = (predictors.Predictor("P", "p", "l", "f", "point", "point_density"), predictors.Predictor("S", "s", "l", "f", "area", "area_share", zero_is_implausible=True))
    areas = spark.createDataFrame([("A", 2.0), ("B", 4.0), ("C", 0.0)], "AREA_CODE string, AREA_UNIT_KM2 double")
    long = predictors.long_table(spark.createDataFrame([("A", "P", 3.0), ("B", "S", 1.0)], "AREA_CODE string, PREDICTOR string, MEASURE double"), study, areas, declared)
    assert rows(long.filter("VALUE_STATUS = 'MEASURED'"), "AREA_CODE", "PREDICTOR", "VALUE") == [("A", "P", 1.5), ("A", "S", 0.0), ("B", "P", 0.0), ("B", "S", 0.25)]
    assert long.filter("VALUE_STATUS = 'NOT_MEASURED' and MEASURE is null and VALUE is null").count() == 2
    wide = predictors.wide_table(long, declared)
    assert rows(wide.filter("AREA_CODE = 'C'"), "P", "S") == [(None, None)]
    assert rows(predictors.zeros(long, declared), "PREDICTOR", "READING") == [("P", "MEASURED ZERO"), ("S", "IMPLAUSIBLE")]
    flat = wide.withColumn("S", F.lit(1.0))
    assert predictors.correlations(flat, declared).first().CORRELATION is None and {r.S for r in predictors.scaled(flat, declared).collect()} == {0.5}
    assert all(ok for _, ok, _ in checks.predictors(long, wide, predictors.correlations(wide, declared), study, declared))
    with pytest.raises(grid.CoverageError):
        predictors.long_table(spark.createDataFrame([("X", "P", 3.0)], "AREA_CODE string, PREDICTOR string, MEASURE double"), study, areas, declared)
    with pytest.raises(ValueError):
        predictors.Predictor("X", "x", "l", "f", "area", "point_density")
    multi = spark.createDataFrame([(1, [(0.1, 0.1), (0.2, 0.2), (5.0, 5.0)])], "id int, points array<struct<x:double,y:double>>")
    unit = spark.createDataFrame([("A", "POLYGON((0 0,1 0,1 1,0 1,0 0))")], "AREA_CODE string, w string").withColumn("rings", wkt.rings(F.col("w")))
    assert predictors.point_density(multi, unit, 1.0).first().MEASURE == 2


def test_projection_against_the_krueger_series(spark):
    n = projection.FLATTENING / (2 - projection.FLATTENING)
    e = math.sqrt(projection.FLATTENING * (2 - projection.FLATTENING))
    radius = projection.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)

    def conformal(lat):
        s = math.sin(lat)
        return math.sinh(math.atanh(s) - e * math.atanh(e * s))

    def krueger(lon, lat):
        t, d = conformal(math.radians(lat)), math.radians(lon - projection.LON0)
        xi, eta = math.atan2(t, math.cos(d)), math.asinh(math.sin(d) / math.hypot(t, math.cos(d)))
        north = lambda xi, eta: radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha)))
        east = radius * (eta + sum(a * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha)))
        return projection.EAST0 + east, projection.NORTH0 + north(xi, eta) - north(math.atan(conformal(math.radians(projection.LAT0))), 0.0)

    places = [(projection.LON0, projection.LAT0), (-74.2, 4.3), (-73.9, 4.85), (-74.08, 4.6), (-73.0, 6.0)]
    east, north = projection.to_plane(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in spark.createDataFrame(places, "lon double, lat double").coalesce(1).select(east, north).collect()]
    for place, found in zip(places, got, strict=True):
        assert all(abs(a - b) < 1e-3 for a, b in zip(krueger(*place), found, strict=True))


def test_rosters_profiles_and_extracts(spark, tmp_path):
    layer = spark.createDataFrame([("1", "one"), ("2", "two")], "c string, n string")
    assert readers.territorial_units(layer, Scale("S", 2), "c", "n").columns == ["AREA_CODE", "AREA_NAME"]
    for bad, columns in ((layer.unionAll(layer), ("c", "n")), (layer.limit(1), ("c", "n")), (layer, ("c", "x"))):
        with pytest.raises(readers.RosterError):
            readers.territorial_units(bad, Scale("S", 2), *columns)
    v = spark.createDataFrame([("a", 1.0, "BUS"), ("a", 1.0, "Automóvil"), ("b", 1.0, None), ("c", 1.0, "Nave")], VEHICLES)
    assert readers.vehicle_profile(v).first().asDict() == {"DUPLICATED": 1, "UNMAPPED": 1, "RESCUED": 1, "NULL_CLASS": 1}
    (tmp_path / "e.csv").write_text('FORMULARIO,CODIGO_ACC,CODIGO_VEH,CONDICION,CLASE_ACC,ANO_OCURRE,FECHA_OCUR,MUERTE_POS,geometry\nA1,77.0,3,PEATON,CHOQUE,2024,2024-05-01T10:00:00Z,,"POINT (-74.1 4.6)"\nA2, 78 ,,CICLISTA,CHOQUE,2024,broken,SI,\n')
    got = [(r.CODIGO_ACC, r.CODIGO_VEH, str(r.FECHA_OCUR), r.x, r.y) for r in readers.extract_csv(spark, str(tmp_path / "e.csv")).collect()]
    assert got == [("77", 3.0, "2024-05-01 10:00:00", -74.1, 4.6), ("78", None, "None", None, None)]
    fatal, injured = integrate.split_by_severity(readers.extract_csv(spark, str(tmp_path / "e.csv")))
    assert (fatal.count(), injured.count()) == (1, 1)
    assert checks.loading({"a": 1, "b": 2}, {"a": 1}) == [("a", True, "1 against 1"), ("b", True, "2, FIRST MEASUREMENT")] and not checks.loading({"a": 1}, {"a": 2})[0][1]


def test_shapefile(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    flat = lambda ps: struct.pack(f"<{2 * len(ps)}d", *[c for p in ps for c in p])
    polygon = struct.pack("<i4dii2i", 5, 0, 0, 2, 2, 2, 9, 0, 5) + flat(square + hole)
    content = [polygon, struct.pack("<idd", 1, 3.5, 4.5), struct.pack("<i", 0)]
    shp, shx = b"\0" * 100, b"\0" * 100
    for i, c in enumerate(content):
        shx += struct.pack(">ii", len(shp) // 2, len(c) // 2)
        shp += struct.pack(">ii", i + 1, len(c) // 2) + c
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    dbf = b"\x03" + b"\0" * 3 + struct.pack("<IHH", 3, 32 + 64 + 1, 1 + 4 + 6) + b"\0" * 20 + field("CODE", 4) + field("NAME", 6) + b"\r"
    dbf += b" 01  Norte " + b" 02  Sur   " + b" 03        "
    for suffix, data in ((".shp", shp), (".shx", shx), (".dbf", dbf)):
        (tmp_path / f"layer{suffix}").write_bytes(data)
    shapefile.register(spark)
    got = spark.read.format("shapefile").load(str(tmp_path / "layer.shp")).collect()
    assert [(r.CODE, r.NAME, r.geom_type) for r in got] == [("01", "Norte", "POLYGON"), ("02", "Sur", "POINT"), ("03", None, None)]
    assert [r.hole for r in got[0].rings] == [False, True] and tuple(got[1].points[0]) == (3.5, 4.5)
    layer = spark.read.format("shapefile").load(str(tmp_path / "layer.shp")).filter("geom_type = 'POLYGON'")
    assert layer.select(spatial.area(F.col("rings"))).first()[0] == 4 - 0.125


def test_formats(spark):
    values = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.05,), (0.5,), (5.0,), (50.0,), (500.0,)], "v double").coalesce(1)
    assert [r[0] for r in values.select(scalars.decimals(F.col("v"))).collect()] == [2, 2, 2, 4, 3, 2, 1, 0]
    assert [r[0] for r in values.select(scalars.shown(F.col("v"), F.lit("area"))).collect()][:5] == ["-", "-", "-1.0000", "0.0500", "0.5000"]


def test_lines_of_rho_break_where_it_is_undefined(spark):
    values = {2000: 0.2, 2001: 0.25, 2002: None, 2003: None, 2004: 0.3, 2005: 0.45, 2006: None, 2007: 0.4}
    long = spark.createDataFrame([("CITY", "A-B", y, v, 5) for y, v in values.items()] + [("UNIT", "A-B", 2000, None, 0), ("CITY", "C-D", 2000, None, 0)], "AGGREGATION_LEVEL string, PAIR string, YEAR int, RHO double, CRASHES_TOTAL int")
    got = {(r.PAIR, r.YEAR): (r.SEGMENT, r.JUMPED) for r in rho.lines(long).collect()}
    assert [got["A-B", y] for y in values] == [(1, False), (1, False), (None, False), (None, False), (2, False), (2, True), (None, False), (3, False)]
    assert sorted(map(tuple, rho.gaps(long).collect())) == [("A-B", 2002, 2003, 2), ("A-B", 2006, 2006, 1), ("C-D", 2000, 2000, 1)]


def test_ledger_counts_while_a_table_is_made(spark):
    book = Ledger()
    all_rows, seen = book.watch(spark.range(100), rows=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    even, after = book.watch(all_rows.filter("id % 2 = 0"), rows=F.count("*"))
    book.later("keep even", lambda again: (seen(again)["rows"], after(again)["rows"], {"odd rows": -seen(again)["odd"]}))
    even.write.format("noop").mode("overwrite").save()
    book.close()
    assert book.lines == [(0, "keep even", "opening", 100), (0, "keep even", "odd rows", -50), (0, "keep even", "closing", 50)]
    calls = []
    book.later("counted anew", lambda again: (calls.append(again), (10, 10 if again else 11, {}))[1])
    book.close()
    assert calls == [False, True] and book.steps == ["keep even", "counted anew"]
    book.later("lost", lambda again: (10, 9, {}))
    with pytest.raises(LedgerError):
        book.close()


def test_classes_are_decomposed_as_unicode_says(spark):
    """Every assigned code point between two letters, against the rule; and whole classes written in other ways."""
    rule = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    texts = [f"a{chr(c)}b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts += ["", "Peato\u0301n", "\uff21\uff35\uff34\uff2f\uff2d\uff2f\uff36\uff29\uff2c", "\ud55c\uae00 \uac00", "o\ufb03ce \u00bd", "\U0001d400\U0001f130"]
    frame = spark.createDataFrame(pd.DataFrame({"c": texts}))
    assert [r.c for r in frame.select("c", scalars.without_marks(F.col("c")).alias("p")).collect() if r.p != rule(r.c)] == []
    got = [r.k for r in frame.filter("c like 'Peat%' or c like '\uff21%'").select(scalars.normal_class(F.col("c")).alias("k")).collect()]
    assert sorted(got) == ["AUTOMOVIL", "PEATON"]
