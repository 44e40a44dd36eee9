"""Routes over a city's own files: shapefiles in degrees, CSV of vehicles and of an updated extract; repair of polygons; exports read again."""

import json
import shutil
import struct

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import checks, predictors, spatial, validity
from loomgrid.plans import routes, sinks
from loomgrid.sources import city

LON, LAT = -74.1, 4.6


def flat(points):
    return struct.pack(f"<{2 * len(points)}d", *[c for p in points for c in p])


def write_shapefile(path, fields, records):
    """`fields` are (name, width); a record is (values, None | (x, y) | a list of rings)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    shp, shx, rows = b"\0" * 100, b"\0" * 100, b""
    for i, (values, shape) in enumerate(records):
        if shape is None:
            content = struct.pack("<i", 0)
        elif isinstance(shape, tuple):
            content = struct.pack("<idd", 1, *shape)
        else:
            starts = [sum(len(r) for r in shape[:k]) for k in range(len(shape))]
            content = struct.pack(f"<i4dii{len(shape)}i", 5, 0, 0, 0, 0, len(shape), sum(map(len, shape)), *starts) + b"".join(map(flat, shape))
        shx += struct.pack(">ii", len(shp) // 2, len(content) // 2)
        shp += struct.pack(">ii", i + 1, len(content) // 2) + content
        rows += b" " + b"".join(str(v).encode()[:w].ljust(w) for v, (_, w) in zip(values, fields, strict=True))
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields)
    dbf = b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(records), 32 + len(head) + 1, 1 + sum(w for _, w in fields)) + b"\0" * 20 + head + b"\r" + rows
    for suffix, data in ((".shp", shp), (".shx", shx), (".dbf", dbf)):
        path.with_suffix(suffix).write_bytes(data)


def square(x, y, side=0.01):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


PEOPLE = [("FORMULARIO", 8), ("CODIGO_ACC", 8), ("CODIGO_VEH", 4), ("CONDICION", 12), ("CLASE_ACC", 8), ("ANO_OCURRE", 4), ("FECHA_OCUR", 10)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two units side by side. Crash a (2020): two injured in unit 01; b (2021): one killed and one injured in 02; c (2021): one injured outside, one without a point."""
    root = tmp_path_factory.mktemp("city")
    write_shapefile(root / "units/units.shp", [("COD", 4), ("NOM", 8)], [(("01", "West"), [square(LON, LAT)]), (("02", "East"), [square(LON + 0.01, LAT)])])
    west, east = (LON + 0.005, LAT + 0.005), (LON + 0.015, LAT + 0.005)
    write_shapefile(root / "people/dead.shp", PEOPLE, [(("b", "p3", "1", "PEATON", "CHOQUE", 2021, "2021-03-01"), east)])
    hurt = [(("a", "p1", "1", "PEATON", "CHOQUE", 2020, "2020-01-01"), west), (("a", "p2", "2", "PEATON", "CHOQUE", 2020, "2020-01-01"), west), (("b", "p4", "2", "PEATON", "CHOQUE", 2021, "2021-03-01"), east),
            (("c", "p5", "", "PEATON", "CHOQUE", 2021, "2021-05-01"), (LON + 1, LAT)), (("c", "p6", "", "PEATON", "CHOQUE", 2021, "2021-05-01"), None)]
    write_shapefile(root / "people/hurt.shp", PEOPLE, hurt)
    (root / "vehicles.csv").write_text("FORMULARIO,CODIGO_VEHICULO,CLASE\na,1,MOTOCICLETA\na,2,AUTOMOVIL\nb,1,BICICLETA\nb,2,BUS\n")
    extract = ["FORMULARIO,CODIGO_ACC,CODIGO_VEH,CONDICION,CLASE_ACC,ANO_OCURRE,FECHA_OCUR,MUERTE_POS,geometry"]
    extract += [f"b,{p},{v},PEATON,CHOQUE,2021,2021-03-01,{m},POINT ({LON + 0.015} {LAT + 0.005})" for p, v, m in (("p3", 1, "X"), ("p4", 2, ""), ("p9", 2, ""))]
    (root / "extract.csv").write_text("\n".join(extract) + "\n")
    for i, p in enumerate(predictors.STATIC):
        # Areas: the west half of unit 01, a bow tie over unit 02 whose two triangles hold half of it, and a feature without geometry.
        x, y, bow = LON + 0.01, LAT, [(LON + 0.01, LAT), (LON + 0.02, LAT + 0.01), (LON + 0.02, LAT), (LON + 0.01, LAT + 0.01), (LON + 0.01, LAT)]
        area = [[(LON, LAT), (LON, LAT + 0.01), (LON + 0.005, LAT + 0.01), (LON + 0.005, LAT), (LON, LAT)]]
        shapes = [area, [bow], None] if p.geometry == "area" else [west, (x + 0.002 + i * 1e-4, y + 0.003), (LON - 1, LAT), None]
        write_shapefile(root / "predictors" / p.layer / p.file, [("ID", 4)], [((str(k),), s) for k, s in enumerate(shapes)])
    declared = {"scale": ["PAIR", 2], "units": "units/units.shp", "code": "COD", "name": "NOM", "years": [2020, 2021], "fatalities": "people/dead.shp", "injuries": "people/hurt.shp", "vehicles": "vehicles.csv", "extract": "extract.csv", "replaced": 2021}
    (root / "city.json").write_text(json.dumps(declared))
    return str(root)


def test_people_are_located_in_their_units(spark, root):
    got = city.casualties(spark, root).select("CODIGO_ACC", "AREA_CODE", "AREA_NAME", "CASUALTY_SOURCE", "KILLED").collect()
    assert sorted(map(tuple, got), key=str) == [
        ("p1", "01", "West", "INJURY", 0), ("p2", "01", "West", "INJURY", 0), ("p3", "02", "East", "FATALITY", 1), ("p4", "02", "East", "INJURY", 0), ("p5", None, None, "INJURY", 0), ("p6", None, None, "INJURY", 0)]


def redeclared(root, tmp_path, **changes):
    target = tmp_path / "redeclared"
    shutil.copytree(root, target, dirs_exist_ok=True)
    given = json.loads((target / "city.json").read_text()) | changes
    (target / "city.json").write_text(json.dumps({k: v for k, v in given.items() if v is not None}))
    return str(target)


def test_one_declaration_holds_several_rosters(spark, root, tmp_path):
    """The same people on one unit over both halves: the roster in use decides the units, the files are the same."""
    write_shapefile(tmp_path / "redeclared/units/whole.shp", [("ID", 4), ("LABEL", 8)], [(("W", "All"), [[(LON, LAT), (LON, LAT + 0.01), (LON + 0.02, LAT + 0.01), (LON + 0.02, LAT), (LON, LAT)]])])
    pair, whole = {"size": 2, "units": "units/units.shp", "code": "COD", "name": "NOM"}, {"size": 1, "units": "units/whole.shp", "code": "ID", "name": "LABEL"}
    for label, codes in (("PAIR", ["01", "02"]), ("WHOLE", ["W"])):
        own = redeclared(root, tmp_path, scale=label, scales={"PAIR": pair, "WHOLE": whole}, units=None, code=None, name=None)
        study = city.study(spark, own)
        assert (study.scale.label, study.scale.units) == (label, len(codes)) and sorted(r.AREA_CODE for r in study.units.collect()) == codes
        people = city.casualties(spark, own).filter("AREA_CODE is not null").agg(F.sum("KILLED"), F.sum("INJURED"), F.array_sort(F.collect_set("AREA_CODE"))).first()
        assert people == (1, 3, codes)
    with pytest.raises(city.DeclarationError, match="none of"):
        city.city(redeclared(root, tmp_path, scale="OTHER"))


def test_a_load_is_held_against_the_baseline_of_its_edition_and_roster(spark, root, tmp_path):
    counts = {"fatalities": 1, "injuries": 5, "casualties": 6, "vehicles": 4}
    good = {"original": {"counts": counts, "scales": {"PAIR": {"injuries_unlocated": 2}, "ELSE": {"fatalities_unlocated": 99}}}, "updated": {"counts": {"vehicles": 99}}}
    out = routes.run(spark, "loading", redeclared(root, tmp_path, baselines=good), str(tmp_path / "good"))
    details = {n: d for n, _, d in out.checks}
    assert details["injuries"] == "5 against 5" and details["injuries_unlocated"] == "2 against 2" and details["fatalities_unlocated"] == "0, FIRST MEASUREMENT"
    with pytest.raises(routes.RouteFailed, match="4 against 99"):
        routes.run(spark, "loading", redeclared(root, tmp_path, baselines=good, edition="updated"), str(tmp_path / "bad"))
    new = routes.run(spark, "loading", redeclared(root, tmp_path, baselines=good, edition="next"), str(tmp_path / "new"))
    assert all(d.endswith("FIRST MEASUREMENT") for _, _, d in new.checks)
    with pytest.raises(city.DeclarationError, match="vehicles"):
        city.city(redeclared(root, tmp_path, baselines={"original": {"scales": {"PAIR": {"vehicles": 4}}}}))


@pytest.mark.parametrize("name", list(routes.ROUTES))
def test_routes_over_a_city(spark, root, tmp_path, name):
    out = routes.run(spark, name, root, str(tmp_path), dump=name == "affected")
    assert out.files and all(ok for _, ok, _ in out.checks)
    if name == "affected":
        assert sorted((r.FORMULARIO, r.PARTY_TYPE, r.COUNTERPART_TYPE) for r in out.tables["affected_parties"].collect())[:2] == [("a", "CAR", "MOTORCYCLE"), ("a", "MOTORCYCLE", "CAR")]
        dumped = next(f for f in out.files if f.endswith("intermediate/party_universe.parquet"))
        assert spark.read.parquet(dumped).count() == out.intermediates["party_universe"].count()
    if name == "casualty_matrix":
        assert out.tables["matrix_long"].agg(F.sum("PERSONS_KILLED"), F.sum("PERSONS_INJURED")).first() == (1, 3)
        back = sinks.reread(spark, next(f for f in out.files if f.endswith("crosstab_persons_injured.csv")), out.tables["crosstab_persons_injured"])
        assert sorted(map(str, back.collect())) == sorted(map(str, out.tables["crosstab_persons_injured"].collect()))
    if name == "integration":
        dead, hurt = (spark.read.parquet(next(f for f in out.files if f.endswith(f"{t}_by_year"))) for t in ("fatalities", "injuries"))
        assert [r.CODIGO_ACC for r in dead.collect()] == ["p3"] and sorted(r.CODIGO_ACC for r in hurt.collect()) == ["p1", "p2", "p4", "p9"]
        assert out.ledger.steps == ["replace a year of fatalities", "replace a year of injuries"]
        # The layers written are sources in turn: a city that declares them has the people of the rebuilt years in the same units.
        after = tmp_path / "after"
        shutil.copytree(root, after)
        declared = json.loads((after / "city.json").read_text()) | {n: next(f for f in out.files if f.endswith(f"{n}_by_year")) for n in ("fatalities", "injuries")}
        for n in ("fatalities", "injuries"):
            shutil.copytree(declared[n], after / "people" / f"{n}.parquet")
            declared[n] = f"people/{n}.parquet"
        (after / "city.json").write_text(json.dumps(declared))
        again = {(r.CODIGO_ACC, r.YEAR, r.AREA_CODE, r.KILLED, str(r.FECHA_OCUR)) for r in city.casualties(spark, str(after)).collect()}
        assert again == {("p1", 2020, "01", 0, "2020-01-01 00:00:00"), ("p2", 2020, "01", 0, "2020-01-01 00:00:00"), ("p3", 2021, "02", 1, "2021-03-01 00:00:00"), ("p4", 2021, "02", 0, "2021-03-01 00:00:00"), ("p9", 2021, "02", 0, "2021-03-01 00:00:00")}
        assert all(ok for _, ok, _ in routes.run(spark, "loading", str(after), str(tmp_path / "again")).checks)
    if name == "urban_predictors":
        assert {n for n, _, _ in out.checks} >= {"every declared source exists", "correlation diagonal is 1", "correlations are symmetric", "dictionary and measured predictors agree", "dictionary covers the wide table", "dictionary and tables agree on units"}
        got = {(r.AREA_CODE, r.PREDICTOR_FAMILY): (r.VALUE, r.MEASURE) for r in out.tables["predictors_long"].collect()}
        assert got["01", "area"][0] == pytest.approx(0.5, abs=1e-4) and got["02", "area"][0] == pytest.approx(0.5, abs=1e-3)
        assert got["01", "point"][1] == 1 and got["02", "point"][1] == 1


def test_sources_that_are_missing_or_of_another_kind(spark, root, tmp_path):
    stray = predictors.Predictor("X", "X", "nowhere", "x.shp", "area", "area_share")
    with pytest.raises(FileNotFoundError, match="X: the declared source"):
        city.predictor_layers(spark, root, (stray,))
    assert city.missing_sources(root, (*predictors.STATIC, stray)) == ["X"] and not checks.sources(["X"], 11)[0][1]
    bus = next(p for p in predictors.STATIC if p.geometry == "point")
    with pytest.raises(spatial.GeometryError):
        city.predictor_layers(spark, root, (predictors.Predictor("X", "X", bus.layer, bus.file, "area", "area_share"),))


def test_checks_find_a_wrong_dictionary_and_correlations(spark):
    wide = spark.createDataFrame([("S", "1", "n", 1.0, 1.0, 2.0), ("S", "2", "n", 1.0, 3.0, 1.0)], "SCALE string, AREA_CODE string, AREA_NAME string, AREA_UNIT_KM2 double, A double, B double")
    long = spark.createDataFrame([("A", "km2", "share"), ("B", "km2", "share")], "PREDICTOR string, MEASURE_UNIT string, VALUE_UNIT string")
    assert all(ok for _, ok, _ in checks.dictionary(long, long, wide))
    assert [ok for _, ok, _ in checks.dictionary(long.withColumn("VALUE_UNIT", F.lit("points")), long, wide)] == [True, True, False]
    assert [ok for _, ok, _ in checks.dictionary(long.filter("PREDICTOR = 'A'"), long, wide)] == [False, False, False]
    rows = [("A", "A", 1.0), ("B", "B", None), ("A", "B", 0.5), ("B", "A", 0.5)]
    square = lambda r: spark.createDataFrame(r, "PREDICTOR_A string, PREDICTOR_B string, CORRELATION double")
    assert [ok for _, ok, _ in checks.symmetry(square(rows))] == [True, True]
    assert [ok for _, ok, _ in checks.symmetry(square([("A", "A", 0.9), ("A", "B", 0.5), ("B", "A", 0.4)]))] == [False, False]


def test_polygons_that_cross_themselves_are_repaired(spark):
    ring = lambda *points: (False, [tuple(map(float, p)) for p in points])
    features = [
        (1, [ring((0, 0), (2, 2), (2, 0), (0, 2))]),  # a bow tie
        (2, [ring((0, 0), (4, 0), (4, 4), (0, 4))]),  # valid
        (3, [ring((0, 3), (6, 3), (1, 6.5), (3, 0), (5, 6.5))]),  # a pentagram, whose middle is reached over two edges
        (4, [ring((0, 0), (4, 0), (4, 4), (0, 4)), (True, [(3.0, 1.0), (5.0, 1.0), (5.0, 3.0), (3.0, 3.0)])]),  # a hole that leaves its ring
        (5, [ring((0, 0), (2, 0), (2, 0), (0, 0))]),  # no area
    ]
    fixed = validity.repaired(spark.createDataFrame(features, f"id int, rings {spatial.RINGS}"))
    got = {r.id: r.a for r in fixed.select("id", spatial.area(F.col("rings")).alias("a")).collect()}

    def inside(rings, x, y):
        odd = False
        for _, points in rings:
            for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
                odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return odd

    for key, rings in features[:4]:
        n = 200
        share = sum(inside(rings, (i + 0.51) * 7 / n, (j + 0.49) * 7 / n) for i in range(n) for j in range(n)) * 49 / n / n
        assert got[key] == pytest.approx(share, rel=0.03), key
    assert got[1] == pytest.approx(2) and got[2] == 16 and got[4] == pytest.approx(16 - 2 + 2)
