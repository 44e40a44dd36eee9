"""One query per operator over the adapter's data model, and the same result as SQL by another formulation where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.domains import CITY_LEVEL, COUNTERPARTS, FATALITY, INJURY, PAIR_LABELS, PAIRS, TYPES, Scale, Study, declared, ranked
from loomgrid.functions import scalars as sc
from loomgrid.ledger import Ledger
from loomgrid.operators import cells, checks, completeness, grid, integrate, matrix, models, overlay, parties, predictors, rho, spatial, validity
from loomgrid.plans import sinks
from loomgrid.sources import adapter as ad
from loomgrid.sources import wkb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f"op_{name}"] = f
        if sql:
            ORACLE_SQL[f"op_{name}"] = BASE + sql
        return f

    return register


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


REPLACED = 1998
BASE = f"""
with types(p_type, t) as (values ('SMALL', 'PEDESTRIAN'), ('ECONOMY', 'BICYCLE'), ('PROMO', 'MOTORCYCLE'), ('MEDIUM', 'CAR'), ('LARGE', 'PUBLIC_TRANSPORT'), ('STANDARD', 'OTHER')),
tl(t, r) as (values {_values([(t, i) for i, t in enumerate(TYPES)])}),
cl(c, r) as (values {_values([(t, i) for i, t in enumerate(COUNTERPARTS)])}),
pl(pair, a, b) as (values {_values([("-".join(p), *p) for p in PAIRS])}),
yl as (select unnest(range(1995, 2002))::int as y),
units as (select lpad(n_nationkey::varchar, 2, '0') as code, n_name as name from nation),
cas as (
    select l_orderkey as crash, l_orderkey || '-' || l_linenumber as person, case when round(l_discount, 2) = 0.0 then null when round(l_discount, 2) = 0.1 then -1 - l_partkey else l_partkey end as veh,
           case o_orderpriority when '1-URGENT' then 'PEDESTRIAN' when '2-HIGH' then 'MOTORCYCLE' when '3-MEDIUM' then 'BICYCLE' else 'OTHER' end as role_type, o_orderpriority as prio,
           o_orderstatus as class, year(o_orderdate)::int as yr, l_shipdate as dt, case when n_regionkey <> 4 then lpad(n_nationkey::varchar, 2, '0') end as code, case when n_regionkey <> 4 then n_name end as name,
           case when l_returnflag = 'R' and l_linestatus = 'F' then 'FATALITY' else 'INJURY' end as src, (l_returnflag <> 'R' or l_linestatus <> 'F')::int as inj, (l_returnflag = 'R' and l_linestatus = 'F')::int as kil
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_returnflag in ('A', 'R')),
allveh as (select distinct l_orderkey as crash, l_partkey as veh, t from lineitem join part on p_partkey = l_partkey join types using (p_type)),
veh as (select * from allveh where crash in (select crash from cas)),
hurt as (select c.*, v.t as vt, row_number() over () as rid from cas c left join veh v on v.crash = c.crash and v.veh = c.veh),
parties as (
    select v.crash, 'V' || v.veh as pid, v.t as ptype, coalesce(sum(inj), 0)::bigint as inj, coalesce(sum(kil), 0)::bigint as kil from veh v left join cas c on c.crash = v.crash and c.veh = v.veh group by all
    union all select crash, 'P' || rid, role_type, inj, kil from hurt where vt is null),
sized as (select *, count(*) over (partition by crash) as n from parties),
kept as (select * from sized where n <= 2),
res as (select a.*, coalesce(b.ptype, 'SELF') as cp from kept a left join kept b on b.crash = a.crash and b.pid <> a.pid),
attrs as (select crash, min(yr) as yr, min(class) as class, min(code) as code, min(name) as name from cas group by crash),
aff as (select r.*, t.yr, t.class, t.code, t.name from res r join attrs t using (crash) where inj + kil > 0),
mat as (
    select u.code, u.name, y, tl.t as pt, c as cp, count(a.crash)::bigint as np, coalesce(sum(inj), 0)::bigint as ni, coalesce(sum(kil), 0)::bigint as nk
    from units u cross join yl cross join tl cross join cl left join aff a on a.code = u.code and a.yr = y and a.ptype = tl.t and a.cp = cl.c group by all),
two as (
    select a.crash, a.ptype as ta, b.ptype as tb, a.inj + a.kil > 0 and b.inj + b.kil > 0 as hit
    from kept a join tl ra on ra.t = a.ptype join kept b on b.crash = a.crash and b.pid <> a.pid join tl rb on rb.t = b.ptype where ra.r < rb.r or (ra.r = rb.r and a.pid < b.pid)),
why as (select *, case when 'OTHER' in (ta, tb) then 'RESIDUAL' when ta = tb then 'SAME_TYPE' when ta in ('MOTORCYCLE', 'CAR', 'PUBLIC_TRANSPORT') or tb in ('MOTORCYCLE', 'CAR', 'PUBLIC_TRANSPORT') then 'KEPT' else 'NO_PRIMARY' end as reason from two),
put as (select w.*, ta || '-' || tb as pair, t.yr, t.code from why w join attrs t using (crash) where reason = 'KEPT' and code is not null),
rl as (
    select 'UNIT' as lvl, u.code, u.name, y, pl.pair, a, b, count(p.crash)::bigint as d, count(p.crash) filter (where hit)::bigint as n from units u cross join yl cross join pl left join put p on p.code = u.code and p.yr = y and p.pair = pl.pair group by all
    union all select 'CITY', 'CITY', 'Whole city', y, pl.pair, a, b, count(p.crash)::bigint, count(p.crash) filter (where hit)::bigint from yl cross join pl left join put p on p.yr = y and p.pair = pl.pair group by all),
rr as (select *, case when d > 0 then n / d end as rho from rl),
mon as (
    select src, y, m, (select count(*) from cas c where c.src = s.src and c.yr = y and month(c.dt) = m)::bigint as n from (values ('FATALITY'), ('INJURY')) s(src) cross join yl cross join (select unnest(range(1, 13))::int as m)),
mo as (select *, median(n) over (partition by src, y) as med from mon),
mf as (select *, case when med > 0 then n / med end as sh, n = 0 as e from mo),
box as (select i, j, 'U' || lpad((i * 6 + j)::varchar, 2, '0') as code, i * 100.0::double as x0, i * 100.0::double + 100 as x1, j * 4.0::double as y0, j * 4.0::double + 4 as y1 from (select unnest(range(5)) as i), (select unnest(range(6)) as j)),
pts as (select event_id as id, value as x, hour(ts) + minute(ts) / 60.0::double as y from events),
lay as (select p_partkey as id, p_partkey % 480 + 0.25::double as x0, p_partkey % 480 + 0.25::double + p_size as x1, p_partkey % 23 + 0.5::double as y0, p_partkey % 23 + 2.0::double as y1 from part),
ov as (select id, code, greatest(least(l.x1, b.x1) - greatest(l.x0, b.x0), 0) * greatest(least(l.y1, b.y1) - greatest(l.y0, b.y0), 0) as s from lay l join box b on l.x1 > b.x0 and l.x0 < b.x1 and l.y1 > b.y0 and l.y0 < b.y1),
pn(k, name, kind) as (values {_values([(i, p.name, p.geometry) for i, p in enumerate(predictors.STATIC)])}),
ms as (
    select b.code, pn.name, pn.kind, case when kind = 'area' then coalesce((select sum(s) from ov where ov.code = b.code and id % 5 = k), 0) / 1e6::double
        else (select count(*) from pts p where p.id % 5 = k - 5 and x > x0 and x < x1 and y > y0 and y < y1) end::double as m, case when b.code <> 'U29' then 0.0004::double else 0 end as km2 from box b cross join pn),
pv as (select code, name, kind, km2, case when km2 > 0 then m end as m, case when km2 > 0 then m / km2 end as v from ms),
prev as (select person, crash, code, veh from cas where src = 'INJURY' and yr = {REPLACED}),
inc as (
    select case when crash % 11 = 2 then 'N' || person else person end as person, crash, case when crash % 11 = 1 then case src when 'INJURY' then 'FATALITY' else 'INJURY' end else src end as src,
           case when crash % 11 = 3 then null when crash % 11 = 4 then '00' else code end as code, case when crash % 11 = 5 then -5 else veh end as veh from cas where yr = {REPLACED} and crash % 11 <> 0)
"""


# --- the model -----------------------------------------------------------------------------------------------------


def _universe(s: SparkSession, d: str) -> DataFrame:
    return parties.party_universe(ad.casualties(s, d), ad.vehicles(s, d), count=ad.line_count(s, d))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return parties.resolve_counterparts(_universe(s, d))


def _attributes(s: SparkSession, d: str) -> DataFrame:
    return parties.crash_attributes(ad.casualties(s, d))


def _affected(s: SparkSession, d: str) -> DataFrame:
    return parties.affected_parties(_resolved(s, d), _attributes(s, d))


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return matrix.long_table(_affected(s, d), ad.study(s, d))


def _placed(s: SparkSession, d: str) -> DataFrame:
    return rho.placed(rho.restrict(rho.crash_pairs(_universe(s, d))), _attributes(s, d))


def _rho(s: SparkSession, d: str) -> DataFrame:
    return rho.long_table(_placed(s, d), ad.study(s, d))


def _months(s: SparkSession, d: str) -> DataFrame:
    return completeness.monthly_table(ad.casualties(s, d), ad.YEARS)


def _boxes(s: SparkSession) -> DataFrame:
    n = s.range(30).withColumns({"i": F.floor(F.col("id") / 6), "j": F.col("id") % 6})
    return n.select(F.concat(F.lit("U"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("AREA_CODE"), spatial.box(F.col("i") * 100, F.col("j") * 4, F.col("i") * 100 + 100, F.col("j") * 4 + 4).alias("rings"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return ad.read(s, d, "events").select(F.col("event_id").alias("p_id"), F.col("value").alias("x"), (F.hour("ts") + F.minute("ts") / 60.0).alias("y"))


def _layer(s: SparkSession, d: str) -> DataFrame:
    k, w = F.col("p_partkey"), F.col("p_size")
    return ad.read(s, d, "part").select(k.alias("id"), spatial.box(k % 480 + 0.25, k % 23 + 0.5, k % 480 + 0.25 + w, k % 23 + 2.0).alias("rings"))


def _predictor_study(s: SparkSession) -> Study:
    return Study(Scale("BOX", 30), _boxes(s).select("AREA_CODE", F.col("AREA_CODE").alias("AREA_NAME")), ())


def _predictors(s: SparkSession, d: str) -> DataFrame:
    boxes, layer = _boxes(s), _layer(s, d)
    points = _points(s, d).select(F.col("p_id").alias("id"), F.array(F.struct("x", "y")).alias("points"))
    layers = {p.name: (layer.filter(F.col("id") % 5 == i) if p.geometry == "area" else points.filter(F.col("id") % 5 == i - 5)) for i, p in enumerate(predictors.STATIC)}
    areas = boxes.select("AREA_CODE", F.when(F.col("AREA_CODE") == "U29", 0.0).otherwise(spatial.area(F.col("rings")) / predictors.M2_PER_KM2).alias("AREA_UNIT_KM2"))
    return predictors.long_table(predictors.measure(layers, boxes, tile=50.0), _predictor_study(s), areas, check=False)


def _incoming(s: SparkSession, d: str) -> DataFrame:
    """An updated extract of one year: of every eleven crashes one is gone, one changed severity, one has new people, two moved, one lost its vehicles."""
    c, k = ad.casualties(s, d).filter(F.col("YEAR") == REPLACED), F.col("FORMULARIO") % 11
    return c.filter(k != 0).withColumns({
        "PERSON": F.when(k == 2, F.concat(F.lit("N"), "CODIGO_ACC")).otherwise(F.col("CODIGO_ACC")),
        "CASUALTY_SOURCE": F.when(k == 1, F.when(F.col("CASUALTY_SOURCE") == INJURY, FATALITY).otherwise(INJURY)).otherwise(F.col("CASUALTY_SOURCE")),
        "AREA_CODE": F.when(k == 3, None).when(k == 4, "00").otherwise(F.col("AREA_CODE")),
        "CODIGO_VEH": F.when(k == 5, -5).otherwise(F.col("CODIGO_VEH")),
    })


def _previous(s: SparkSession, d: str) -> DataFrame:
    return ad.casualties(s, d).filter((F.col("YEAR") == REPLACED) & (F.col("CASUALTY_SOURCE") == INJURY)).withColumn("PERSON", F.col("CODIGO_ACC"))


# --- sources and filters -----------------------------------------------------------------------------------------


@query("SRC1", "select code as AREA_CODE, name as AREA_NAME from units")
def _(s, d):
    return ad.units(s, d)


_SRC2 = """
    select id as p_id, k as KIND, n as POINTS, sx as X, sy as Y, a as AREA from (
        select id, 'POINT' as k, 1::bigint as n, x as sx, y as sy, 0.0::double as a from pts
        union all select -1 - id, case id % 3 when 0 then 'POLYGON' when 1 then 'MULTIPOLYGON' else 'MULTIPOINT' end, case id % 3 when 0 then 4 when 1 then 8 else 2 end,
            case id % 3 when 0 then 2 * (x0 + x1) when 1 then 4 * (x0 + x1) + 4 * 1000 else x0 + x1 end, case id % 3 when 0 then 2 * (y0 + y1) when 1 then 4 * (y0 + y1) else y0 + y1 end,
            case id % 3 when 0 then 1 when 1 then 2 else 0 end * (x1 - x0) * (y1 - y0) from lay)"""


@query("SRC2", _SRC2)
def _(s, d):
    """Points of one table and polygons, of one part and of two, and pairs of points of another, as well-known binary in both byte orders, decoded."""
    points = _points(s, d).select("p_id", F.lit("POINT").alias("geom_type"), F.array(F.struct("x", "y")).alias("points"), F.lit(None).cast(spatial.RINGS).alias("rings"))
    east = F.transform("rings", lambda r: F.struct(r["hole"].alias("hole"), F.transform(r["points"], lambda p: F.struct((p["x"] + 1000).alias("x"), p["y"].alias("y"))).alias("points")))
    corners = F.col("rings")[0]["points"]
    kind = F.element_at(F.array(*map(F.lit, ("POLYGON", "MULTIPOLYGON", "MULTIPOINT"))), (F.col("id") % 3 + 1).cast("int"))
    shapes = _layer(s, d).select((-1 - F.col("id")).alias("p_id"), kind.alias("geom_type"), F.when(F.col("id") % 3 == 2, F.array(corners[0], corners[2])).alias("points"), F.when(F.col("id") % 3 == 0, F.col("rings")).when(F.col("id") % 3 == 1, F.concat("rings", east)).alias("rings"))
    back = wkb.decode(wkb.encode(points).unionByName(wkb.encode(shapes, order=">")))
    held = F.coalesce("points", F.flatten(F.transform("rings", lambda r: r["points"])))
    total = lambda c: F.aggregate(held, F.lit(0.0), lambda acc, p: acc + p[c])
    return back.select("p_id", F.col("geom_type").alias("KIND"), F.size(held).cast("long").alias("POINTS"), total("x").alias("X"), total("y").alias("Y"), F.coalesce(spatial.area(F.col("rings")), F.lit(0.0)).alias("AREA"))


@query("SRC3", "select src as CASUALTY_SOURCE, count(*) as n, count(*) filter (where code is null) as unlocated from cas group by src")
def _(s, d):
    return ad.casualties(s, d).groupBy("CASUALTY_SOURCE").agg(F.count("*").alias("n"), F.count_if(F.col("AREA_CODE").isNull()).alias("unlocated"))


@query("SRC4", "select count(*) - (select count(*) from (select distinct l_orderkey, l_partkey from lineitem)) as DUPLICATED, 0::bigint as UNMAPPED, count(*) filter (where p_type in ('SMALL', 'PROMO', 'MEDIUM', 'LARGE', 'STANDARD')) as RESCUED, 0::bigint as NULL_CLASS from lineitem join part on p_partkey = l_partkey")
def _(s, d):
    from loomgrid.sources.readers import vehicle_profile

    return vehicle_profile(ad.vehicles(s, d))


@query("FLT1", "select crash as FORMULARIO, veh as CODIGO_VEHICULO from veh")
def _(s, d):
    v = ad.vehicles(s, d)
    return v.join(ad.casualties(s, d).select("FORMULARIO"), "FORMULARIO", "left_semi").select("FORMULARIO", "CODIGO_VEHICULO").distinct()


@query("FLT2", "select count(*) as n from cas where veh is not null")
def _(s, d):
    return ad.casualties(s, d).na.drop(subset=["CODIGO_VEH"]).agg(F.count("*").alias("n"))


@query("FLT3", "select crash as FORMULARIO, count(*) as PARTIES from kept group by crash")
def _(s, d):
    return parties.within_threshold(_universe(s, d)).groupBy("FORMULARIO").agg(F.count("*").alias("PARTIES"))


@query("FLT4", "select crash as FORMULARIO, ptype as PARTY_TYPE, inj as PERSONS_INJURED, kil as PERSONS_KILLED from kept where inj + kil > 0")
def _(s, d):
    return _resolved(s, d).filter(F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") > 0).select("FORMULARIO", "PARTY_TYPE", "PERSONS_INJURED", "PERSONS_KILLED")


@query("FLT5", "select crash as FORMULARIO, code as AREA_CODE, ptype as PARTY_TYPE from aff where code is not null")
def _(s, d):
    return matrix.located(_affected(s, d)).select("FORMULARIO", "AREA_CODE", "PARTY_TYPE")


@query("FLT6", "select distinct crash as FORMULARIO from kept where n = 2")
def _(s, d):
    return parties.with_party_count(_universe(s, d)).filter("PARTIES = 2").select("FORMULARIO").distinct()


@query("FLT7", "select reason as REASON, count(*) as n from why group by reason")
def _(s, d):
    return rho.with_reason(rho.crash_pairs(_universe(s, d))).groupBy("REASON").agg(F.count("*").alias("n"))


@query("FLT8", "select count(*) filter (where src = 'FATALITY') as fatal, count(*) filter (where src = 'INJURY') as injured from inc")
def _(s, d):
    fatal, injured = integrate.split_by_severity(_incoming(s, d).withColumn("MUERTE_POS", F.when(F.col("CASUALTY_SOURCE") == FATALITY, 1)))
    return fatal.agg(F.count("*").alias("fatal")).crossJoin(injured.agg(F.count("*").alias("injured")))


@query("FLT9", f"select case when crash % 13 = 0 then null else yr end as YEAR, count(*) as n from cas where crash % 13 = 0 or yr <> {REPLACED} group by all")
def _(s, d):
    layer = ad.casualties(s, d).withColumn("YEAR", F.when(F.col("FORMULARIO") % 13 != 0, F.col("YEAR")))
    return layer.filter(~F.col("YEAR").eqNullSafe(F.lit(REPLACED))).groupBy("YEAR").agg(F.count("*").alias("n"))


@query("FLT10", "select id from lay where id % 7 <> 0")
def _(s, d):
    layer = _layer(s, d).withColumn("rings", F.when(F.col("id") % 7 != 0, F.col("rings")))
    return predictors.usable(layer).select("id")


@query("FLT11", """, part as (select src, yr, month(dt)::int as m, count(*) as n from cas where month(dt) <> 2 and (month(dt) <> 3 or crash % 4 = 0) group by all),
    whole as (select src, y, m, coalesce(n, 0)::bigint as n from (select distinct src, y, m from mon) left join (select src, yr as y, m, n from part) using (src, y, m))
    select src as CASUALTY_SOURCE, y as YEAR, m as MONTH, n as RECORDS from (select *, median(n) over (partition by src, y) as med from whole) where n = 0 or n < 0.5 * med""")
def _(s, d):
    month = F.month("FECHA_OCUR")  # no record is left of February, and of March those of every fourth crash
    gappy = ad.casualties(s, d).filter((month != 2) & ((month != 3) | (F.col("FORMULARIO") % 4 == 0)))
    return completeness.flagged(completeness.monthly_table(gappy, ad.YEARS)).select("CASUALTY_SOURCE", "YEAR", "MONTH", "RECORDS")


@query("FLT12", "select name as PREDICTOR, count(*) as UNITS_AT_ZERO, case when name in ('SIDEWALK_AREA_SHARE', 'ARTERIAL_ROAD_AREA_SHARE', 'ROADWAY_AREA_SHARE', 'PEDESTRIAN_CROSSING_DENSITY') then 'IMPLAUSIBLE' else 'MEASURED ZERO' end as READING from pv where v = 0 group by name")
def _(s, d):
    return predictors.zeros(_predictors(s, d))


@query("FLT12_units", """select name as PREDICTOR, count(*) as UNITS_AT_ZERO, string_agg(code || ' ' || code, ', ' order by code) as UNITS, case when name in ('SIDEWALK_AREA_SHARE', 'ARTERIAL_ROAD_AREA_SHARE', 'ROADWAY_AREA_SHARE', 'PEDESTRIAN_CROSSING_DENSITY') then 'IMPLAUSIBLE' else 'MEASURED ZERO' end as READING
    from pv where v = 0 group by name""")
def _(s, d):
    return predictors.zero_report(_predictors(s, d))


@query("FLT13", "select pair as PAIR, count(*) as CELLS, count(*) filter (where d < 10) as SPARSE, count(*) filter (where d = 0) as EMPTY, median(d)::double as MEDIAN_CRASHES from rl where lvl = 'UNIT' group by pair")
def _(s, d):
    return rho.sparse_cells(_rho(s, d))


# --- projections and scalar functions ----------------------------------------------------------------------------


@query("PRJ1", "select crash as FORMULARIO, ptype as PARTY_TYPE, cp as COUNTERPART_TYPE, 1::bigint as AFFECTED_PARTIES, inj as PERSONS_INJURED, kil as PERSONS_KILLED, code as AREA_CODE, name as AREA_NAME, yr as YEAR, class as CRASH_CLASS from aff")
def _(s, d):
    return _affected(s, d).drop("PARTY_ID")


@query("PRJ2", "select 'BOX' as SCALE, code as AREA_CODE, name as PREDICTOR, null::int as YEAR from pv")
def _(s, d):
    return _predictors(s, d).select("SCALE", "AREA_CODE", "PREDICTOR", "YEAR")


@query("PRJ3", "select p_type, t as PARTY_TYPE, count(*) as n from part join types using (p_type) group by all")
def _(s, d):
    part = ad.read(s, d, "part").withColumn("PARTY_TYPE", sc.type_of_class(sc.lookup(F.col("p_type"), ad.CLASS_OF_PART)))
    return part.groupBy("p_type", "PARTY_TYPE").agg(F.count("*").alias("n"))


@query("SC1", "select * from (values ('SMALL', 'PEATON'), ('ECONOMY', 'BICICLETA'), ('PROMO', 'MOTOCICLETA'), ('MEDIUM', 'AUTOMOVIL'), ('LARGE', 'BUS ARTICULADO'), ('STANDARD', 'CAMION, FURGON')) v(p_type, CLASS) where p_type in (select p_type from part)")
def _(s, d):
    return ad.read(s, d, "part").select("p_type").distinct().withColumn("CLASS", sc.normal_class(sc.lookup(F.col("p_type"), ad.CLASS_OF_PART)))


_WIDE = ("".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F))))  # plain and full-width letters


@query("SC1_wide", "select p_partkey, case p_type when 'SMALL' then 'PEATON' when 'ECONOMY' then 'BICICLETA' when 'PROMO' then 'MOTOCICLETA' when 'MEDIUM' then 'AUTOMOVIL' when 'LARGE' then 'BUS ARTICULADO' when 'STANDARD' then 'CAMION, FURGON' else 'NAN' end || case when p_partkey % 5 = 0 and p_type is not null then ' OFFICIAL 12' else '' end as CLASS from part")
def _(s, d):
    """Classes of all parts, every third written in full-width letters and every fifth with a ligature and a number in a circle."""
    k, raw = F.col("p_partkey"), sc.lookup(F.col("p_type"), ad.CLASS_OF_PART)
    drawn = F.when(k % 3 == 0, F.translate(raw, *_WIDE)).otherwise(raw)
    return ad.read(s, d, "part").select("p_partkey", sc.normal_class(F.when(k % 5 == 0, F.concat(drawn, F.lit("\u2003o\ufb03cial \u246b"))).otherwise(drawn)).alias("CLASS"))


@query("SC2", "select c_custkey, c_custkey::varchar as key from customer")
def _(s, d):
    return ad.read(s, d, "customer").select("c_custkey", sc.text_key(F.concat(F.lit(" "), F.col("c_custkey").cast("decimal(20,1)").cast("string"), F.lit(""))).alias("key"))


@query("SC3", "select crash as FORMULARIO, pid as PARTY_ID from parties where pid like 'V%'")
def _(s, d):
    return _universe(s, d).filter(F.col("PARTY_ID").startswith("V")).select("FORMULARIO", "PARTY_ID")


@query("SC4", "select ta || '-' || tb as PAIR, ta as SIDE_A, tb as SIDE_B, count(*) as n from put group by all")
def _(s, d):
    sides = F.split("PAIR", "-")
    return _placed(s, d).groupBy("PAIR").agg(F.count("*").alias("n")).select("PAIR", sides[0].alias("SIDE_A"), sides[1].alias("SIDE_B"), "n")


@query("SC5", "select ta || '-' || tb as PAIR, count(*) as n from why where reason = 'KEPT' group by 1")
def _(s, d):
    return rho.restrict(rho.crash_pairs(_universe(s, d))).groupBy("PAIR").agg(F.count("*").alias("n"))


@query("SC6", "select event_id, case when event_id % 3 <> 0 then ts end as at from events")
def _(s, d):
    text = F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return ad.read(s, d, "events").select("event_id", sc.utc_timestamp(text).alias("at"))


@query("SC7", "select src as CASUALTY_SOURCE, count(*) as ROWS, 0::bigint as UNDATED, count(*) filter (where yr <> year(dt)) as DISAGREEING from cas group by src")
def _(s, d):
    return completeness.date_profile(ad.casualties(s, d))


@query("SC8", "select count(*) as n, count(try_cast(replace(c_mktsegment, 'BUILDING', '1') as double)) as numbers from customer")
def _(s, d):
    return ad.read(s, d, "customer").agg(F.count("*").alias("n"), F.count(F.replace("c_mktsegment", F.lit("BUILDING"), F.lit("1")).try_cast("double")).alias("numbers"))


@query("SC9", "select lvl as AGGREGATION_LEVEL, code as AREA_CODE, y as YEAR, pair as PAIR, rho as RHO from rr")
def _(s, d):
    return _rho(s, d).select("AGGREGATION_LEVEL", "AREA_CODE", "YEAR", "PAIR", "RHO")


@query("SC10", "select code as AREA_CODE, name as PREDICTOR, case when km2 > 0 then 'MEASURED' else 'NOT_MEASURED' end as VALUE_STATUS from pv")
def _(s, d):
    return _predictors(s, d).select("AREA_CODE", "PREDICTOR", "VALUE_STATUS")


@query("SC11", "select code as AREA_CODE, y as YEAR, sum(np)::bigint as PARTIES from mat group by all")
def _(s, d):
    return _matrix(s, d).groupBy("AREA_CODE", "YEAR").agg(F.sum("AFFECTED_PARTIES").alias("PARTIES"))


@query("SC13", "select s_suppkey, case when s_acctbal <= 0 then 2 when s_acctbal >= 100 then 0 when s_acctbal >= 10 then 1 when s_acctbal >= 1 then 2 when s_acctbal >= 0.1 then 3 else 4 end::int as DECIMALS from supplier")
def _(s, d):
    return ad.read(s, d, "supplier").select("s_suppkey", sc.decimals(F.col("s_acctbal")).alias("DECIMALS"))


@query("SC14", "select code as AREA_CODE, name as PREDICTOR, case when v is null then '-' when kind = 'area' then printf('%.4f', v) else printf('%.2f', v) end as SHOWN from pv where kind = 'point'")
def _(s, d):
    long = _predictors(s, d).filter(F.col("PREDICTOR_FAMILY") == "point")
    return long.select("AREA_CODE", "PREDICTOR", sc.shown(F.col("VALUE"), F.col("PREDICTOR_FAMILY")).alias("SHOWN"))


@query("SC15", "select replace(replace(replace(replace(pair, 'PEDESTRIAN', 'PED'), 'BICYCLE', 'BIC'), 'MOTORCYCLE', 'MOT'), 'PUBLIC_TRANSPORT', 'PUB') as SHORT, yr as YEAR, count(*) as n from put group by all")
def _(s, d):
    return _placed(s, d).groupBy(sc.short_pair(F.col("PAIR")).alias("SHORT"), "YEAR").agg(F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------


@query("JN1", "select vt is not null as RESOLVED, coalesce(vt, role_type) as PARTY_TYPE, count(*) as n from hurt group by all")
def _(s, d):
    v = ad.vehicles(s, d).select("FORMULARIO", F.col("CODIGO_VEHICULO").alias("CODIGO_VEH"), sc.type_of_class(F.col("CLASE")).alias("t")).distinct()
    joined = ad.casualties(s, d).join(v, ["FORMULARIO", "CODIGO_VEH"], "left")
    return joined.groupBy(F.col("t").isNotNull().alias("RESOLVED"), F.coalesce("t", sc.type_of_role(F.col("CONDICION"))).alias("PARTY_TYPE")).agg(F.count("*").alias("n"))


@query("JN2", "select crash as FORMULARIO, ptype as PARTY_TYPE, inj as PERSONS_INJURED, kil as PERSONS_KILLED from parties")
def _(s, d):
    return _universe(s, d).drop("PARTY_ID")


@query("JN3", "select crash as FORMULARIO, ptype as PARTY_TYPE, yr as YEAR, class as CRASH_CLASS from aff")
def _(s, d):
    return _affected(s, d).select("FORMULARIO", "PARTY_TYPE", "YEAR", "CRASH_CLASS")


@query("JN4", "select code as AREA_CODE, y as YEAR, pt as PARTY_TYPE, cp as COUNTERPART_TYPE, np as AFFECTED_PARTIES from mat")
def _(s, d):
    return _matrix(s, d).select(*matrix.KEYS, "AFFECTED_PARTIES")


@query("JN5", "select distinct code as AREA_CODE, yr as YEAR, ptype as PARTY_TYPE, cp as COUNTERPART_TYPE from aff where code is not null and yr not between 1995 and 1999")
def _(s, d):
    study = ad.study(s, d)
    short = Study(study.scale, study.units, tuple(range(1995, 2000)))
    return grid.outside(matrix.cells(_affected(s, d)), matrix.grid(short), matrix.KEYS).select(*matrix.KEYS)


@query("JN6", "select code as AREA_CODE, name as AREA_NAME, sum(np)::bigint as PARTIES from mat group by all")
def _(s, d):
    return _matrix(s, d).groupBy("AREA_CODE", "AREA_NAME").agg(F.sum("AFFECTED_PARTIES").alias("PARTIES"))


@query("JN7", "select crash as FORMULARIO, pair as PAIR, hit as BOTH_AFFECTED, yr as YEAR, code as AREA_CODE from put")
def _(s, d):
    return _placed(s, d).select("FORMULARIO", "PAIR", "BOTH_AFFECTED", "YEAR", "AREA_CODE")


@query("JN8", "select lvl as AGGREGATION_LEVEL, code as AREA_CODE, y as YEAR, pair as PAIR, d as CRASHES_TOTAL from rl")
def _(s, d):
    return _rho(s, d).select("AGGREGATION_LEVEL", "AREA_CODE", "YEAR", "PAIR", "CRASHES_TOTAL")


@query("JN9", "select crash as FORMULARIO, ta as PAIR_TYPE_A, tb as PAIR_TYPE_B, hit as BOTH_AFFECTED from two")
def _(s, d):
    return rho.crash_pairs(_universe(s, d))


@query("JN10", "select code as AREA_CODE, name as PREDICTOR, m as MEASURE, v as VALUE from pv")
def _(s, d):
    return _predictors(s, d).select("AREA_CODE", "PREDICTOR", "MEASURE", "VALUE")


_PIVOT_SQL = ", ".join(f"max(v) filter (where name = '{p.name}') as {p.name}" for p in predictors.STATIC)


@query("JN11", f"select 'BOX' as SCALE, code as AREA_CODE, code as AREA_NAME, km2 as AREA_UNIT_KM2, {_PIVOT_SQL} from pv group by code, km2")
def _(s, d):
    return predictors.wide_table(_predictors(s, d))


@query("JN12", "select src as CASUALTY_SOURCE, y as YEAR, m as MONTH, n as RECORDS from mon")
def _(s, d):
    return _months(s, d).select("CASUALTY_SOURCE", "YEAR", "MONTH", "RECORDS")


@query("JN13", "select count(*) as REFERENCING, count(*) filter (where exists (select 1 from allveh a where a.crash = i.crash and a.veh = i.veh)) as RESOLVED, (count(*) filter (where exists (select 1 from allveh a where a.crash = i.crash and a.veh = i.veh)))::double / count(*) as RATE from inc i where veh is not null")
def _(s, d):
    return integrate.reference_rate(_incoming(s, d), ad.vehicles(s, d))


@query("JN14", "select count(*) as n from cas where crash in (select crash from sized where n > 2)")
def _(s, d):
    large = parties.with_party_count(_universe(s, d)).filter("PARTIES > 2").select("FORMULARIO")
    return ad.casualties(s, d).join(large, "FORMULARIO", "left_semi").agg(F.count("*").alias("n"))


@query("JN15", "select count(*) as n from prev p join inc i on i.person = p.person and i.src = 'INJURY'")
def _(s, d):
    now = _incoming(s, d).filter(F.col("CASUALTY_SOURCE") == INJURY)
    return _previous(s, d).select("PERSON").join(now.select("PERSON"), "PERSON").agg(F.count("*").alias("n"))


@query("SJ1", "select id as p_id, min(code) as AREA_CODE from pts left join box on x > x0 and x < x1 and y > y0 and y < y1 group by id")
def _(s, d):
    return cells.locate(_points(s, d), _boxes(s)).select("p_id", "AREA_CODE")


@query("SJ2", """, near as (
    select id, code, greatest(x0 - x, x - x1, 0) as dx, greatest(y0 - y, y - y1, 0) as dy, x, y, x0, x1, y0, y1 from pts, box where code < 'U12' and not exists (select 1 from box b where b.code < 'U12' and x > b.x0 and x < b.x1 and y > b.y0 and y < b.y1)),
    m as (select id, sqrt(dx * dx + dy * dy) as dist, code from near where sqrt(dx * dx + dy * dy) <= 5.0)
    select id as p_id, round(min(dist), 9) as DISTANCE, arg_min(code, (round(dist, 9), code)) as AREA_CODE from m group by id""")
def _(s, d):
    some = _boxes(s).filter("AREA_CODE < 'U12'")
    lost = cells.locate(_points(s, d), some).filter("AREA_CODE is null").drop("AREA_CODE")
    return cells.snap(lost, some, 5.0)


@query("SJ3", "select code as AREA_CODE, count(*) as n from pts join box on x > x0 and x < x1 and y > y0 and y < y1 group by code")
def _(s, d):
    return cells.locate(_points(s, d), _boxes(s), how="inner").groupBy("AREA_CODE").agg(F.count("*").alias("n"))


@query("SJ4", "select id, code as AREA_CODE, s as OVERLAP from ov where s > 0")
def _(s, d):
    return spatial.overlap(_layer(s, d), _boxes(s), 50.0)


_WHOLE = "w as (select p_partkey as id, p_partkey % 480 as x0, p_partkey % 480 + p_size as x1, p_partkey % 23 as y0, p_partkey % 23 + 2 as y1 from part)"


def _whole_layer(s: SparkSession, d: str) -> DataFrame:
    """Boxes with whole-numbered corners, of which many touch a unit in an edge or a corner."""
    k = F.col("p_partkey")
    return ad.read(s, d, "part").select(k.alias("id"), spatial.box(k % 480, k % 23, k % 480 + F.col("p_size"), k % 23 + 2).alias("rings"))


@query("SJ4_touch", f""", {_WHOLE},
    t as (select id, code, least(w.x1, b.x1) - greatest(w.x0, b.x0) as dx, least(w.y1, b.y1) - greatest(w.y0, b.y0) as dy from w join box b on w.x1 >= b.x0 and w.x0 <= b.x1 and w.y1 >= b.y0 and w.y0 <= b.y1)
    select id, code as AREA_CODE, case when dx > 0 and dy > 0 then 'area' when dx > 0 or dy > 0 then 'line' else 'point' end as KIND, (dx * dy)::double as OVERLAP, (case when dx > 0 and dy > 0 then 0 else dx + dy end)::double as LENGTH from t""")
def _(s, d):
    found = overlay.fragments(_whole_layer(s, d), _boxes(s), 50.0)
    return found.withColumn("OVERLAP", F.round("OVERLAP", 6))


_LINES = """ln as (select id, x0, y0 + 0.1 as y0, x1 - x0 as dx, 1.9::double as dy from lay),
    lb as (select id, code, greatest(0, (b.x0 - l.x0) / dx, (b.y0 - l.y0) / dy) as t0, least(1, (b.x1 - l.x0) / dx, (b.y1 - l.y0) / dy) as t1, sqrt(dx * dx + dy * dy) as long from ln l, box b),
    ll as (select id, code, (t1 - t0) * long as len from lb where t1 > t0)"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    """A slanted line through each box of the layer."""
    box = F.col("rings")[0]["points"]
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    way = F.array(point(box[0]["x"], box[0]["y"] + 0.1), point(box[2]["x"], box[0]["y"] + 2.0))
    return _layer(s, d).select("id", F.array(F.struct(F.lit(False).alias("hole"), way.alias("points"))).alias("rings"))


@query("LN1", f", {_LINES} select code as AREA_CODE, round(sum(len) / 1000, 9) as MEASURE from ll group by code")
def _(s, d):
    """Km of lines inside each unit."""
    return predictors.line_density(_lines(s, d), _boxes(s), 50.0).withColumn("MEASURE", F.round("MEASURE", 9))


@query("LN2", f""", {_LINES}, st as (select code, len, 1990 + id % 15 as a, case when id % 4 = 0 then 1990 + id % 15 + id % 3 end as b from ll)
    select code as AREA_CODE, y as YEAR, round(coalesce(sum(len) filter (where a <= y and (b is null or b >= y)), 0), 6) as LENGTH from st, yl where code in (select code from st where a <= 2001) group by code, y""")
def _(s, d):
    """The same by year, with lines that are built and taken down."""
    since = 1990 + F.col("id") % 15
    stood = overlay.line_lengths(_lines(s, d), _boxes(s)).select("AREA_CODE", "LENGTH", since.cast("int").alias("SINCE"), F.when(F.col("id") % 4 == 0, since + F.col("id") % 3).cast("int").alias("UNTIL"))
    return overlay.annual(stood, ad.YEARS, until="UNTIL").withColumn("LENGTH", F.round(F.col("LENGTH") + 0.0, 6))


@query("CM1", """, g as (select case when pt = 'PEDESTRIAN' then 1 else 0 end as p, avg(ni) as m from mat group by p)
    select 'intercept' as TERM, round((select ln(m) from g where p = 0), 8) as COEFFICIENT union all select 'pedestrian', round(ln((select m from g where p = 1) / (select m from g where p = 0)), 8)""")
def _(s, d):
    """Poisson regression of persons injured on whether the party walks, over all cells of the matrix; with one dummy the coefficients are logs of means."""
    fit = models.poisson(_matrix(s, d), "PERSONS_INJURED", {"intercept": F.lit(1.0), "pedestrian": (F.col("PARTY_TYPE") == "PEDESTRIAN").cast("double")})
    return s.createDataFrame([(n, round(v, 8)) for n, v in fit.coefficients.items()], "TERM string, COEFFICIENT double")


@query("CM2", """, c as (select code, y, sum(nk)::double as k, sum(np)::double as p from mat group by code, y),
    e as (select k - avg(k) over (partition by code) - avg(k) over (partition by y) + avg(k) over () as k, p - avg(p) over (partition by code) - avg(p) over (partition by y) + avg(p) over () as p from c)
    select 'affected' as TERM, round(sum(k * p) / sum(p * p), 8) as COEFFICIENT from e""")
def _(s, d):
    """Persons killed on affected parties with effects of unit and year."""
    cells_by_year = _matrix(s, d).groupBy("AREA_CODE", "YEAR").agg(F.sum("PERSONS_KILLED").alias("killed"), F.sum("AFFECTED_PARTIES").alias("affected"))
    fit = models.two_way(cells_by_year, "killed", ["affected"], ("AREA_CODE", "YEAR"))
    return s.createDataFrame([(n, round(v, 8)) for n, v in fit.coefficients.items()], "TERM string, COEFFICIENT double")


@query("CJ1", "select u.code as AREA_CODE, y as YEAR, t as PARTY_TYPE, c as COUNTERPART_TYPE from units u, yl, tl, cl")
def _(s, d):
    return matrix.grid(ad.study(s, d)).select(*matrix.KEYS)


# --- aggregations -------------------------------------------------------------------------------------------------


@query("AG1", "select crash as FORMULARIO, veh as CODIGO_VEH, sum(inj)::bigint as INJURED, sum(kil)::bigint as KILLED from cas group by all")
def _(s, d):
    return ad.casualties(s, d).groupBy("FORMULARIO", "CODIGO_VEH").agg(F.sum("INJURED").alias("INJURED"), F.sum("KILLED").alias("KILLED"))


@query("AG2", "select crash as FORMULARIO, yr as YEAR, class as CRASH_CLASS, code as AREA_CODE, name as AREA_NAME from attrs")
def _(s, d):
    return _attributes(s, d)


@query("AG3", "select 'NATION' as SCALE, code as AREA_CODE, y as YEAR, pt as PARTY_TYPE, cp as COUNTERPART_TYPE, name as AREA_NAME, np as AFFECTED_PARTIES, ni as PERSONS_INJURED, nk as PERSONS_KILLED from mat")
def _(s, d):
    return _matrix(s, d)


@query("AG4", "select 'NATION' as SCALE, lvl as AGGREGATION_LEVEL, code as AREA_CODE, name as AREA_NAME, y as YEAR, pair as PAIR, a as PAIR_TYPE_A, b as PAIR_TYPE_B, n as CRASHES_BOTH_AFFECTED, d as CRASHES_TOTAL, rho as RHO from rr")
def _(s, d):
    return _rho(s, d)


@query("AG5", "select src as CASUALTY_SOURCE, yr as YEAR, month(dt)::int as MONTH, count(*) as RECORDS from cas group by all")
def _(s, d):
    return completeness.observed_months(ad.casualties(s, d))


@query("AG6", "select code as AREA_CODE, sum(s) / 1e6::double as MEASURE from ov where s > 0 group by code")
def _(s, d):
    return predictors.area_share(_layer(s, d), _boxes(s), 50.0)


@query("AG7", "select code as AREA_CODE, count(*)::double as MEASURE from pts join box on x > x0 and x < x1 and y > y0 and y < y1 group by code")
def _(s, d):
    layer = _points(s, d).select(F.col("p_id").alias("id"), F.array(F.struct("x", "y")).alias("points"))
    return predictors.point_density(layer, _boxes(s), 50.0)


_UNITS_SQL = "case kind when 'area' then 'share of unit area' else 'points per km2' end as VALUE_UNIT, case kind when 'area' then 'km2' else 'count' end as MEASURE_UNIT"


@query("AG8", f"select name as PREDICTOR, kind as PREDICTOR_FAMILY, {_UNITS_SQL}, count(*) filter (where km2 > 0) as UNITS_MEASURED, count(*) filter (where km2 = 0) as UNITS_NOT_MEASURED, count(*) filter (where v = 0) as UNITS_AT_ZERO, min(v) as MINIMUM, median(v) as MEDIAN, max(v) as MAXIMUM, avg(v) as MEAN, stddev_samp(v) as STD_DEV, sum(m) as TOTAL_MEASURE from pv group by name, kind")
def _(s, d):
    return predictors.summary(_predictors(s, d))


_CORR_SQL = "select a.name as PREDICTOR_A, b.name as PREDICTOR_B, corr(x.v, z.v) as CORRELATION from pn a join pn b on a.k < b.k join pv x on x.name = a.name join pv z on z.name = b.name and z.code = x.code group by a.name, b.name"


@query("AG9", f", q as ({_CORR_SQL}) select PREDICTOR_A, PREDICTOR_B, round(case when isfinite(CORRELATION) then CORRELATION end, 6) as CORRELATION from q")
def _(s, d):
    return predictors.correlations(predictors.wide_table(_predictors(s, d))).withColumn("CORRELATION", F.round("CORRELATION", 6))


@query("AG10", f", q as ({_CORR_SQL}) select PREDICTOR_A, PREDICTOR_B, round(CORRELATION, 6) as CORRELATION from q where isfinite(CORRELATION) and abs(CORRELATION) >= 0.2")
def _(s, d):
    pairs = predictors.correlations(predictors.wide_table(_predictors(s, d)))
    return predictors.high_correlations(pairs, 0.2).withColumn("CORRELATION", F.round("CORRELATION", 6))


@query("AG11", "select count(distinct crash) as crashes, count(distinct person) as persons from cas")
def _(s, d):
    return ad.casualties(s, d).agg(F.count_distinct("FORMULARIO").alias("crashes"), F.count_distinct("CODIGO_ACC").alias("persons"))


@query("AG12", "select count(*)::bigint as ROWS, (count(*) - count(distinct (crash, person)))::bigint as DUPLICATED, 0::bigint as NULL_PERSONS, (select count(*) from (select crash, person from cas group by all having count(distinct src) > 1))::bigint as CROSS_LAYER from cas")
def _(s, d):
    return parties.person_profile(ad.casualties(s, d))


@query("AG13", "select class as CLASS, count(*) as n, count(*) / (select count(*) from attrs)::double as share from attrs group by class order by n desc, class limit 5")
def _(s, d):
    per = _attributes(s, d).groupBy(F.col("CRASH_CLASS").alias("CLASS")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "CLASS").limit(5)


@query("AG14", """, z as (select class, count(*) filter (where n > 2) as dr, count(*) filter (where n <= 2) as ke from attrs join (select crash, count(*) as n from parties group by crash) using (crash) group by class),
    w as (select *, 100.0 * dr / (select sum(dr) from z) as dp, 100.0 * ke / (select sum(ke) from z) as kp from z)
    select class as CRASH_CLASS, dr as DISCARDED, ke as KEPT, dp::double as DISCARDED_PCT, kp::double as KEPT_PCT, (case when kp > 0 then dp / kp end)::double as RATIO, (100.0 * dr / (dr + ke))::double as PCT_OF_TYPE from w""")
def _(s, d):
    return parties.threshold_composition(_universe(s, d), _attributes(s, d))


_CROSS_SQL = ", ".join(f"coalesce(sum(np) filter (where cp = '{c}'), 0)::bigint as \"{c}\"" for c in COUNTERPARTS)


@query("AG15", f"select pt as PARTY_TYPE, {_CROSS_SQL} from mat group by pt")
def _(s, d):
    return matrix.crosstab(_matrix(s, d), "AFFECTED_PARTIES")


@query("AG15_year", f"select pt as PARTY_TYPE, {_CROSS_SQL.replace('np', 'ni')} from mat where y = 1997 group by pt")
def _(s, d):
    return matrix.crosstab(_matrix(s, d), "PERSONS_INJURED", 1997)


_FREQ_SQL = ", ".join(f"count(*) filter (where cp = '{c}') as \"{c}\"" for c in COUNTERPARTS)


@query("AG16", f"select ptype as PARTY_TYPE, {_FREQ_SQL} from aff group by ptype")
def _(s, d):
    return matrix.frequencies(_affected(s, d))


_CITY_SQL = ", ".join(f"max(rho) filter (where pair = '{p}') as \"{p}\"" for p in PAIR_LABELS)


@query("AG17", f"select y as YEAR, {_CITY_SQL} from rr where lvl = 'CITY' group by y")
def _(s, d):
    return rho.city_table(_rho(s, d))


@query("AG18", f"select code as AREA_CODE, {_PIVOT_SQL} from pv group by code")
def _(s, d):
    return predictors.wide_table(_predictors(s, d)).drop("SCALE", "AREA_NAME", "AREA_UNIT_KM2")


_MONTH_SQL = ", ".join(f"max(n) filter (where m = {i}) as \"{i}\"" for i in range(1, 13))


@query("AG19", f"select y as YEAR, {_MONTH_SQL} from mon where src = 'INJURY' group by y")
def _(s, d):
    return completeness.year_by_month(_months(s, d), INJURY)


@query("AG20", "select code as AREA_CODE, avg((np = 0 and ni = 0 and nk = 0)::int)::double as EMPTY_SHARE from mat group by code")
def _(s, d):
    return matrix.emptiness(_matrix(s, d), "AREA_CODE")


@query("AG20_year", "select y as YEAR, avg((np = 0 and ni = 0 and nk = 0)::int)::double as EMPTY_SHARE from mat group by y")
def _(s, d):
    return matrix.emptiness(_matrix(s, d), "YEAR")


@query("AG21", "select y as YEAR, sum(np)::bigint as AFFECTED_PARTIES, sum(ni)::bigint as PERSONS_INJURED, sum(nk)::bigint as PERSONS_KILLED from mat group by y union all select null, sum(np)::bigint, sum(ni)::bigint, sum(nk)::bigint from mat")
def _(s, d):
    return matrix.yearly_totals(_matrix(s, d))


@query("AG22", ", q as (select pt, cp, sum(np)::bigint as n from mat group by all) select pt as PARTY_TYPE, cp as COUNTERPART_TYPE, n as PARTIES, case when sum(n) over (partition by pt) > 0 then n / sum(n) over (partition by pt) end::double as SHARE from q")
def _(s, d):
    return matrix.counterpart_shares(_matrix(s, d))


@query("AG23", """, q as (select pair, sum(n) filter (where lvl = 'CITY') as n, sum(d) filter (where lvl = 'CITY') as d, avg(rho) filter (where lvl = 'UNIT') as m, count(rho) filter (where lvl = 'UNIT') as c from rr group by grouping sets ((pair), ()))
    select pair as PAIR, (case when d > 0 then n / d end)::double as POOLED, m as MEAN_OF_UNITS, c as UNIT_CELLS from q""")
def _(s, d):
    return rho.pooled_and_mean(_rho(s, d))


_BINS_SQL = """, r as (select min(value) as lo, max(value) as hi from events),
    tried as (select m * power(10.0, e) as step, lo, hi from r, unnest([1.0, 2.0, 2.5, 5.0]) t(m), range(-9, 10) x(e)),
    best as (select step, floor(lo / step) as f, ceil(hi / step) - floor(lo / step) as n from tried where ceil(hi / step) - floor(lo / step) between 4 and 10 order by abs(n - 6), step limit 1),
    bins as (select b::int as BIN, ((f + b) * step)::double as BIN_LOW, ((f + b + 1) * step)::double as BIN_HIGH, b = n - 1 as is_last from best, range(10) y(b) where b < n)"""


@query("AG24", _BINS_SQL + """ select BIN, BIN_LOW, BIN_HIGH, (select count(*) from events where value >= BIN_LOW and (value < BIN_HIGH or (is_last and value <= BIN_HIGH))) as UNITS from bins""")
def _(s, d):
    return predictors.histogram(ad.read(s, d, "events").select("value"), "value")


@query("AG25", ", w as (select code, km2, " + _PIVOT_SQL + " from pv group by code, km2) select code as AREA_CODE, " + ", ".join(f"case when {p.name} is null then null when max({p.name}) over () > min({p.name}) over () then ({p.name} - min({p.name}) over ()) / (max({p.name}) over () - min({p.name}) over ()) else 0.5::double end as {p.name}" for p in predictors.STATIC) + " from w")
def _(s, d):
    return predictors.scaled(predictors.wide_table(_predictors(s, d))).drop("SCALE", "AREA_NAME", "AREA_UNIT_KM2")


@query("AG26", ", q as (select y, pt, cp, sum(np)::bigint as n from mat group by all) select min(n) filter (where n > 0) as LOW, max(n) filter (where n > 0) as HIGH from q")
def _(s, d):
    return matrix.colour_range(_matrix(s, d))


@query("AG27", ", q as (select count(*) as r, count(distinct crash) as c, count(*) filter (where ptype = 'MOTORCYCLE' and cp = 'BICYCLE') as f, count(*) filter (where ptype = 'BICYCLE' and cp = 'MOTORCYCLE') as b from aff) select r as ROWS, c as CRASHES, f as FORWARD, b as BACKWARD, (case when b > 0 then f / b end)::double as RATIO from q")
def _(s, d):
    return parties.divergence(_affected(s, d))


@query("AG28", "select count(*) filter (where src = 'FATALITY') as fatalities, count(*) filter (where src = 'INJURY') as injuries, count(*) as casualties, (select count(*) from lineitem) as vehicles, count(*) filter (where src = 'FATALITY' and code is null) as fatalities_unlocated, count(*) filter (where src = 'INJURY' and code is null) as injuries_unlocated from cas")
def _(s, d):
    from loomgrid.sources.readers import loading_counts

    return loading_counts(ad.casualties(s, d), ad.vehicles(s, d))


# --- windows, order, sets -----------------------------------------------------------------------------------------


@query("WN1", "select n as PARTIES, count(distinct crash) as crashes from sized group by n")
def _(s, d):
    return parties.with_party_count(_universe(s, d)).groupBy("PARTIES").agg(F.count_distinct("FORMULARIO").alias("crashes"))


@query("WN2", "select p as position, count(*) as n from (select row_number() over (partition by crash order by pid) - 1 as p from kept) group by p")
def _(s, d):
    at = F.row_number().over(Window.partitionBy("FORMULARIO").orderBy("PARTY_ID")) - 1
    return parties.within_threshold(_universe(s, d)).select(at.cast("long").alias("position")).groupBy("position").agg(F.count("*").alias("n"))


@query("WN3", "select crash as FORMULARIO, ptype as PARTY_TYPE, cp as COUNTERPART_TYPE from res")
def _(s, d):
    return _resolved(s, d).select("FORMULARIO", "PARTY_TYPE", "COUNTERPART_TYPE")


@query("WN4", "select ta as PAIR_TYPE_A, tb as PAIR_TYPE_B, count(*) as n from two group by all")
def _(s, d):
    return rho.crash_pairs(_universe(s, d)).groupBy("PAIR_TYPE_A", "PAIR_TYPE_B").agg(F.count("*").alias("n"))


@query("WN5", "select src as CASUALTY_SOURCE, y as YEAR, m as MONTH, med::double as YEAR_MEDIAN from mo")
def _(s, d):
    return _months(s, d).select("CASUALTY_SOURCE", "YEAR", "MONTH", "YEAR_MEDIAN")


@query("WN6", "select src as CASUALTY_SOURCE, y as YEAR, m as MONTH, n as RECORDS, med::double as YEAR_MEDIAN, sh::double as SHARE_OF_MEDIAN, e as EMPTY, sh < 0.5 as THIN from mf")
def _(s, d):
    return _months(s, d)


_JUMP_SQL = "select b.pair as PAIR, b.y as YEAR, a.rho as RHO_BEFORE, b.rho as RHO, b.rho - a.rho as CHANGE, a.d as CRASHES_BEFORE, b.d as CRASHES_TOTAL from rr a join rr b on a.pair = b.pair and b.y = a.y + 1 and a.lvl = 'CITY' and b.lvl = 'CITY' where a.rho is not null and b.rho is not null"


@query("WN7", _JUMP_SQL + " and abs(b.rho - a.rho) >= 0.1")
def _(s, d):
    return rho.jumps(_rho(s, d))


@query("WN8", ", q as (select src, y, sum(n)::bigint as n from mon group by all) select a.src as CASUALTY_SOURCE, a.y as YEAR, a.n as RECORDS, b.n as BEFORE, case when b.n > 0 then 100.0::double * (a.n - b.n) / b.n end as CHANGE_PCT from q a left join q b on b.src = a.src and b.y = a.y - 1")
def _(s, d):
    return completeness.yearly_change(_months(s, d))


@query("WN9", "select src as CASUALTY_SOURCE, y as YEAR, (12 - coalesce(max(m) filter (where n > 0), 0))::int as TRAILING_EMPTY from mon group by all")
def _(s, d):
    return completeness.trailing_empty(_months(s, d))


@query("WN10", "select l_partkey as CODIGO_VEHICULO, min(l_orderkey) as FORMULARIO from lineitem group by all")
def _(s, d):
    first = F.row_number().over(Window.partitionBy("CODIGO_VEHICULO").orderBy("FORMULARIO"))
    return ad.vehicles(s, d).select("FORMULARIO", "CODIGO_VEHICULO").distinct().withColumn("r", first).filter("r = 1").drop("r")


@query("ST1", "select crash as FORMULARIO, code as AREA_CODE, ptype as PARTY_TYPE, cp as COUNTERPART_TYPE, inj as PERSONS_INJURED, kil as PERSONS_KILLED from aff")
def _(s, d):
    return parties.in_final_order(_affected(s, d)).select("FORMULARIO", "AREA_CODE", "PARTY_TYPE", "COUNTERPART_TYPE", "PERSONS_INJURED", "PERSONS_KILLED")


@query("ST2", "select t as PARTY_TYPE, r as PARTY_TYPE_RANK, count(crash) as n from tl left join parties on ptype = t group by all")
def _(s, d):
    """The vocabulary in declared order with the parties of each type."""
    found = _universe(s, d).groupBy("PARTY_TYPE").agg(F.count("*").alias("n"))
    return ranked(s, TYPES, "PARTY_TYPE").join(found, "PARTY_TYPE", "left").select("PARTY_TYPE", "PARTY_TYPE_RANK", F.coalesce("n", F.lit(0)).alias("n")).orderBy("PARTY_TYPE_RANK")


@query("ST3", "select pt as PARTY_TYPE, cp as COUNTERPART_TYPE, sum(np)::bigint as PARTIES from mat group by all order by PARTIES desc, pt, cp limit 3")
def _(s, d):
    return matrix.extreme_cells(_matrix(s, d))


@query("ST3_least", "select pt as PARTY_TYPE, cp as COUNTERPART_TYPE, sum(np)::bigint as PARTIES from mat group by all order by PARTIES, pt, cp limit 3")
def _(s, d):
    return matrix.extreme_cells(_matrix(s, d), largest=False)


@query("SO1", "select src as CASUALTY_SOURCE, count(*) as n, count(case when src = 'FATALITY' then dt end) as with_post from cas group by src")
def _(s, d):
    c = ad.casualties(s, d)
    fatal = c.filter(F.col("CASUALTY_SOURCE") == FATALITY).withColumn("FECHA_POST", F.col("FECHA_OCUR"))
    both = fatal.unionByName(c.filter(F.col("CASUALTY_SOURCE") == INJURY), allowMissingColumns=True)
    return both.groupBy("CASUALTY_SOURCE").agg(F.count("*").alias("n"), F.count("FECHA_POST").alias("with_post"))


@query("SO2", "select substr(pid, 1, 1) as kind, ptype as PARTY_TYPE, count(*) as n from parties group by all")
def _(s, d):
    return _universe(s, d).groupBy(F.substring("PARTY_ID", 1, 1).alias("kind"), "PARTY_TYPE").agg(F.count("*").alias("n"))


@query("SO3", "select lvl as AGGREGATION_LEVEL, pair as PAIR, sum(n)::bigint as CRASHES_BOTH_AFFECTED, sum(d)::bigint as CRASHES_TOTAL from rl group by all")
def _(s, d):
    return _rho(s, d).groupBy("AGGREGATION_LEVEL", "PAIR").agg(F.sum("CRASHES_BOTH_AFFECTED").alias("CRASHES_BOTH_AFFECTED"), F.sum("CRASHES_TOTAL").alias("CRASHES_TOTAL"))


@query("SO4", "select name as PREDICTOR, kind as PREDICTOR_FAMILY, count(*) as cells, sum(m) as TOTAL from pv group by all")
def _(s, d):
    return _predictors(s, d).groupBy("PREDICTOR", "PREDICTOR_FAMILY").agg(F.count("*").alias("cells"), F.sum("MEASURE").alias("TOTAL"))


@query("SO5", f"select yr as YEAR, count(*) as n from cas where src = 'INJURY' and yr <> {REPLACED} group by yr union all select {REPLACED}, count(*) from inc where src = 'INJURY'")
def _(s, d):
    layer = ad.casualties(s, d).filter(F.col("CASUALTY_SOURCE") == INJURY)
    new = _incoming(s, d).filter(F.col("CASUALTY_SOURCE") == INJURY).drop("PERSON")
    return integrate.replace_year(layer, new, REPLACED).groupBy("YEAR").agg(F.count("*").alias("n"))


@query("SO6", f""", w as (select distinct person from prev), h as (select distinct person from inc where src = 'INJURY'), i as (select distinct person from inc), k as (select distinct person from cas where yr = {REPLACED})
    select (select count(*) from (select * from w intersect select * from h)) as STAYED, (select count(*) from (select * from w except select * from i)) as GONE,
           (select count(*) from ((select * from w except select * from h) intersect select * from i)) as CHANGED_SEVERITY, (select count(*) from ((select * from h except select * from w) intersect select * from k)) as FROM_OTHER_LAYER,
           (select count(*) from (select * from h except select * from w except select * from k)) as BRAND_NEW, (select count(*) from w) as WERE""")
def _(s, d):
    incoming = _incoming(s, d)
    everyone = ad.casualties(s, d).filter(F.col("YEAR") == REPLACED).withColumn("PERSON", F.col("CODIGO_ACC"))
    return integrate.account_for_people(_previous(s, d), incoming.filter(F.col("CASUALTY_SOURCE") == INJURY), incoming, everyone)


@query("SO7", "select true as units_equal, (select count(distinct yr) from cas) = 7 as years_equal")
def _(s, d):
    long = _matrix(s, d)
    years = grid.years_table(s, ad.YEARS)
    equal = [checks.same_set(long.select("AREA_CODE"), ad.units(s, d).select("AREA_CODE")), checks.same_set(ad.casualties(s, d).select("YEAR"), years)]
    return declared(s, [tuple(equal)], "units_equal boolean, years_equal boolean")


# --- geometry and checks ------------------------------------------------------------------------------------------


@query("GEO2", "select id, (x1 - x0) * (y1 - y0) as area from lay")
def _(s, d):
    return _layer(s, d).select("id", spatial.area(F.col("rings")).alias("area"))


@query("GEO3", "select id as p_id, x > 100 and x < 200 and y > 8 and y < 12 as inside from pts")
def _(s, d):
    rings = spatial.box(F.lit(100), F.lit(8), F.lit(200), F.lit(12))
    return _points(s, d).select("p_id", spatial.contains(rings, F.col("x"), F.col("y")).alias("inside"))


@query("GEO4", "select id, k::int as part, x + k as x, y from pts cross join (select unnest([0, 1]) as k)")
def _(s, d):
    two = _points(s, d).select(F.col("p_id").alias("id"), F.array(F.struct("x", "y"), F.struct((F.col("x") + 1).alias("x"), "y")).alias("points"))
    return spatial.explode_points(two)


def _bow_ties(s: SparkSession, d: str) -> DataFrame:
    """The layer with every fiftieth feature drawn as two triangles of unit height that meet in a point."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k, layer = F.col("id"), _layer(s, d)
    bow = F.array(F.struct(F.lit(False).alias("hole"), F.array(point(k, k), point(k + 2, k + 2), point(k + 2, k), point(k, k + 2)).alias("points")))
    return layer.filter(k % 50 != 0).unionByName(layer.filter(k % 50 == 0).select("id", bow.alias("rings")))


@query("GEO5", "select id, round(case when id % 50 = 0 then 2 else (x1 - x0) * (y1 - y0) end, 6) as area from lay")
def _(s, d):
    return validity.repaired(_bow_ties(s, d)).select("id", F.round(spatial.area(F.col("rings")), 6).alias("area"))


@query("GEO6", "select count(*) filter (where id % 7 = 0) as empty, count(*) filter (where id % 50 = 0 and id % 7 <> 0) as invalid, count(*) as n from lay")
def _(s, d):
    layer = _bow_ties(s, d).withColumn("rings", F.when(F.col("id") % 7 != 0, F.col("rings")))
    bad = validity.invalid(layer).agg(F.count("*").alias("invalid"))
    return layer.agg(F.count_if(spatial.is_empty(F.col("rings"))).alias("empty"), F.count("*").alias("n")).crossJoin(bad)


@query("GEO7", "select id as p_id, x, y from pts")
def _(s, d):
    from loomgrid.functions import wkt

    text = _points(s, d).select("p_id", F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")).alias("w"))
    return text.withColumn("p", wkt.point(F.col("w"))).select("p_id", "p.x", "p.y")


@query("GEO8", "select id as p_id, round(sqrt(power(greatest(100 - x, x - 200, 0), 2) + power(y - 8, 2)), 9) as DISTANCE from pts")
def _(s, d):
    distance = spatial.segment_distance(F.col("x"), F.col("y"), F.lit(100.0), F.lit(8.0), F.lit(200.0), F.lit(8.0))
    return _points(s, d).select("p_id", F.round(distance, 9).alias("DISTANCE"))


_KRUEGER = """, c as (select 1 / 298.257222101::double as f), e as (select f, sqrt(f * (2 - f)) as e, f / (2 - f) as n from c),
    k as (select e, 6378137.0::double / (1 + n) * (1 + n * n / 4 + power(n, 4) / 64) as r, n / 2 - 2 * n * n / 3 + 5 * power(n, 3) / 16 as a1, 13 * n * n / 48 - 3 * power(n, 3) / 5 as a2, 61 * power(n, 3) / 240 as a3 from e),
    g as (select n_nationkey as id, radians(-74.1::double + n_nationkey / 100.0::double + 74.07750791666666::double) as d, radians(4.5::double + n_nationkey / 200.0::double) as lat from nation union all select -1, 0, radians(4.596200416666666::double)),
    t as (select id, d, sinh(atanh(sin(lat)) - e * atanh(e * sin(lat))) as t, k.* from g, k),
    u as (select *, atan2(t, cos(d)) as xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) as et from t),
    w as (select id, r * (et + a1 * cos(2 * xi) * sinh(2 * et) + a2 * cos(4 * xi) * sinh(4 * et) + a3 * cos(6 * xi) * sinh(6 * et)) as ea, r * (xi + a1 * sin(2 * xi) * cosh(2 * et) + a2 * sin(4 * xi) * cosh(4 * et) + a3 * sin(6 * xi) * cosh(6 * et)) as no from u)
    select id, round(1e6 + ea, 2) as EAST, round(1e6 + no - (select no from w where id = -1), 2) as NORTH from w where id >= 0"""


@query("GEO1", _KRUEGER)
def _(s, d):
    from loomgrid.functions.projection import to_plane

    key = F.col("n_nationkey")
    east, north = to_plane(-74.1 + key / 100.0, 4.5 + key / 200.0)
    return ad.read(s, d, "nation").select(key.alias("id"), F.round(east, 2).alias("EAST"), F.round(north, 2).alias("NORTH"))


@query("SRC5", f"select distinct {REPLACED} as YEAR from inc")
def _(s, d):
    incoming = _incoming(s, d)
    integrate.assert_single_year(incoming, REPLACED)
    return incoming.select("YEAR").distinct()


@query("SRC6", "select case when id % 3 = 0 then 'MULTIPOINT' else 'POINT' end as KIND, count(*) as n from pts group by 1")
def _(s, d):
    from loomgrid.functions import wkt

    xy = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    text = F.when(F.col("p_id") % 3 == 0, F.concat(F.lit("MULTIPOINT ("), xy, F.lit(", 0 0)"))).otherwise(F.concat(F.lit("POINT ("), xy, F.lit(")")))
    layer = _points(s, d).select(wkt.kind(text).alias("geom_type"))
    spatial.assert_geometry(layer, predictors.GEOMETRIES["point"])
    return layer.groupBy(F.col("geom_type").alias("KIND")).agg(F.count("*").alias("n"))


@query("SC12", _BINS_SQL + " select BIN, BIN_LOW, BIN_HIGH from bins")
def _(s, d):
    return predictors.histogram(ad.read(s, d, "events").select("value"), "value").drop("UNITS")


@query("CK2", "select k as \"CHECK\", OK from (values ('fatalities', true), ('injuries', true), ('casualties', (select count(*) from cas) = 0), ('vehicles', true), ('fatalities_unlocated', true), ('injuries_unlocated', true)) v(k, OK)")
def _(s, d):
    from loomgrid.sources.readers import loading_counts

    counts = loading_counts(ad.casualties(s, d), ad.vehicles(s, d)).first().asDict()
    baseline = {"vehicles": ad.read(s, d, "lineitem").count(), "casualties": 0}  # one that holds and one that cannot
    return checks.table(s, checks.loading(counts, baseline)).drop("DETAIL")


@query("CK6", "select count(*)::bigint as ROWS, (count(*) - count(distinct (crash, person)))::bigint as DUPLICATED, 0::bigint as NULL_PERSONS, (select count(*) from (select crash, person from cas group by all having min(src) <> max(src)))::bigint as CROSS_LAYER from cas")
def _(s, d):
    return parties.person_profile(ad.casualties(s, d))


@query("CK9", f""", now as (select avg((exists (select 1 from allveh a where a.crash = i.crash and a.veh = i.veh))::int) as r from inc i where veh is not null),
    old as (select avg((vt is not null)::int) as r from hurt where yr = {REPLACED - 1} and veh is not null) select now.r >= 0.5 * old.r as RATE_HOLDS from now, old""")
def _(s, d):
    before = ad.casualties(s, d).filter(F.col("YEAR") == REPLACED - 1)
    now, old = (integrate.reference_rate(x, ad.vehicles(s, d)).select(F.col("RATE").alias(n)) for x, n in ((_incoming(s, d), "now"), (before, "old")))
    return now.crossJoin(old).select((F.col("now") >= 0.5 * F.col("old")).alias("RATE_HOLDS"))


@query("CK1", """, n as (select (select count(*) from parties) as a, (select count(*) from kept) as b, (select count(*) from kept where inj + kil = 0) as c)
    select 0::int as STEP_NUMBER, 'two-party threshold' as STEP, 'opening' as ENTRY, a as ROWS from n union all select 0, 'two-party threshold', 'parties of crashes with more than two', b - a from n where a <> b union all select 0, 'two-party threshold', 'closing', b from n
    union all select 1, 'emit affected parties', 'opening', b from n union all select 1, 'emit affected parties', 'parties without a casualty', -c from n where c > 0 union all select 1, 'emit affected parties', 'closing', b - c from n""")
def _(s, d):
    """Two steps booked in a ledger from counts taken while the second one's table is made, in one job."""
    book, hurt = Ledger(), F.col("PERSONS_INJURED") + F.col("PERSONS_KILLED") > 0
    every, seen = book.watch(parties.with_party_count(_universe(s, d)), rows=F.count("*"), over=F.count_if(F.col("PARTIES") > 2), unhurt=F.count_if((F.col("PARTIES") <= 2) & ~hurt))
    emitted, after = book.watch(every.filter((F.col("PARTIES") <= 2) & hurt), rows=F.count("*"))
    book.later("two-party threshold", lambda again: (seen(again)["rows"], seen(again)["rows"] - seen(again)["over"], {"parties of crashes with more than two": -seen(again)["over"]}))
    book.later("emit affected parties", lambda again: (seen(again)["rows"] - seen(again)["over"], after(again)["rows"], {"parties without a casualty": -seen(again)["unhurt"]}))
    emitted.write.format("noop").mode("overwrite").save()
    book.close()
    return book.frame(s)


@query("CK3", """ select * from (values ('AFFECTED_PARTIES preserved', (select sum(np) from mat) = (select count(*) from aff where code is not null)), ('PERSONS_INJURED preserved', (select sum(ni) from mat) = (select sum(inj) from aff where code is not null)),
    ('PERSONS_KILLED preserved', (select sum(nk) from mat) = (select sum(kil) from aff where code is not null)), ('no negative count', (select count(*) from mat where least(np, ni, nk) < 0) = 0), ('persons at least parties', (select count(*) from mat where ni + nk < np) = 0),
    ('units of the roster', (select count(distinct code) from mat) = (select count(*) from units)), ('years of the study', (select count(distinct y) from mat) = 7), ('complete grid', (select count(*) from mat) = (select count(*) from units) * 7 * 6 * 7)) v("CHECK", OK)""")
def _(s, d):
    with grid.held(_matrix(s, d)) as (long,):
        return checks.table(s, checks.matrix(long, _affected(s, d), ad.study(s, d))).drop("DETAIL")


@query("CK4", """ select * from (values ('numerator within denominator', (select count(*) from rl where n > d) = 0), ('rho in [0, 1]', (select count(*) from rr where rho < 0 or rho > 1) = 0), ('rho defined where there are crashes', (select count(*) from rr where (rho is not null) <> (d > 0)) = 0),
    ('units sum to the city', (select count(*) from (select y, sum(d) filter (where lvl = 'CITY') - sum(d) filter (where lvl = 'UNIT') as gap, sum(n) filter (where lvl = 'CITY') - sum(n) filter (where lvl = 'UNIT') as hit from rl group by y) where gap <> 0 or hit <> 0) = 0),
    ('crashes preserved', (select sum(d) from rl where lvl = 'CITY') = (select count(*) from put)), ('complete grid', (select count(*) from rl) = (select count(*) + 1 from units) * 7 * (select count(*) from pl))) v("CHECK", OK)""")
def _(s, d):
    with grid.held(_rho(s, d)) as (long,):
        return checks.table(s, checks.rho(long, _placed(s, d), ad.study(s, d))).drop("DETAIL")


@query("CK5", "select CHECK_NAME as \"CHECK\", OK from (values ('complete grid', true), ('nothing negative', true), ('shares at most 1', (select count(*) from pv where kind = 'area' and v > 1) = 0), ('value is measure by area', true), ('a value where measured', true), ('a snapshot has no year', true), ('wide shape', true), ('every pair of predictors', true), ('correlations in [-1, 1]', true), ('units of the roster', true), ('predictors as declared', true), ('correlation diagonal is 1', true), ('correlations are symmetric', true), ('dictionary and measured predictors agree', true), ('dictionary covers the wide table', true), ('dictionary and tables agree on units', true)) v(CHECK_NAME, OK)")
def _(s, d):
    with grid.held(_predictors(s, d)) as (long,):
        wide = predictors.wide_table(long)
        pairs = predictors.correlations(wide)
        found = checks.predictors(long, wide, pairs, _predictor_study(s)) + checks.symmetry(predictors.correlation_matrix(pairs, wide)) + checks.dictionary(predictors.dictionary(s), long, wide)
        return checks.table(s, found).drop("DETAIL")


@query("CK7", "select 'people balance' as \"CHECK\", (select sum(inj + kil) from kept) + (select coalesce(sum(inj + kil), 0) from sized where n > 2) = sum(inj + kil) as OK, (select sum(inj + kil) from kept) || ' kept and ' || (select coalesce(sum(inj + kil), 0) from sized where n > 2) || ' discarded of ' || sum(inj + kil) as DETAIL from cas")
def _(s, d):
    return checks.table(s, checks.people(_universe(s, d), ad.casualties(s, d), _resolved(s, d)))


@query("CK8", "select count(*) as n from (select crash from res except select crash from aff)")
def _(s, d):
    resolved = _resolved(s, d)
    return checks.silent_crashes(resolved, _affected(s, d)).agg(F.count("*").alias("n"))


@query("CK11", "select count(*) filter (where p.code is not null and i.code is null) as NEWLY, count(*) filter (where p.code is null and i.code is not null) as RECOVERED, (select count(*) from inc where src = 'INJURY' and code is null) as OUTSIDE from prev p join inc i on i.person = p.person and i.src = 'INJURY'")
def _(s, d):
    return integrate.relocated(_previous(s, d), _incoming(s, d).filter(F.col("CASUALTY_SOURCE") == INJURY))


@query("SNK7", """, c as (select pair, y, rho, lag(rho) over (partition by pair order by y) as before from rr where lvl = 'CITY'),
    f as (select *, case when rho is not null and before is null then 1 else 0 end as starts from c)
    select pair as PAIR, y as YEAR, rho as RHO, case when rho is not null then sum(starts) over (partition by pair order by y) end::bigint as SEGMENT, coalesce(abs(rho - before) >= 0.1, false) as JUMPED from f""")
def _(s, d):
    """The table behind the figure of the city's rho: segments between undefined years, and jumps."""
    return rho.lines(_rho(s, d))


@query("SNK7_gaps", ", e as (select pair, y, y - row_number() over (partition by pair order by y) as k from rr where lvl = 'CITY' and rho is null) select pair as PAIR, min(y) as FIRST_YEAR, max(y) as LAST_YEAR, count(*) as YEARS from e group by pair, k")
def _(s, d):
    return rho.gaps(_rho(s, d))


@query("SNK7_shades", """, c as (select y, pt, cp, sum(np)::bigint as n from mat group by all), g as (select min(n) filter (where n > 0) as low, max(n) as high from c)
    select y as YEAR, pt as PARTY_TYPE, cp as COUNTERPART_TYPE, n as VALUE, round(case when n > 0 then case when high > low then (ln(n) - ln(low)) / (ln(high) - ln(low)) else 1 end end, 9) as SHADE from c, g""")
def _(s, d):
    """The table behind the yearly figures of affected parties, on one scale for all years."""
    return matrix.shaded(_matrix(s, d)).withColumn("SHADE", F.round("SHADE", 9))


# --- files written and read again ------------------------------------------------------------------------------------


def export(name: str, of: str, kind: str, table: str) -> None:
    """Register a query that writes the table of another one as its route does and returns what its CSV holds, under that query's SQL."""
    QUERIES[f"op_{name}"] = lambda s, d: sinks.exported(QUERIES[f"op_{of}"](s, d), kind, table)
    ORACLE_SQL[f"op_{name}"] = ORACLE_SQL[f"op_{of}"]


export("SNK1", "AG3", "analysis", "matrix_long")
export("SRC7", "AG15", "presentation", "crosstab_affected_parties")
export("SNK2", "AG17", "presentation", "rho_city")
export("SNK3", "JN11", "analysis", "predictors_wide")


@query("SNK4", "select src as CASUALTY_SOURCE, y as YEAR, m as MONTH, n as RECORDS, med::double as YEAR_MEDIAN from mo")
def _(s, d):
    return sinks.exported(_months(s, d), "analysis", "completeness").select("CASUALTY_SOURCE", "YEAR", "MONTH", "RECORDS", "YEAR_MEDIAN")


@query("SNK5", f"select src as CASUALTY_SOURCE, yr as YEAR, person as PERSON, code as AREA_CODE from cas where yr <> {REPLACED} union all select src, {REPLACED}, person, code from inc")
def _(s, d):
    """Both layers, written by year, with the replaced year written again: other years' files stay, the source is left alone."""
    incoming, folder = _incoming(s, d).withColumn("CODIGO_ACC", F.col("PERSON")).drop("PERSON"), sinks.work_folder(s)
    layers = []
    for source, name in ((FATALITY, "fatalities"), (INJURY, "injuries")):
        own, target = F.col("CASUALTY_SOURCE") == source, f"{folder}/data/{name}_by_year"
        layer = ad.casualties(s, d).filter(own)
        sinks.write_years(layer, target)
        sinks.write_years(incoming.filter(own).select(layer.columns), target)
        layers.append(s.read.schema(layer.schema).parquet(target))
    return layers[0].unionByName(layers[1]).select("CASUALTY_SOURCE", "YEAR", F.col("CODIGO_ACC").alias("PERSON"), "AREA_CODE")


@query("SNK6", "select id, round((x1 - x0) * (y1 - y0), 9) as AREA, true as SAME from lay")
def _(s, d):
    """An intermediate result with geometry: the CSV leaves the geometry out and otherwise says what the Parquet says."""
    found = _layer(s, d).withColumn("AREA", F.round(spatial.area(F.col("rings")), 9))
    parquet, csv = sinks.write_intermediate(found, sinks.work_folder(s), "layer")
    whole, flat = s.read.schema(found.schema).parquet(parquet), sinks.reread(s, csv, found.drop("rings"))
    areas = whole.select("id", F.round(spatial.area(F.col("rings")), 9).alias("SHAPED"))
    return flat.join(areas, "id", "full").select("id", "AREA", (F.col("AREA") == F.col("SHAPED")).alias("SAME"))
