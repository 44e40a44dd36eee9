"""Well-known text as geometry columns, without Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def kind(text: Column) -> Column:
    """POINT, MULTIPOINT, POLYGON, ...; null for text that is none."""
    return F.nullif(F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def _point(pair: Column) -> Column:
    found = F.regexp_extract_all(pair, F.lit(f"({_NUMBER})"))
    return F.struct(F.get(found, F.lit(0)).try_cast("double").alias("x"), F.get(found, F.lit(1)).try_cast("double").alias("y"))


def point(text: Column) -> Column:
    """STRUCT<x, y> of a POINT; null for any other text, or an empty point."""
    return F.when((kind(text) == "POINT") & ~F.contains(F.upper(text), F.lit("EMPTY")), _point(text))


def points(text: Column) -> Column:
    """ARRAY<STRUCT<x, y>> of a POINT or MULTIPOINT."""
    body = F.regexp_extract(text, r"\((.*)\)\s*$", 1)
    return F.when(kind(text).isin("POINT", "MULTIPOINT") & ~F.contains(F.upper(text), F.lit("EMPTY")), F.transform(F.split(body, ","), _point))


def rings(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON: of each polygon's rings all but the first are holes."""
    body = F.regexp_replace(F.regexp_extract(text, r"\((.*)\)\s*$", 1), r"\s*([(),])\s*", "$1")
    polygons = F.when(kind(text) == "MULTIPOLYGON", F.split(F.regexp_replace(body, r"^\(\(|\)\)$", ""), r"\)\),\(\(")).otherwise(F.array(F.regexp_replace(body, r"^\(|\)$", "")))
    one = lambda ring, i: F.struct((i > 0).alias("hole"), F.transform(F.split(ring, ","), _point).alias("points"))
    parsed = F.flatten(F.transform(polygons, lambda p: F.transform(F.split(p, r"\),\("), one)))
    return F.when(kind(text).isin("POLYGON", "MULTIPOLYGON") & ~F.contains(F.upper(text), F.lit("EMPTY")), parsed)
