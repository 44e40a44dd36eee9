"""Shapefiles as a Spark data source: `spark.read.format("shapefile").load(path)` after `register(spark)`.

The two files of a layer follow their public descriptions: records of the .shp by the index of record offsets in the .shx, and fixed-width
rows of the .dbf. A layer is split by record ranges, so a large one is read by many tasks. Rings come out as in `operators.spatial`:
clockwise outer rings, holes the other way, as the format has them. Files are opened on the executors, so the path must be one that all
of them see (a mounted folder); layers in object stores are better converted to Parquet once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Shape types of the format and what they are called here.
KINDS = {0: None, 1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT"}
RECORDS = 10_000
GEOMETRY = "geom_type string, points array<struct<x:double,y:double>>, rings array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>"


@dataclass
class Range(InputPartition):
    first: int
    stop: int


def fields_of(dbf: Path) -> tuple[int, int, list[tuple[str, int]]]:
    """(offset of the first row, row length, (name, width) of every field)."""
    data = dbf.read_bytes()[: 32 + 32 * 256]
    head, row = struct.unpack_from("<HH", data, 8)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    return head, row, fields


def _pairs(data: bytes, at: int, n: int) -> list[tuple[float, float]]:
    flat = struct.unpack_from(f"<{2 * n}d", data, at)
    return list(zip(flat[::2], flat[1::2], strict=True))


def shape_of(data: bytes) -> tuple[str | None, list | None, list | None]:
    """(kind, points, rings) of a record's content. Null shapes have none of them."""
    kind = KINDS.get(struct.unpack_from("<i", data)[0] % 10)
    if kind == "POINT":
        return kind, _pairs(data, 4, 1), None
    if kind == "MULTIPOINT":
        return kind, _pairs(data, 40, struct.unpack_from("<i", data, 36)[0]), None
    if kind in ("POLYGON", "LINESTRING"):
        parts, n = struct.unpack_from("<ii", data, 36)
        starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
        points = _pairs(data, 44 + 4 * parts, n)
        rings = []
        for a, b in zip(starts, starts[1:], strict=False):
            ring = points[a:b]
            turn = sum(p[0] * r[1] - r[0] * p[1] for p, r in zip(ring, ring[1:] + ring[:1], strict=True))
            rings.append((turn > 0, ring))
        outer = sum(not hole for hole, _ in rings)
        return ("MULTIPOLYGON" if kind == "POLYGON" and outer > 1 else kind), None, rings
    return None, None, None


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        records = (Path(self.path).with_suffix(".shx").stat().st_size - 100) // 8
        return [Range(a, min(records, a + RECORDS)) for a in range(0, max(records, 1), RECORDS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        base = Path(self.path)
        head, row, fields = fields_of(base.with_suffix(".dbf"))
        with base.with_suffix(".shx").open("rb") as index, base.with_suffix(".shp").open("rb") as shp, base.with_suffix(".dbf").open("rb") as dbf:
            for record in range(partition.first, partition.stop):
                index.seek(100 + 8 * record)
                offset, length = struct.unpack(">ii", index.read(8))
                shp.seek(2 * offset + 8)
                shape = shape_of(shp.read(2 * length))
                dbf.seek(head + row * record)
                text = dbf.read(row)[1:]
                values, at = [], 0
                for _, width in fields:
                    values.append(text[at : at + width].decode("utf-8", "replace").strip() or None)
                    at += width
                yield (*values, *shape)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        _, _, fields = fields_of(Path(self.options["path"]).with_suffix(".dbf"))
        return ", ".join([*[f"`{n}` string" for n, _ in fields], GEOMETRY])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapefileReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
