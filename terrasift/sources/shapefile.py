"""Polygon shapefiles as a Spark data source: spark.read.format("shapefile").option("columns", "A,B").load(path).

One row per shape: the attributes asked for (all, if none are named; numbers as double, others as string) and `rings`,
all rings of all parts, NULL for a null shape. The path is one .shp with its .dbf beside it. Records are cut into
splits by the .shx where there is one, so a large file is read by several tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

RINGS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
POLYGONS = (5, 15, 25)


def fields(dbf: bytes) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, type, offset, length) of the fields, and the count, header size and record size."""
    count, header, record = struct.unpack_from("<IHH", dbf, 4)
    out, offset = [], 1
    for at in range(32, header - 1, 32):
        if dbf[at] == 0x0D:
            break
        name, kind, length = dbf[at : at + 11].split(b"\0")[0].decode("ascii"), chr(dbf[at + 11]), dbf[at + 16]
        out.append((name, kind, offset, length))
        offset += length
    return out, count, header, record


def polygon(content: bytes) -> list[list[tuple[float, float]]] | None:
    """Rings of a record's content; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is not a polygon")
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", content, 44 + 4 * parts)
    xy = list(zip(flat[::2], flat[1::2], strict=True))
    return [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]


class Split(InputPartition):
    def __init__(self, first: int, offset: int, count: int):
        self.first, self.offset, self.count = first, offset, count


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, per_split: int):
        self.path, self.names, self.per_split = Path(path), schema.names, per_split

    def partitions(self) -> list[Split]:
        index = self.path.with_suffix(".shx")
        if not index.exists():
            return [Split(0, 100, -1)]
        raw = index.read_bytes()
        n = (len(raw) - 100) // 8
        return [Split(i, 2 * struct.unpack_from(">i", raw, 100 + 8 * i)[0], min(self.per_split, n - i)) for i in range(0, n, self.per_split)] or [Split(0, 100, 0)]

    def read(self, split: Split) -> Iterator[tuple]:
        dbf = self.path.with_suffix(".dbf")
        with self.path.open("rb") as shapes, dbf.open("rb") as table:
            found, _, header, record = fields(table.read(65536))
            wanted = {name: (kind, offset, length) for name, kind, offset, length in found if name in self.names}
            shapes.seek(split.offset)
            k = split.first
            while split.count < 0 or k < split.first + split.count:
                head = shapes.read(8)
                if len(head) < 8:
                    break
                content = shapes.read(2 * struct.unpack(">ii", head)[1])
                table.seek(header + k * record)
                row, values = table.read(record), {}
                for name, (kind, offset, length) in wanted.items():
                    text = row[offset : offset + length].decode("utf-8", "replace").strip(" \0")
                    values[name] = (float(text) if text else None) if kind in "NF" else text or None
                values["rings"] = polygon(content) if "rings" in self.names else None
                yield tuple(values.get(n) for n in self.names)
                k += 1


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        with Path(self.options["path"]).with_suffix(".dbf").open("rb") as f:
            found, *_ = fields(f.read(65536))
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        kinds = {name: DoubleType() if kind in "NF" else StringType() for name, kind, _, _ in found}
        if lacking := [c for c in asked if c not in kinds]:
            raise ValueError(f"missing columns: {', '.join(lacking)}")
        return StructType([*(StructField(c, kinds[c]) for c in asked or kinds), StructField("rings", RINGS)])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("recordspersplit", "256")))


def read_shapes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format("shapefile")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
