"""NetCDF in its classic forms: stacks of daily grids as (x, y, date, value), and writing a grid as such a file.

The newer form is HDF5, which is not read. Each file is decoded by one task, a plane at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: list tags and types by number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
XNAMES, YNAMES = ("lon", "longitude", "x"), ("lat", "latitude", "y")


class NetCdf:
    """Header of a classic file: dimensions (name, size), variables by name; `plane` reads their data."""

    def __init__(self, raw: bytes):
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.raw, self.at, self.wide = raw, 4, raw[3] == 2
        self.records = self._int()
        self.dimensions = [(self._name(), self._int()) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            attributes, kind, size = self._attributes(), self._int(), self._int()
            start = struct.unpack_from(">q" if self.wide else ">i", raw, self.at)[0]
            self.at += 8 if self.wide else 4
            self.variables[name] = {"dims": dims, "attributes": attributes, "type": np.dtype(TYPES[kind]), "size": size, "start": start}
        self.record = sum(v["size"] for v in self.variables.values() if v["dims"] and self.dimensions[v["dims"][0]][1] == 0)

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.raw, self.at - 4)[0]

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("damaged header")
        return n

    def _name(self) -> str:
        n = self._int()
        self.at += -(-n // 4) * 4
        return self.raw[self.at - -(-n // 4) * 4 :][:n].decode("utf-8")

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._int(), self._int()
            values = np.frombuffer(self.raw, TYPES[kind], n, self.at)
            out[name] = values.tobytes().decode("utf-8", "replace") if kind == 2 else values
            self.at += -(-n * values.dtype.itemsize // 4) * 4
        return out

    def shape(self, name: str) -> list[int]:
        return [self.dimensions[d][1] or self.records for d in self.variables[name]["dims"]]

    def plane(self, name: str, record: int | None = None) -> np.ndarray:
        """A variable's values, those of one entry of its first dimension where `record` is given."""
        v, shape = self.variables[name], self.shape(name)
        unlimited = v["dims"] and self.dimensions[v["dims"][0]][1] == 0
        each = int(np.prod(shape[1:], dtype=int)) if shape else 1
        if record is None:
            return np.stack([self.plane(name, k) for k in range(shape[0])]) if unlimited else np.frombuffer(self.raw, v["type"], each * (shape[0] if shape else 1), v["start"]).reshape(shape)
        start = v["start"] + record * (self.record if unlimited else each * v["type"].itemsize)
        return np.frombuffer(self.raw, v["type"], each, start).reshape(shape[1:])


def encode(variables: dict[str, tuple[list[str], np.ndarray, dict]], dimensions: dict[str, int]) -> bytes:
    """A classic file (64-bit offsets) of variables: name -> (dimensions, array, attributes as text or numbers)."""
    kinds = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode().ljust(-(-len(s.encode()) // 4) * 4, b"\0")
    names = list(dimensions)

    def attributes(values: dict) -> bytes:
        out = struct.pack(">ii", ATTRIBUTES if values else 0, len(values))
        for name, value in values.items():
            if isinstance(value, str):
                out += text(name) + struct.pack(">i", 2) + text(value)
            else:
                out += text(name) + struct.pack(">iid", 6, 1, float(value))
        return out

    data = [np.ascontiguousarray(a, a.dtype.newbyteorder(">")).tobytes() for _, a, _ in variables.values()]
    data = [d.ljust(-(-len(d) // 4) * 4, b"\0") for d in data]

    def header(starts):
        out = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSIONS, len(names))
        out += b"".join(text(n) + struct.pack(">i", dimensions[n]) for n in names) + attributes({})
        out += struct.pack(">ii", VARIABLES, len(variables))
        for (name, (dims, a, values)), raw, start in zip(variables.items(), data, starts):
            out += text(name) + struct.pack(f">{len(dims) + 1}i", len(dims), *(names.index(d) for d in dims)) + attributes(values)
            out += struct.pack(">iiq", kinds[a.dtype.str[1:]], len(raw), start)
        return out

    first = len(header([0] * len(data)))
    starts = [first + int(x) for x in np.cumsum([0, *map(len, data)])[:-1]]
    return header(starts) + b"".join(data)


def daily(spark: SparkSession, path: str, variable: str = "sm", pattern: str = "*.nc") -> DataFrame:
    """(x, y, date, value) of daily grids; the date is the first eight digits of the file's name.

    Fill values are null; scale and offset are applied. A file with a time axis of one entry is one grid.
    """

    def decode(batches):
        for b in batches:
            for day, raw in zip(b["day"].to_pylist(), b["content"].to_pylist()):
                file = NetCdf(raw)
                v, names = file.variables[variable], [file.dimensions[d][0] for d in file.variables[variable]["dims"]]
                if len(names) == 3 and file.shape(variable)[0] != 1:
                    raise ValueError(f"{variable} has more than one time in a daily file")
                plane = file.plane(variable, 0) if len(names) == 3 else file.plane(variable)
                y, x = (file.plane(next(n for n in names if n.lower() in wanted)).astype(float) for wanted in (YNAMES, XNAMES))
                fill = [float(v["attributes"][a][0]) for a in ("_FillValue", "missing_value") if a in v["attributes"]]
                scale, offset = (float(v["attributes"][a][0]) if a in v["attributes"] else d for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
                flat = plane.astype(np.float64).ravel()
                gone = np.isnan(flat) | np.isin(flat, fill)
                yy, xx = np.repeat(y, len(x)), np.tile(x, len(y))
                yield pa.RecordBatch.from_arrays([pa.array(xx), pa.array(yy), pa.array([day] * len(flat)), pa.array(flat * scale + offset, mask=gone)], ["x", "y", "day", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    day = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{8})", 1).alias("day")
    rows = files.select(day, "content").where("day != ''").mapInArrow(decode, "x double, y double, day string, value double")
    return rows.select("x", "y", F.to_date("day", "yyyyMMdd").alias("date"), "value")


def month_pattern(year: int, month: int) -> str:
    """The name pattern of one month's daily files."""
    return f"*{year:04d}{month:02d}??*.nc"
