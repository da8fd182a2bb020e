"""Binary sources: grids of a text header with raw numbers, and shapefiles, also zipped.

Files are read by Spark, so they may lie in any store it reaches; each is decoded by one task (at most 2 GB a file:
larger rasters come as tiles). Both decoders give rows in Arrow batches of a bounded number of cells or records.
"""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: sample types of the grid header, and shape types with parts.
SAMPLES = {"BYTE": "u1", "BYTE_UNSIGNED": "u1", "SHORTINT": "i2", "SHORTINT_UNSIGNED": "u2", "INTEGER": "i4", "INTEGER_UNSIGNED": "u4", "FLOAT": "f4", "DOUBLE": "f8"}
WITH_PARTS = {3, 5, 13, 15, 23, 25}
SINGLE = {1, 11, 21}
CELLS = 1 << 18


def grid_header(text: str) -> dict[str, str]:
    return {k.strip().upper(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines()) if v}


def saga_grids(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, x, y, z) of all cells of grids *.sdat with their headers *.sgrd; row 0 is the northernmost.

    x and y are the cells' centres; cells without data have null.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    stem = F.regexp_replace("path", r"\.[^.]*$", "").alias("file")
    heads = read.option("pathGlobFilter", "*.sgrd").load(path).select(stem, F.decode("content", "UTF-8").alias("head"))
    body = read.option("pathGlobFilter", "*.sdat").load(path).select(stem, "content")

    def decode(batches):
        for b in batches:
            for file, head, raw in zip(b["file"].to_pylist(), b["head"].to_pylist(), b["content"]):
                h = grid_header(head)
                wide, high, size = int(h["CELLCOUNT_X"]), int(h["CELLCOUNT_Y"]), float(h["CELLSIZE"])
                kind = np.dtype(SAMPLES[h["DATAFORMAT"]]).newbyteorder(">" if h.get("BYTEORDER_BIG", "FALSE") == "TRUE" else "<")
                at = int(h.get("DATAFILE_OFFSET", "0"))
                z = np.frombuffer(raw.as_buffer(), kind, wide * high, at).reshape(high, wide)
                if h.get("TOPTOBOTTOM", "FALSE") != "TRUE":
                    z = z[::-1]
                none = [float(v) for v in h.get("NODATA_VALUE", "nan").split(";")]
                xmin, ymin, factor = float(h["POSITION_XMIN"]), float(h["POSITION_YMIN"]), float(h.get("Z_FACTOR", "1"))
                step = max(1, CELLS // wide)
                for top in range(0, high, step):
                    part = z[top : top + step].astype(np.float64)
                    row, col = np.divmod(np.arange(part.size), wide)
                    row, flat = row + top, part.ravel()
                    gone = np.isnan(flat) | ((flat >= none[0]) & (flat <= none[-1]))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(flat)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(xmin + col * size), pa.array(ymin + (high - 1 - row) * size), pa.array(flat * factor, mask=gone)], ["file", "row", "col", "x", "y", "z"])

    return body.join(heads, "file").mapInArrow(decode, "file string, row int, col int, x double, y double, z double")


def _members(path: str, raw: bytes, ending: str):
    """(name, bytes) of the files with an ending: the file itself, or those within a zip file."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted(z.namelist()):
                if name.lower().endswith(ending):
                    yield f"{path}/{name}", z.read(name)
    elif path.lower().endswith(ending):
        yield path, raw


def shape_records(raw: bytes):
    """(record, part, coordinates as an array of two columns) of a shapefile's main file."""
    at, end = 100, min(len(raw), 2 * struct.unpack(">i", raw[24:28])[0])
    while at + 12 <= end:
        number, words = struct.unpack_from(">2i", raw, at)
        kind = struct.unpack_from("<i", raw, at + 8)[0]
        body = at + 12
        if kind in SINGLE:
            yield number, 0, np.frombuffer(raw, "<f8", 2, body).reshape(1, 2)
        elif kind in WITH_PARTS:
            parts, total = struct.unpack_from("<2i", raw, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", raw, body + 40), total]
            xy = np.frombuffer(raw, "<f8", 2 * total, body + 40 + 4 * parts).reshape(-1, 2)
            for k in range(parts):
                yield number, k, xy[starts[k] : starts[k + 1]]
        elif kind:
            raise ValueError(f"shape type {kind} is not supported")
        at += 8 + 2 * words


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, part, place, px, py): the vertices of shapefiles, or of zip files with them, in order."""

    def decode(batches):
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                for name, data in _members(path, raw, ".shp"):
                    for record, part, xy in shape_records(data):
                        n = len(xy)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, record, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["file", "record", "part", "place", "px", "py"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,zip}").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, record int, part int, place int, px double, py double")


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, fields): the attribute tables of shapefiles as maps of strings; deleted rows are left out."""

    def decode(batches):
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                for name, data in _members(path, raw, ".dbf"):
                    rows, head, width = struct.unpack_from("<IHH", data, 4)
                    fields, at = [], 32
                    while data[at] != 0x0D:
                        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
                        at += 32
                    numbers, maps = [], []
                    for k in range(rows):
                        row, place = data[head + k * width : head + (k + 1) * width], 1
                        if row[:1] == b"*":
                            continue
                        values = []
                        for field, size in fields:
                            values.append((field, row[place : place + size].decode("utf-8", "replace").strip() or None))
                            place += size
                        numbers.append(k + 1)
                        maps.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(maps)), pa.array(numbers, pa.int32()), pa.array(maps, pa.map_(pa.string(), pa.string()))], ["file", "record", "fields"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dbf,zip}").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, record int, fields map<string,string>")
