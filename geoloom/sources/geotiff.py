"""GeoTIFF files: reading whole or tiled rasters as cells, and writing cells as tiles of GeoTIFF.

Files are read by Spark, so they may lie in any store it reaches; each is decoded by one task a band of rows at a time
(at most 2 GB a file: larger rasters come as tiles, which is how they are written here too). Classic and big files,
strips and tiles, either byte order, planes together or apart; no compression, LZW, deflate; predictors 1 to 3.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid

#: Fixed values of the format: tags, field types by number, compressions and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}
CELLS = 1 << 18


def _lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    out, bits, held, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, last = 9, b""
    while len(out) < size:
        while bits < width:
            if at >= len(raw):
                return bytes(out)
            held, bits, at = held << 8 | raw[at], bits + 8, at + 1
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def _to_lzw(raw: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    def clear():
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    run = b""
    for byte in raw:
        longer = run + bytes([byte])
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = len(table) + 2
        width = max(9, (len(table) + 2).bit_length())
        if len(table) + 2 >= 4094:
            clear()
        run = longer[-1:]
    if run:
        put(table[run])
        width = min(12, max(9, (len(table) + 3).bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


@dataclass
class GeoTiff:
    """The first image of a file, decoded by bands of rows."""

    raw: bytes
    tags: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        raw = self.raw
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
        magic = struct.unpack_from(self.order + "H", raw, 2)[0] if self.order else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        at = struct.unpack_from(self.order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
        count = struct.unpack_from(self.order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        for _ in range(count):
            tag, kind, n = struct.unpack_from(self.order + ("HHQ" if big else "HHI"), raw, at)
            form, room = FIELDS.get(kind), 8 if big else 4
            start = at + (12 if big else 8)
            at += 20 if big else 12
            if form is None:
                continue
            size = struct.calcsize("=" + form) * n
            if size > room:
                start = struct.unpack_from(self.order + ("Q" if big else "I"), raw, start)[0]
            self.tags[tag] = (bytes(raw[start : start + n]),) if form == "s" else struct.unpack_from(self.order + form * n, raw, start)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        self.type = np.dtype(f"{self.order}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
        self.tiled = TILES in self.tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(STRIP_ROWS, self.height), self.height), self.width)
        self.offsets, self.sizes = (self.tags[TILES], self.tags[TILE_SIZES]) if self.tiled else (self.tags[STRIPS], self.tags[STRIP_SIZES])

    def _text(self, tag: int) -> str:
        return self.tags.get(tag, (b"",))[0].split(b"\0")[0].decode("utf-8", "replace").strip()

    @property
    def nodata(self) -> float | None:
        return float(text) if (text := self._text(NODATA)) else None

    @property
    def names(self) -> list[str]:
        """Band names: those the metadata give, else b1, b2 and so on."""
        given = {int(re.search(r'sample="(\d+)"', item).group(1)): name for item, name in re.findall(r'<Item ([^>]*role="description"[^>]*)>([^<]*)</Item>', self._text(METADATA))}
        return [given.get(k, f"b{k + 1}") for k in range(self.samples)]

    @property
    def epsg(self) -> int | None:
        """The projected or else geographic system that the keys name."""
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(3072) or found.get(2048)

    @property
    def grid(self) -> Grid:
        if TRANSFORM in self.tags:
            t = self.tags[TRANSFORM]
            return Grid(t[3], t[0], t[7], -t[5], self.height, self.width)
        sx, sy = self.tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y = self.tags.get(TIEPOINT, (0, 0, 0, 0.0, 0.0))[:5]
        return Grid(x - i * sx, sx, y + j * sy, sy, self.height, self.width)

    def _block(self, k: int) -> np.ndarray:
        """A strip or tile as (rows, columns, samples), as it was before compression."""
        high, wide = self.block
        samples = 1 if self.apart else self.samples
        raw = self.raw[self.offsets[k] : self.offsets[k] + self.sizes[k]]
        size = high * wide * samples * self.type.itemsize
        if self.compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif self.compression == LZW:
            raw = _lzw(raw, size)
        elif self.compression != NONE:
            raise ValueError(f"compression {self.compression} is not supported")
        rows = len(raw) // (wide * samples * self.type.itemsize)
        if self.predictor == 3:
            bytes_ = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, -1)
            planes = bytes_.reshape(rows, self.type.itemsize, wide * samples).transpose(0, 2, 1)
            return np.ascontiguousarray(planes).view(self.type.newbyteorder(">")).reshape(rows, wide, samples)
        out = np.frombuffer(raw, self.type, rows * wide * samples).reshape(rows, wide, samples)
        return np.cumsum(out, axis=1, dtype=out.dtype) if self.predictor == 2 else out

    def rows(self):
        """(first row, array of bands, rows and columns) for every band of blocks."""
        high, wide = self.block
        across, down = -(-self.width // wide), -(-self.height // high)
        for r in range(down):
            top, planes = r * high, []
            for p in range(self.samples if self.apart else 1):
                line = [self._block(p * across * down + r * across + c) for c in range(across)]
                planes.append(np.concatenate(line, 1)[: self.height - top, : self.width])
            yield top, np.concatenate(planes, 2).transpose(2, 0, 1)


def encode(bands: np.ndarray, grid: Grid, names: list[str] | None = None, nodata: float | None = None, epsg: int | None = None, compression: int = LZW, tile: int = 256, big: bool = False) -> bytes:
    """A tiled GeoTIFF of an array (bands, rows, columns), planes apart, little-endian."""
    count, height, width = bands.shape
    tile = min(tile, -(-max(height, width) // 16) * 16)  # a multiple of 16, no larger than need be
    kind = bands.dtype.newbyteorder("<")
    blocks = []
    for plane in bands:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                block = np.zeros((tile, tile), kind)
                part = plane[r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                raw = block.tobytes()
                blocks.append(_to_lzw(raw) if compression == LZW else zlib.compress(raw, 6) if compression in (DEFLATE, OLD_DEFLATE) else raw)
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    offset_type = 16 if big else 4
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (kind.itemsize * 8,) * count), (COMPRESSION, 3, (compression,)),
        (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (count,)), (PLANAR, 3, (2,)), (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)),
        (TILES, offset_type, (0,) * len(blocks)), (TILE_SIZES, offset_type, tuple(map(len, blocks))), (SAMPLE_FORMAT, 3, (sample,) * count),
        (PIXEL_SCALE, 12, (grid.xres, grid.yres, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0)),
    ]
    if epsg:
        geographic = 4000 <= epsg < 5000
        tags.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)))
    if names:
        items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{n}</Item>' for k, n in enumerate(names))
        tags.append((METADATA, 2, (f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0",)))
    if nodata is not None:
        tags.append((NODATA, 2, (repr(float(nodata)).encode() + b"\0",)))
    tags.sort()
    head, entry, room = (16, 20, 8) if big else (8, 12, 4)
    data_at = head + (8 if big else 2) + entry * len(tags) + room
    packed = [(t, k, v, v[0] if k == 2 else struct.pack("<" + FIELDS[k] * len(v), *v)) for t, k, v in tags]
    blocks_at = data_at + sum(len(raw) for *_, raw in packed if len(raw) > room)
    starts = tuple(blocks_at + int(x) for x in np.cumsum([0, *map(len, blocks)])[:-1])
    packed = [(t, k, v, struct.pack("<" + FIELDS[k] * len(starts), *starts) if t == TILES else raw) for t, k, v, raw in packed]
    ifd, data = b"", b""
    for tag, k, v, raw in packed:
        n = len(raw) if k == 2 else len(v)
        place = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack("<Q" if big else "<I", data_at + len(data))
        data += raw if len(raw) > room else b""
        ifd += struct.pack("<HHQ" if big else "<HHI", tag, k, n) + place
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) if big else struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags))
    return start + ifd + b"\0" * room + data + b"".join(blocks)


def cells(spark: SparkSession, path: str, bands: list[str] | None = None, pattern: str = "*.tif*") -> DataFrame:
    """(file, row, col, x, y, bands..) of all cells of GeoTIFF files; cells without data have null.

    Without `bands`, they are named as in the first file, whose header alone is read; all files have the same bands.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if bands is None:
        first = files.orderBy("path").select("content").first()
        if first is None:
            raise ValueError(f"no {pattern} in {path}")
        bands = GeoTiff(first.content).names
    names = ["file", "row", "col", "x", "y", *bands]

    def decode(batches):
        for b in batches:
            for file, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                image = GeoTiff(raw)
                if image.samples != len(bands):
                    raise ValueError(f"{file} has {image.samples} bands, not {len(bands)}")
                g, none = image.grid, image.nodata
                for top, planes in image.rows():
                    step = max(1, CELLS // image.width)
                    for r in range(0, planes.shape[1], step):
                        part = planes[:, r : r + step].astype(np.float64).reshape(len(bands), -1)
                        row, col = np.divmod(np.arange(part.shape[1]), image.width)
                        row = row + top + r
                        gone = np.isnan(part) | (part == none if none is not None else False)
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(row)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(g.xmin + (col + 0.5) * g.xres), pa.array(g.ymax - (row + 0.5) * g.yres), *(pa.array(v, mask=m) for v, m in zip(part, gone))], names)

    schema = "file string, row int, col int, x double, y double, " + ", ".join(f"`{b}` double" for b in bands)
    return files.select("path", "content").mapInArrow(decode, schema)


def headers(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """(file, bands, names, nrow, ncol, xmin, xres, ymax, yres, nodata, epsg) of GeoTIFF files."""

    def decode(batches):
        for b in batches:
            rows = []
            for file, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                image = GeoTiff(raw)
                g = image.grid
                rows.append((file, image.samples, image.names, g.nrow, g.ncol, float(g.xmin), float(g.xres), float(g.ymax), float(g.yres), image.nodata, image.epsg))
            types = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int32()]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "bands", "names", "nrow", "ncol", "xmin", "xres", "ymax", "yres", "nodata", "epsg"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, bands int, names array<string>, nrow int, ncol int, xmin double, xres double, ymax double, yres double, nodata double, epsg int")


def tiles(raster: DataFrame, grid: Grid, bands: list[str], size: int = 1024, nodata: float = -9999.0, epsg: int | None = None, compression: int = LZW) -> DataFrame:
    """(name, content): cells (row, col, bands..) as GeoTIFF files of size x size cells at most, one made by a task.

    Cells that are missing or null get nodata; tiles without cells are left out.
    """

    def make(key, rows):
        import pandas as pd

        r, c = (int(k) for k in key)
        high, wide = min(size, grid.nrow - r * size), min(size, grid.ncol - c * size)
        out = np.full((len(bands), high, wide), nodata, np.float64)
        at = rows.row.to_numpy() - r * size, rows.col.to_numpy() - c * size
        for k, band in enumerate(bands):
            out[k][at] = rows[band].fillna(nodata).to_numpy()
        g = Grid(grid.xmin + c * size * grid.xres, grid.xres, grid.ymax - r * size * grid.yres, grid.yres, high, wide)
        return pd.DataFrame({"name": [f"tile_{r:04d}_{c:04d}.tif"], "content": [encode(out, g, bands, nodata, epsg, compression)]})

    inside = raster.where(F.col("row").between(0, grid.nrow - 1) & F.col("col").between(0, grid.ncol - 1)).select("row", "col", *(F.col(b).cast("double").alias(b) for b in bands))
    return inside.groupBy(F.expr(f"row div {size}").alias("_r"), F.expr(f"col div {size}").alias("_c")).applyInPandas(make, "name string, content binary")


#: Stores that Arrow's own file systems reach from the executors.
ARROW_STORES = ("file", "s3", "gs")


def save(files: DataFrame, path: str) -> int:
    """Write rows (name, content) as files of a folder, and give their number.

    In stores that Arrow reaches, each task writes its own files: under a name of their own first and then moved, so a
    task that is run again replaces them whole. In any other store they pass the driver one after another.
    """
    spark, n = files.sparkSession, 0
    rows = files.select("name", "content")
    scheme = path.split("://")[0].split(":")[0] if ":" in path else ""
    if scheme in ARROW_STORES:

        def write(batches):
            import uuid

            from pyarrow.fs import FileSystem

            store, folder = FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
            store.create_dir(folder, recursive=True)
            count = 0
            for b in batches:
                for name, content in zip(b["name"].to_pylist(), b["content"]):
                    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(own) as out:
                        out.write(content.as_buffer())
                    store.move(own, f"{folder}/{name}")
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array([count])], ["count"])

        return rows.mapInArrow(write, "count long").agg(F.sum("count")).first()[0] or 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in rows.toLocalIterator():
        target = hadoop(f"{path.rstrip('/')}/{r.name}")
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytearray(r.content))
        finally:
            stream.close()
        n += 1
    return n
