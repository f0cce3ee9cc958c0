"""GeoTIFF as a Spark data source: baseline strips and tiles, uncompressed or Deflate, predictors 1 to 3.

``spark.read.format("gridloom.tiff").option("path", ...)`` gives raw samples (row, col, band, sample, mask); every block of
the file is a partition of its own that reads only its bytes. Options: path, overview, x, y, width, height, bands.
The data source opens paths as local files, which all executors must share. ``load`` takes any path that Spark can read: in
other stores the file's blocks are cut out of Spark's ``binaryFile`` source, dealt to tasks and decoded there (files of up to 2 GB).
"""

from __future__ import annotations

import mmap
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.model import Grid, require
from gridloom.sources import files

SCHEMA = "row int, col int, band int, sample double, mask int"
# TIFF field sizes and struct codes, and sample types by (format, bits).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {(1, 8): "u1", (2, 8): "i1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Image:
    order: str
    tags: dict = field(default_factory=dict)

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None else v[0]

    @property
    def width(self) -> int:
        return self.one(256)

    @property
    def height(self) -> int:
        return self.one(257)

    @property
    def bands(self) -> int:
        return self.one(277, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = SAMPLES.get((self.one(339, 1), self.one(258, 1)))
        require(kind is not None, "unsupported sample type")
        return np.dtype(self.order + kind)

    @property
    def block(self) -> tuple[int, int]:
        """Width and height of a block."""
        return (self.one(322), self.one(323)) if 322 in self.tags else (self.width, min(self.height, self.one(278, self.height)))

    @property
    def separate(self) -> bool:
        return self.one(284, 1) == 2

    def nodata(self) -> float | None:
        raw = self.tags.get(42113)
        return float(bytes(raw).split(b"\0")[0]) if raw else None

    def grid(self, crs: str | None = None) -> Grid:
        scale, tie = self.tags.get(33550), self.tags.get(33922)
        require(scale is not None and tie is not None and 34264 not in self.tags, "a north-up georeference is required")
        x0, y0 = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        return Grid(self.width, self.height, (x0, scale[0], 0.0, y0, 0.0, -scale[1]), crs or self.crs())

    def crs(self) -> str:
        keys = self.tags.get(34735) or ()
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = codes.get(3072) or codes.get(2048)
        require(bool(code), "a CRS is required")
        require(codes.get(1024) != 2 or code == 4326, "geographic rasters must be EPSG:4326")
        return f"EPSG:{code}"

    def blocks(self):
        """(number, band or None for all, x, y) of each block."""
        bw, bh = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        for p in range(self.bands if self.separate else 1):
            for i in range(across * down):
                yield p * across * down + i, p if self.separate else None, i % across * bw, i // across * bh


def images(data) -> list[Image]:
    """The images of a file (the first, then overviews and masks), from its bytes, a map of it, or ranges."""
    head = files.piece(data, 0, 16)
    require(head[:2] in (b"II", b"MM"), "not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack(order + "H", head[2:4])[0]
    require(magic in (42, 43), "not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    out = []
    while at:
        image = Image(order)
        n = files.unpack(data, order + ("Q" if big else "H"), at)[0]
        at += 8 if big else 2
        for _ in range(n):
            tag, kind = files.unpack(data, order + "HH", at)
            count = files.unpack(data, order + ("Q" if big else "I"), at + 4)[0]
            size, slot = SIZES.get(kind, 0) * count, at + (12 if big else 8)
            where = slot if size <= (8 if big else 4) else files.unpack(data, order + ("Q" if big else "I"), slot)[0]
            if kind in (2, 7):
                image.tags[tag] = tuple(files.piece(data, where, count))
            elif kind in CODES:
                image.tags[tag] = files.unpack(data, f"{order}{count}{CODES[kind]}", where)
            at += 20 if big else 12
        out.append(image)
        at = files.unpack(data, order + ("Q" if big else "I"), at)[0]
    return out


def extent(image: Image, number: int) -> tuple[int, int]:
    """Place and number of bytes of a block."""
    return (image.tags.get(324) or image.tags[273])[number], (image.tags.get(325) or image.tags[279])[number]


def block_samples(image: Image, data, number: int) -> np.ndarray:
    """A decoded block as (height, width, bands of the block)."""
    return decode_block(image, files.piece(data, *extent(image, number)), number)


def decode_block(image: Image, raw: bytes, number: int) -> np.ndarray:
    bw, bh = image.block
    per = 1 if image.separate else image.bands
    if 322 not in image.tags:
        rows = -(-image.height // bh)
        bh = min(bh, image.height - number % rows * bh)
    if not raw:
        return np.zeros((bh, bw, per), image.dtype)
    kind = image.one(259, 1)
    require(kind in (1, 8, 32946), "only uncompressed and Deflate blocks are supported")
    if kind != 1:
        raw = zlib.decompress(raw)
    dt, predictor = image.dtype, image.one(317, 1)
    require(predictor in (1, 2, 3), "unsupported predictor")
    if predictor == 3:
        b = np.frombuffer(raw, np.uint8).reshape(bh, dt.itemsize * bw * per).copy()
        b = np.add.accumulate(b.reshape(bh, -1, per), axis=1, dtype=np.uint8).reshape(bh, dt.itemsize, bw * per)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(np.dtype(">" + dt.str[1:])).reshape(bh, bw, per).astype(dt.newbyteorder("="))
    a = np.frombuffer(raw, dt, bh * bw * per).reshape(bh, bw, per).astype(dt.newbyteorder("="))
    return np.add.accumulate(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def pick(found: list[Image], overview: int | None) -> tuple[Image, Image | None]:
    """The image of an explicit overview (from 0), or the full one; and its mask. Metadata comes from the full image."""
    full = [i for i in found if not i.one(254, 0) & 4]
    masks = [i for i in found if i.one(254, 0) & 4]
    require(overview is None or 0 <= overview < len(full) - 1, "no such overview")
    image = full[0 if overview is None else overview + 1]
    for tag in (42113, 33550, 34735):
        if tag in full[0].tags and tag not in image.tags and tag == 42113:
            image.tags[tag] = full[0].tags[tag]
    return image, next((m for m in masks if (m.width, m.height) == (image.width, image.height)), None)


def decode(data, overview: int | None = None) -> tuple[Image, np.ndarray, np.ndarray]:
    """(image, samples as (bands, height, width), mask) of a whole file."""
    image, mask = pick(images(data), overview)
    out = np.zeros((image.bands, image.height, image.width), image.dtype.newbyteorder("="))
    for number, band, x, y in image.blocks():
        s = block_samples(image, data, number)
        h, w = min(s.shape[0], image.height - y), min(s.shape[1], image.width - x)
        if band is None:
            out[:, y : y + h, x : x + w] = s[:h, :w].transpose(2, 0, 1)
        else:
            out[band, y : y + h, x : x + w] = s[:h, :w, 0]
    m = np.full((image.height, image.width), 255, np.uint8)
    if mask is not None:
        for number, _, x, y in mask.blocks():
            s = block_samples(mask, data, number)[..., 0]
            h, w = min(s.shape[0], mask.height - y), min(s.shape[1], mask.width - x)
            m[y : y + h, x : x + w] = np.where(s[:h, :w] != 0, 255, 0)
    return image, out, m


class _Block(InputPartition):
    def __init__(self, number: int, band: int | None, x: int, y: int):
        self.number, self.band, self.x, self.y = number, band, x, y


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom.tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


class TiffReader(DataSourceReader):
    def __init__(self, options):
        known = {"path", "overview", "x", "y", "width", "height", "bands"}
        require(set(options) <= known and "path" in options, f"options are {sorted(known)}, and path is required")
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.overview = int(options["overview"]) if "overview" in options else None
        self.box = tuple(int(options[k]) if k in options else None for k in ("x", "y", "width", "height"))
        self.only = {int(b) for b in options["bands"].split(",")} if "bands" in options else None

    def _open(self):
        with open(self.path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        image, mask = pick(images(data), self.overview)
        return data, image, mask

    def _window(self, image: Image) -> tuple[int, int, int, int]:
        x, y, w, h = self.box
        x, y = x or 0, y or 0
        return x, y, min(image.width, x + w if w is not None else image.width), min(image.height, y + h if h is not None else image.height)

    def partitions(self):
        data, image, _ = self._open()
        x0, y0, x1, y1 = self._window(image)
        bw, bh = image.block
        data.close()
        return [_Block(n, b, x, y) for n, b, x, y in image.blocks() if x < x1 and y < y1 and x + bw > x0 and y + bh > y0 and (b is None or self.only is None or b in self.only)]

    def read(self, partition: _Block):
        data, image, mask = self._open()
        s = block_samples(image, data, partition.number)
        h, w = min(s.shape[0], image.height - partition.y), min(s.shape[1], image.width - partition.x)
        m = np.full((h, w), 255, np.int32) if mask is None else mask_part(mask, data, partition.x, partition.y, w, h)
        yield from _cells(s[:h, :w], m, partition.band, partition.x, partition.y, self._window(image), self.only)


def _cells(s: np.ndarray, m: np.ndarray, band: int | None, x: int, y: int, window: tuple[int, int, int, int], only: set[int] | None):
    """A block's samples within a window, as a batch for each band."""
    import pyarrow as pa

    x0, y0, x1, y1 = window
    rows, cols = np.meshgrid(np.arange(y, y + s.shape[0]), np.arange(x, x + s.shape[1]), indexing="ij")
    keep = (rows >= y0) & (rows < y1) & (cols >= x0) & (cols < x1)
    for k in range(s.shape[2]):
        b = k if band is None else band
        if only is None or b in only:
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(rows[keep].astype(np.int32)), pa.array(cols[keep].astype(np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(s[..., k][keep].astype(float)), pa.array(m[keep])], names=["row", "col", "band", "sample", "mask"])


def mask_part(mask: Image, data, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The mask over a rectangle; only blocks that meet it are decoded."""
    m = np.zeros((h, w), np.int32)
    bw, bh = mask.block
    for number, _, bx, by in mask.blocks():
        if bx < x + w and bx + bw > x and by < y + h and by + bh > y:
            s = block_samples(mask, data, number)[..., 0]
            x0, y0, x1, y1 = max(x, bx), max(y, by), min(x + w, bx + s.shape[1], mask.width), min(y + h, by + s.shape[0], mask.height)
            m[y0 - y : y1 - y, x0 - x : x1 - x] = np.where(s[y0 - by : y1 - by, x0 - bx : x1 - bx] != 0, 255, 0)
    return m


def _from_binary(spark: SparkSession, path: str, image: Image) -> DataFrame:
    """(row, col, band, sample) of an image whose blocks are cut out of the file by Spark."""
    rows = [(n, -1 if b is None else b, x, y, *extent(image, n)) for n, b, x, y in image.blocks()]
    blocks = spark.createDataFrame(rows, "number int, b int, x int, y int, at long, n long")
    content = spark.read.format("binaryFile").load(path).select("content")
    cut = content.crossJoin(F.broadcast(blocks)).select("number", "b", "x", "y", F.substr("content", F.col("at") + 1, F.col("n")).alias("raw"))  # one file

    def kernel(it):
        for batch in it:
            for r in batch.to_pylist():
                s = decode_block(image, r["raw"], r["number"])
                h, w = min(s.shape[0], image.height - r["y"]), min(s.shape[1], image.width - r["x"])
                yield from _cells(s[:h, :w], np.full((h, w), 255, np.int32), None if r["b"] < 0 else r["b"], r["x"], r["y"], (0, 0, image.width, image.height), None)

    return cut.repartition("number").mapInArrow(kernel, SCHEMA)


def load(spark: SparkSession, path: str, overview: int | None = None) -> DataFrame:
    """Raw samples (row, col, band, sample, mask) of a file in any store that Spark reads."""
    if files.is_local(path):
        spark.dataSource.register(TiffSource)
        reader = spark.read.format("gridloom.tiff").option("path", path)
        return (reader if overview is None else reader.option("overview", overview)).load()
    image, mask = pick(images(files.Ranges(spark, path)), overview)
    samples = _from_binary(spark, path, image)
    if mask is None:
        return samples
    m = _from_binary(spark, path, mask).select("row", "col", F.when(F.col("sample") != 0, 255).otherwise(0).alias("m"))
    return samples.join(m, ["row", "col"]).select("row", "col", "band", "sample", F.col("m").alias("mask"))
