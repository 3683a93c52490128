"""Tiles as text lines, from images, and as images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import tiles


def read_tiles(spark: SparkSession, path: str, query: Column | None = None) -> DataFrame:
    """Lines `ulx,uly,width,height,pixelwidth,values...[,min,max,median]`; with a query, tiles that meet it."""
    p = F.split("value", ",")
    num = lambda i: F.trim(p[i]).cast("double")
    n = (num(2) * num(3)).cast("int")
    values = F.transform(F.slice(p, F.lit(6), n), lambda v: F.trim(v).cast("double"))
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(tiles.tile(num(0), num(1), num(2), num(3), values, num(4)).alias("tile"))
    return rows if query is None else tiles_meeting(rows, query)


def tiles_meeting(df: DataFrame, query: Column, column: str = "tile") -> DataFrame:
    a, b, c, d = tiles.span(F.col(column))
    return df.where((a <= query["xmax"]) & (c >= query["xmin"]) & (b <= query["ymax"]) & (d >= query["ymin"]))


def write_tiles(df: DataFrame, path: str, column: str = "tile", sma: bool = False) -> None:
    t, s = F.col(column), tiles.sma(F.col(column))
    text = lambda c: c.cast("string")
    fields = [text(t[n]) for n in ("ulx", "uly", "width", "height", "pixelwidth")] + [F.array_join(F.transform(t["values"], lambda v: v.cast("string")), ",")]
    df.select(F.concat_ws(",", *fields, *([text(s[n]) for n in ("min", "max", "median")] if sma else []))).write.text(path)


def write_tile_table(df: DataFrame, path: str, column: str = "tile", cells: int = 16) -> None:
    """Parquet with the tiles' bounds as columns, dealt and sorted by place, so that readers can leave row groups out."""
    a, b, c, d = tiles.span(F.col(column))
    rows = df.withColumns({"_xmin": a, "_ymin": b, "_xmax": c, "_ymax": d})
    rows.repartitionByRange(cells, "_xmin", "_ymin").sortWithinPartitions("_xmin", "_ymin").write.parquet(path)


def read_tile_table(spark: SparkSession, path: str, query: Column | None = None) -> DataFrame:
    """Stored tiles, or those that meet a query's envelope, whose comparisons reach the scan."""
    rows = spark.read.parquet(path)
    if query is not None:
        rows = rows.where((F.col("_xmin") <= query["xmax"]) & (F.col("_xmax") >= query["xmin"]) & (F.col("_ymin") <= query["ymax"]) & (F.col("_ymax") >= query["ymin"]))
    return rows.drop("_xmin", "_ymin", "_xmax", "_ymax")


def decode_pgm(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and grey values of a binary or plain portable grey map."""
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        parts.append(data[at:end])
        at = end
    w, h, most = map(int, parts[1:])
    if parts[0] == b"P5":
        return w, h, np.frombuffer(data, ">u2" if most > 255 else "u1", w * h, at + 1).astype(float)
    if parts[0] == b"P2":
        return w, h, np.array(data[at:].split()[: w * h], float)
    raise ValueError("not a grey map")


def read_image_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """A tile of each grey map; names of ten fields parted by _ end in the tile's place (x, y) about (100, 100)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                w, h, v = decode_pgm(content)
                f = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("_")
                x, y = (int(f[-2]) - 100, int(f[-1]) - 100) if len(f) == 10 else (0, 0)
                rows.append((x * w, (y + 1) * h, w, h, 1.0, v.tolist()))
            yield pd.DataFrame(rows, columns=list(tiles.FIELDS))

    kinds = ", ".join(x.replace(":", " ", 1) for x in tiles.TILE[7:-1].split(","))
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(folder).select("path", "content")
    return rows.mapInPandas(run, kinds).select(F.struct(*tiles.FIELDS).alias("tile"))


def png(pixels: np.ndarray) -> bytes:
    """Of rows of (r, g, b) or grey bytes."""
    kind = 2 if pixels.ndim == 3 else 0
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(pixels, np.uint8))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_pixels(df: DataFrame, width: int, height: int, column: str = "tile") -> DataFrame:
    """(px, py, v): the mean value in each pixel of an image of all tiles, at most width x height rows."""
    t = F.col(column)
    a, b, c, d = tiles.span(t)
    e = df.agg(F.min(a).alias("a"), F.min(b).alias("b"), F.max(c).alias("c"), F.max(d).alias("d")).first()
    if e["a"] is None:
        return df.select(F.lit(0).alias("px"), F.lit(0).alias("py"), F.lit(0.0).alias("v")).limit(0)
    rows = df.select(t["ulx"].alias("ulx"), t["uly"].alias("uly"), t["width"].alias("w"), t["pixelwidth"].alias("s"), F.posexplode(t["values"]).alias("i", "v"))
    x = F.col("ulx") + (F.pmod("i", "w") + 0.5) * F.col("s") - e["a"]
    y = F.lit(e["d"]) - F.col("uly") + (F.floor(F.col("i") / F.col("w")) + 0.5) * F.col("s")
    at = lambda v, n, full: F.least(F.floor(v / full * n), F.lit(n - 1)).cast("int")
    return rows.groupBy(at(x, width, e["c"] - e["a"]).alias("px"), at(y, height, e["d"] - e["b"]).alias("py")).agg(F.avg("v").alias("v"))


def point_pixels(df: DataFrame, width: int, height: int, xmin: float, ymin: float, xmax: float, ymax: float, x: str = "x", y: str = "y", mercator: bool = False) -> DataFrame:
    """(px, py, n): points in each pixel of an image, by linear scale or Mercator's (degrees)."""
    if mercator:
        rise = lambda v: F.log(F.tan(F.lit(np.pi / 4) + F.radians(v) / 2))
        lo, hi = (float(np.log(np.tan(np.pi / 4 + np.radians(v) / 2))) for v in (ymin, ymax))
    else:
        rise, lo, hi = (lambda v: v), ymin, ymax
    px = F.floor((F.col(x) - xmin) / (xmax - xmin) * width)
    py = F.floor((F.lit(hi) - rise(F.col(y))) / (hi - lo) * height)
    at = lambda v, n: F.least(v, F.lit(n - 1)).cast("int")
    inside = F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax)
    return df.where(inside).groupBy(at(px, width).alias("px"), at(py, height).alias("py")).agg(F.count("*").alias("n"))


def image(pixels: DataFrame, width: int, height: int, value: str = "v", color: Callable[[float], tuple[int, int, int]] | None = None, background: tuple[int, int, int] | int = 0, size: int = 1, flip: bool = False) -> bytes:
    """PNG of at most width x height pixels: grey from the least value to the greatest, or in the color of each value.

    size: side of the square drawn for each pixel; flip: upside down; pixels without a value have the background's color.
    """
    rows = pixels.select("py", "px", F.col(value).cast("double")).collect()  # width x height at most
    values = np.array([r[2] for r in rows])
    canvas = np.zeros((height, width, 3), np.uint8) + np.array(background, np.uint8)
    lo, hi = (values.min(), values.max()) if len(values) else (0.0, 0.0)
    grey = lambda v: (int((v - lo) / ((hi - lo) or 1) * 255),) * 3
    for y, x, v in sorted(map(tuple, rows)):
        canvas[max(0, y - (size - 1) // 2) : y + size // 2 + 1, max(0, x - (size - 1) // 2) : x + size // 2 + 1] = (color or grey)(v)
    return png(canvas[::-1] if flip else canvas)


def save(spark: SparkSession, data: bytes, path: str) -> None:
    """Writes a file wherever Spark can."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def outline_pixels(df: DataFrame, width: int, height: int, xmin: float, ymin: float, xmax: float, ymax: float, st: str = "st", fill: bool = False) -> DataFrame:
    """(px, py, n): values whose envelope's border (or whole, with `fill`) lies in each pixel of an image."""
    v = F.col(st)
    at = lambda c, lo, hi, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c - lo) / (hi - lo) * n))).cast("int")
    inside = (v["xmin"] <= xmax) & (v["xmax"] >= xmin) & (v["ymin"] <= ymax) & (v["ymax"] >= ymin)
    a, b = at(v["xmin"], xmin, xmax, width), at(v["xmax"], xmin, xmax, width)
    c, d = F.lit(height - 1) - at(v["ymax"], ymin, ymax, height), F.lit(height - 1) - at(v["ymin"], ymin, ymax, height)
    rows = df.where(inside).select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    rows = rows.withColumn("px", F.explode(F.sequence("a", "b"))).withColumn("py", F.explode(F.sequence("c", "d")))
    edge = F.col("px").isin(F.col("a"), F.col("b")) | F.col("py").isin(F.col("c"), F.col("d"))
    return (rows if fill else rows.where(edge)).groupBy("px", "py").agg(F.count("*").alias("n"))


