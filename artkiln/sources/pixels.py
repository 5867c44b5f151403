"""Images decoded by Spark's own image source: as a long pixel table, or reduced strip by strip.

A strip is a run of whole pixel rows of one picture, about ``STRIP_BYTES``
long. Strips are spread over all tasks and each is reduced by array
operations, so a picture of any size costs some rows per strip instead of one
per pixel, and Spark merges them with plain sums and extremes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRIP = 64
STRIP_BYTES = 1 << 20


def explode_pixels(images: DataFrame) -> DataFrame:
    """``image`` structs -> ``image_id, x, y, r, g, b, a``.

    Rows of pixels are exploded first in strips, then spread, so one large
    picture is not opened out by one task.
    """
    i = F.col("image")
    d = images.select(
        F.regexp_extract(i["origin"], r"([^/]+)$", 1).alias("image_id"), i["width"].alias("_w"), i["nChannels"].alias("_c"), i["data"].alias("_d"),
        i["height"].alias("_h"))
    rows = d.select("image_id", "_w", "_c", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("_h") - 1), lambda y: F.substr(F.col("_d"), (y * F.col("_w") * F.col("_c") + 1).cast("int"), (F.col("_w") * F.col("_c")).cast("int"))
    )).alias("y", "_row"))
    px = rows.repartition("image_id", F.floor(F.col("y") / STRIP)).select("image_id", "y", "_c", "_row", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"))

    def channel(k):
        return F.conv(F.hex(F.substr("_row", F.col("x") * F.col("_c") + k + 1, F.lit(1))), 16, 10).cast("int")

    grey = F.col("_c") == 1
    return px.select(
        "image_id", "x", "y", F.when(grey, channel(0)).otherwise(channel(2)).alias("r"), F.when(grey, channel(0)).otherwise(channel(1)).alias("g"),
        channel(0).alias("b"), F.when(F.col("_c") == 4, channel(3)).otherwise(255).alias("a"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return explode_pixels(spark.read.format("image").option("dropInvalid", "true").load(path))


def strips(images: DataFrame, key: str = "image_id", strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """``image_id, w, h, c, y, data`` of each strip of pictures (``w, h, c, data``: blue, green, red, alpha bytes row by row)."""
    line = F.col("w") * F.col("c")
    rows = F.greatest(F.lit(1), F.floor(F.lit(strip_bytes) / line)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("h") - 1, rows), lambda y: F.struct(y.alias("y"), F.substr(F.col("data"), (y * line + 1).cast("int"), (rows * line).cast("int")).alias("data")))
    d = images.where((F.col("w") > 0) & (F.col("h") > 0)).select(F.col(key).alias("image_id"), "w", "h", "c", F.explode(cut).alias("_s"))
    return d.select("image_id", "w", "h", "c", F.col("_s.y").alias("y"), F.col("_s.data").alias("data")).repartition("image_id", "y")


def image_strips(spark: SparkSession, path: str) -> DataFrame:
    """Strips of the pictures of a folder."""
    i = F.col("image")
    d = spark.read.format("image").option("dropInvalid", "true").load(path)
    return strips(d.select(F.regexp_extract(i["origin"], r"([^/]+)$", 1).alias("image_id"), i["width"].alias("w"), i["height"].alias("h"), i["nChannels"].alias("c"), i["data"].alias("data")))


def _channels(data: bytes, w: int, c: int) -> list[np.ndarray]:
    """Red, green, blue and alpha of a strip, row by row, as numbers."""
    p = np.frombuffer(data, np.uint8).reshape(-1, w, c).astype(np.int64)
    full = np.full(p.shape[:2], 255, np.int64)
    return [p[..., 0]] * 3 + [full] if c == 1 else [p[..., 2], p[..., 1], p[..., 0], p[..., 3] if c == 4 else full]


def colour_counts(strips: DataFrame) -> DataFrame:
    """``image_id, r, g, b, a, n``: distinct colours of each picture with their pixels."""
    schema = pa.schema([("image_id", pa.string()), ("colour", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, w, c, data in zip(*(batch[k] for k in ("image_id", "w", "c", "data"))):
                r, g, b, a = _channels(data.as_py(), w.as_py(), c.as_py())
                found, times = np.unique(r << 24 | g << 16 | b << 8 | a, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), pa.array(found), pa.array(times, pa.int64())], schema=schema)

    d = strips.select(F.col("image_id").cast("string").alias("image_id"), "w", "c", "data").mapInArrow(run, "image_id string, colour long, n long")
    d = d.groupBy("image_id", "colour").agg(F.sum("n").alias("n"))
    return d.select("image_id", *[F.expr(f"cast(shiftright(colour, {at}) & 255 as int)").alias(c) for c, at in zip("rgba", (24, 16, 8, 0))], "n")


def strip_sums(strips: DataFrame, cols: int = 17, rows: int = 16, threshold: int = 8) -> DataFrame:
    """Per strip: ``w, h, n``, sums of channels, extent of pixels with alpha above ``threshold`` and grey sums of the cells of a grid."""
    cell = pa.list_(pa.struct([(k, pa.int64()) for k in ("gy", "gx", "grey", "n")]))
    numbers = ("w", "h", "n", "sum_r", "sum_g", "sum_b", "x0", "y0", "x1", "y1")
    schema = pa.schema([("image_id", pa.string()), *[(k, pa.int64()) for k in numbers], ("cells", cell)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                w, h, y = row["w"], row["h"], row["y"]
                r, g, b, a = _channels(row["data"], w, row["c"])
                grey = (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16
                at = ((np.arange(y, y + len(r)) * rows // h)[:, None] * cols + (np.arange(w) * cols // w)[None, :]).ravel()
                total, count = np.bincount(at, grey.ravel(), rows * cols), np.bincount(at, minlength=rows * cols)
                ys, xs = np.nonzero(a > threshold)
                seen = {"x0": int(xs.min()), "y0": int(ys.min()) + y, "x1": int(xs.max()), "y1": int(ys.max()) + y} if len(xs) else {}
                out.append({"image_id": row["image_id"], "w": w, "h": h, "n": r.size, "sum_r": int(r.sum()), "sum_g": int(g.sum()), "sum_b": int(b.sum()), **seen,
                            "cells": [{"gy": int(k) // cols, "gx": int(k) % cols, "grey": int(total[k]), "n": int(count[k])} for k in np.flatnonzero(count)]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    d = strips.select(F.col("image_id").cast("string").alias("image_id"), "w", "h", "c", "y", "data")
    return d.mapInArrow(run, "image_id string, " + ", ".join(f"{k} long" for k in numbers) + ", cells array<struct<gy: long, gx: long, grey: long, n: long>>")


def picture_sums(sums: DataFrame) -> DataFrame:
    """Sums and extents of whole pictures; extents are null where nothing is opaque."""
    return sums.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), *[F.sum(c).alias(c) for c in ("n", "sum_r", "sum_g", "sum_b")],
                                        F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y1") - F.min("y0") + 1).alias("height"))


def picture_cells(sums: DataFrame) -> DataFrame:
    """``image_id, gy, gx, grey, n`` of the strips, to be summed per cell."""
    return sums.select("image_id", F.explode("cells").alias("_c")).select("image_id", "_c.*")


def flatten_alpha(pixels: DataFrame, background=(255, 255, 255)) -> DataFrame:
    """Transparent pixels, or colours with their counts, over a plain background."""
    def mix(c, v):
        return F.bround((F.col(c) * F.col("a") + F.lit(v) * (F.lit(255) - F.col("a"))) / 255.0, 0).cast("int").alias(c)

    return pixels.select(*[mix(c, dict(zip("rgb", background))[c]) if c in "rgb" else F.lit(255).alias("a") if c == "a" else F.col(c) for c in pixels.columns])
