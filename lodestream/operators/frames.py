"""Conversion and scaling of video frames, by tiles.

A frame is cut into tiles of the output.  A strip of tiles takes the rows of the input that its weights reach, its borders included, so it
is scaled by itself and frames of any size are the work of many tasks; the tiles of a frame are put together by the
aggregate over it, or stay tiles.

Formats: ``bgra`` (four bytes a pixel), ``i420`` (planes of Y, U and V, the latter of half the width and height, rounded
up) and ``nv12`` (U and V by turns in one plane).  Colours are those of BT.601 in the limited range, in integers:
C = Y - 16, D = U - 128, E = V - 128, R = (298 C + 409 E + 128) >> 8, G = (298 C - 100 D - 208 E + 128) >> 8 and
B = (298 C + 516 D + 128) >> 8, clipped to a byte; a chroma sample belongs to its four pixels.

Scaling is separable and linear: an output pixel's centre is at (x + 1/2) * w / W - 1/2 in the input, and its weights are a triangle
as wide as max(1, w / W) on each side, divided by their sum over the pixels there are.  Rows come first, then columns, in double
precision; the result is rounded to the nearest byte, halves to even.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import status as S

TILE = 256
#: Limits of an output frame.
MAX_SIDE, MAX_PIXELS = 4096, 16_777_216
TILES = "source_id string, frame_index bigint, frame_status int, out_width int, out_height int, x int, y int, w int, h int, pixels binary"


def expected_bytes(width: int, height: int, form: str) -> int:
    half = -(-width // 2) * -(-height // 2)
    return {"bgra": 4 * width * height, "i420": width * height + 2 * half, "nv12": width * height + 2 * half}[form]


def to_bgra(data: bytes, width: int, height: int, form: str, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None) -> np.ndarray:
    """(h, w, 4) bytes of a rectangle of a frame; only what the rectangle needs is converted."""
    w, h = width if w is None else w, height if h is None else h
    b = np.frombuffer(data, np.uint8)
    if form == "bgra":
        return b.reshape(height, width, 4)[y : y + h, x : x + w]
    luma = b[: width * height].reshape(height, width)[y : y + h, x : x + w].astype(np.int32) - 16
    wide, high, rest = -(-width // 2), -(-height // 2), b[width * height :]
    u, v = (rest[: wide * high].reshape(high, wide), rest[wide * high :].reshape(high, wide)) if form == "i420" else (rest.reshape(high, wide, 2)[:, :, k] for k in (0, 1))
    rows, columns = np.arange(y, y + h) // 2, np.arange(x, x + w) // 2
    d, e = (p[np.ix_(rows, columns)].astype(np.int32) - 128 for p in (u, v))
    out = np.empty((h, w, 4), np.uint8)
    out[:, :, 0] = np.clip((298 * luma + 516 * d + 128) >> 8, 0, 255)
    out[:, :, 1] = np.clip((298 * luma - 100 * d - 208 * e + 128) >> 8, 0, 255)
    out[:, :, 2] = np.clip((298 * luma + 409 * e + 128) >> 8, 0, 255)
    out[:, :, 3] = 255
    return out


def span(first: int, n: int, old: int, new: int) -> tuple[int, int]:
    """The input places that output places first to first + n - 1 reach."""
    reach, scale = max(1.0, old / new), old / new
    low, high = (first + 0.5) * scale - 0.5 - reach, (first + n - 0.5) * scale - 0.5 + reach
    return max(0, math.floor(low)), min(old, math.ceil(high) + 1)


def weights(first: int, n: int, old: int, new: int) -> tuple[int, np.ndarray]:
    """(low, (n, places)): the weights of output places on input places from ``low`` on."""
    low, high = span(first, n, old, new)
    centre = (np.arange(first, first + n) + 0.5) * (old / new) - 0.5
    h = np.maximum(0.0, 1 - np.abs(np.arange(low, high)[None, :] - centre[:, None]) / max(1.0, old / new))
    return low, h / h.sum(axis=1, keepdims=True)


def scaled_tile(slab: bytes, top: int, rows: int, width: int, height: int, form: str, out_width: int, out_height: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    """(h, w, 4) bytes of a rectangle of the scaled frame, from the frame's rows ``top`` to ``top + rows - 1``."""
    left, across = weights(x, w, width, out_width)
    low, down = weights(y, h, height, out_height)
    part = to_bgra(slab, width, rows, form, left, low - top, across.shape[1], down.shape[1]).astype(np.float64)
    # the sums of a pixel are taken in the same order whatever the tile: place by place
    wide = np.zeros((part.shape[0], w, 4))
    for k in range(across.shape[1]):
        wide += across[None, :, k, None] * part[:, k, None, :]
    out = np.zeros((h, w, 4))
    for k in range(down.shape[1]):
        out += down[:, k, None, None] * wide[None, k]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def tiles(frames: DataFrame, out_width: int | None = None, out_height: int | None = None, form: str = "bgra", tile: int = TILE) -> DataFrame:
    """TILES of frames (source_id, frame_index, width, height, pixels), scaled to a size or not; frame_status INVALID and no pixels where a frame is not what it says.

    A strip of tiles is a row before it is computed, with the rows of the frame that its weights reach and no others, so a frame's
    strips may be on many tasks and its bytes are moved about once.
    """
    c = F.col
    cut = frames.select(c("source_id").cast("string"), c("frame_index").cast("bigint"), c("width").cast("int").alias("width"), c("height").cast("int").alias("height"), "pixels")
    wide, high = (F.lit(v).cast("int") if v else c(n) for v, n in ((out_width, "width"), (out_height, "height")))
    half = F.ceil(c("width") / 2).cast("bigint")
    size = c("width").cast("bigint") * c("height") * 4 if form == "bgra" else c("width").cast("bigint") * c("height") + 2 * half * F.ceil(c("height") / 2)
    fits = c("width").between(1, MAX_SIDE) & c("height").between(1, MAX_SIDE) & wide.between(1, MAX_SIDE) & high.between(1, MAX_SIDE) & (wide * high <= MAX_PIXELS) & (F.octet_length("pixels") == size)
    good = F.coalesce(fits, F.lit(False))
    strips = F.sequence(F.lit(0), F.when(good, high - 1).otherwise(F.lit(0)), F.lit(tile))
    rows = cut.withColumns({"good": good, "out_width": wide, "out_height": high}).withColumn("y", F.explode(strips))
    # the rows that ``span`` says, from an even one on, as rows of chroma belong to two
    scale = c("height") / c("out_height")
    reach = F.greatest(F.lit(1.0), scale)
    last = F.least(c("y") + tile, c("out_height"))
    top = F.greatest(F.lit(0), F.floor((c("y") + 0.5) * scale - 0.5 - reach)).cast("int")
    end = F.least(c("height"), F.ceil((last - 0.5) * scale - 0.5 + reach) + 1).cast("int")
    rows = rows.withColumns({"top": top - top % 2, "n": end - (top - top % 2)})
    piece = lambda at, n: F.substring("pixels", (at + 1).cast("int"), n.cast("int"))
    area, low, many = c("width") * c("height"), F.call_function("div", c("top"), F.lit(2)), F.ceil(c("n") / 2)
    if form == "bgra":
        slab = piece(c("top") * c("width") * 4, c("n") * c("width") * 4)
    elif form == "i420":
        planes = half * F.ceil(c("height") / 2)
        slab = F.concat(piece(c("top") * c("width"), c("n") * c("width")), piece(area + low * half, many * half), piece(area + planes + low * half, many * half))
    else:
        slab = F.concat(piece(c("top") * c("width"), c("n") * c("width")), piece(area + low * half * 2, many * half * 2))
    rows = rows.select("source_id", "frame_index", "width", "height", "good", "out_width", "out_height", "y", "top", "n", F.when(c("good"), slab).alias("slab"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.int32()] * 7, pa.binary()]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in TILES.split(", ")])

        for b in batches:
            found, held = [], 0
            names = ("source_id", "frame_index", "width", "height", "good", "out_width", "out_height", "y", "top", "n")
            for source, k, w0, h0, ok, w1, h1, y, top, n, body in zip(*(b.column(x).to_pylist() for x in names), b.column("slab"), strict=True):
                if not ok:
                    found.append((source, k, S.INVALID, w1, h1, 0, y, None, None, None))
                    continue
                h = min(tile, h1 - y)
                for x in range(0, w1, tile):
                    w = min(tile, w1 - x)
                    found.append((source, k, S.OK, w1, h1, x, y, w, h, scaled_tile(body.as_buffer(), top, n, w0, h0, form, w1, h1, x, y, w, h).tobytes()))
                    held += w * h * 4
                if held > 1 << 25:
                    yield batch(found)
                    found, held = [], 0
            yield batch(found)

    return rows.mapInArrow(run, TILES)


def assembled(parts: DataFrame) -> DataFrame:
    """(source_id, frame_index, frame_status, width, height, pixels): frames of their tiles; a frame is bounded by MAX_PIXELS.

    Rows of pixels are put in their order by an aggregate of binary pieces, a row of a tile each.
    """
    line = F.expr("transform(sequence(0, h - 1), k -> struct(y + k AS at, x, substring(pixels, k * w * 4 + 1, w * 4) AS part))")
    rows = parts.select("source_id", "frame_index", "frame_status", "out_width", "out_height", F.explode_outer(line).alias("r"))
    pieces = F.array_sort(F.collect_list("r"))
    whole = rows.groupBy("source_id", "frame_index", "frame_status", "out_width", "out_height").agg(pieces.alias("all"))
    pixels = F.when(F.size("all") > 0, F.unhex(F.array_join(F.transform("all", lambda r: F.hex(r["part"])), "")))
    return whole.select("source_id", "frame_index", "frame_status", F.col("out_width").alias("width"), F.col("out_height").alias("height"), pixels.alias("pixels"))
