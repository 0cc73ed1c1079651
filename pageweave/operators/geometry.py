"""Geometry over box and contour tables; contours are ``array<struct<x,y>>``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 1024


def retina_frame(regions: DataFrame) -> DataFrame:
    """``scale, ox, oy`` that fit a region into the retina, centred; a region without area gets (1, 0, 0)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ok = (w > 0) & (h > 0)
    s = F.least(F.lit(float(SIDE)) / F.nullif(w, F.lit(0)), F.lit(float(SIDE)) / F.nullif(h, F.lit(0)))
    pad = lambda n: F.floor((SIDE - (n * s).cast("int")) / 2).cast("int")
    return regions.withColumns({"scale": F.when(ok, s).otherwise(1.0), "ox": F.when(ok, pad(w)).otherwise(0), "oy": F.when(ok, pad(h)).otherwise(0)})


def to_retina(boxes: DataFrame) -> DataFrame:
    """Boxes with their frame's columns, cut toward zero."""
    return boxes.withColumns({c: (F.col(c) * F.col("scale") + F.col("o" + c[0])).cast("int") for c in ("x1", "y1", "x2", "y2")})


def contours_to_retina(contours: DataFrame, points: int | None = None) -> DataFrame:
    """Every point of ``contour`` in its frame's retina, cut toward zero as in ``to_retina``.

    Contours that all have so many ``points`` are written out point by point, which Spark compiles.
    """

    def point(p: Column) -> Column:
        return F.struct(*[(p[a] * F.col("scale") + F.col("o" + a)).cast("int").alias(a) for a in "xy"])

    if points is not None:
        return contours.withColumn("contour", F.array(*[point(F.col("contour")[k]) for k in range(points)]))
    return contours.withColumn("contour", F.transform("contour", point))


def to_source(dets: DataFrame) -> DataFrame:
    """Inverse of ``to_retina``, cut to the image."""
    back = {c: ((F.col(c) - F.col("o" + c[0])) / F.col("scale")).cast("int") for c in ("x1", "y1", "x2", "y2")}
    side = {"x": F.col("width"), "y": F.col("height")}
    return dets.withColumns({c: F.greatest(F.lit(0), F.least(v, side[c[0]] - (1 if c[1] == "1" else 0))) for c, v in back.items()})


def corners(x1, y1, x2, y2) -> Column:
    pts = ((x1, y1), (x2, y1), (x2, y2), (x1, y2))
    return F.array(*[F.struct(F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y")) for a, b in pts])


def dominant_angle(c: str) -> Column:
    """Angle in degrees of the longest edge, the closing one included, in [-90, 90); the first of equals; else 0."""
    return F.expr(
        f"""CASE WHEN size({c}) < 2 THEN 0D ELSE
        aggregate(sequence(0, size({c}) - 1), struct(-1D AS d, 0D AS dx, 0D AS dy), (a, i) ->
          CASE WHEN pow(get({c}, (i + 1) % size({c})).x - get({c}, i).x, 2) + pow(get({c}, (i + 1) % size({c})).y - get({c}, i).y, 2) > a.d
          THEN struct(pow(get({c}, (i + 1) % size({c})).x - get({c}, i).x, 2) + pow(get({c}, (i + 1) % size({c})).y - get({c}, i).y, 2) AS d,
                      cast(get({c}, (i + 1) % size({c})).x - get({c}, i).x AS double) AS dx, cast(get({c}, (i + 1) % size({c})).y - get({c}, i).y AS double) AS dy)
          ELSE a END,
          a -> pmod(degrees(atan2(a.dy, a.dx)) + 90, 180) - 90) END"""
    )


def tangents(c: str) -> Column:
    """Unit central differences, one-sided at the ends; (1, 0) where there is no direction."""
    return F.expr(
        f"""transform({c}, (p, i) -> transform(array(struct(
          cast(get({c}, least(i + 1, size({c}) - 1)).x - get({c}, greatest(i - 1, 0)).x AS double) AS dx,
          cast(get({c}, least(i + 1, size({c}) - 1)).y - get({c}, greatest(i - 1, 0)).y AS double) AS dy)),
          d -> CASE WHEN d.dx = 0 AND d.dy = 0 THEN struct(1D AS dx, 0D AS dy)
               ELSE struct(d.dx / sqrt(d.dx * d.dx + d.dy * d.dy) AS dx, d.dy / sqrt(d.dx * d.dx + d.dy * d.dy) AS dy) END)[0])"""
    )


def shoelace(c: str) -> Column:
    return F.expr(
        f"aggregate(sequence(0, size({c}) - 1), 0D, (a, i) -> a + get({c}, i).x * get({c}, (i + 1) % size({c})).y - get({c}, (i + 1) % size({c})).x * get({c}, i).y)"
    )


def normalise_winding(df: DataFrame, c: str = "contour") -> DataFrame:
    """Contours with a positive shoelace sum are reversed."""
    return df.withColumn(c, F.when((F.size(c) > 2) & (shoelace(c) > 0), F.reverse(c)).otherwise(F.col(c)))


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Columns that are computed once a row: a one-row generator keeps the optimiser from repeating them at each use."""
    made = df.withColumn("__made", F.explode(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))
    return made.withColumns({n: F.col(f"__made.{n}") for n in cols}).drop("__made")


def cascade_params(df: DataFrame, c: str = "contour") -> DataFrame:
    """Crop origin and size, angle (none below half a degree), rotation centre, scale and pads of a contour's retina."""
    ext = {f"{f}_{a}": F.expr(f"array_{f}(transform({c}, p -> p.{a}))") for f in ("min", "max") for a in "xy"}
    df = _once(df, px=ext["min_x"], py=ext["min_y"], cw=ext["max_x"] - ext["min_x"], chh=ext["max_y"] - ext["min_y"], angle=dominant_angle(c))
    df = df.withColumn("angle", F.when(F.abs("angle") < 0.5, 0.0).otherwise(F.col("angle")))
    cos, sin = F.abs(F.cos(F.radians("angle"))), F.abs(F.sin(F.radians("angle")))
    rw, rh = F.ceil(F.col("cw") * cos + F.col("chh") * sin - 1e-9), F.ceil(F.col("cw") * sin + F.col("chh") * cos - 1e-9)
    df = _once(df, rw=F.greatest(rw, F.lit(1)), rh=F.greatest(rh, F.lit(1)))
    s = F.least(F.lit(float(SIDE)) / F.col("rw"), F.lit(float(SIDE)) / F.col("rh"))
    df = df.withColumn("scale", s)
    return df.withColumns({"ox": F.floor((SIDE - (F.col("rw") * s).cast("int")) / 2), "oy": F.floor((SIDE - (F.col("rh") * s).cast("int")) / 2)})


def forward_contours(df: DataFrame, c: str = "contour") -> DataFrame:
    """Crop, rotate about the crop's centre, shift, scale and pad; coordinates cut toward zero."""
    x, y = "(p.x - px - cw / 2)", "(p.y - py - chh / 2)"
    a = "radians(angle)"
    return _once(df, **{c: F.expr(
        f"transform({c}, p -> struct(cast(({x} * cos({a}) + {y} * sin({a}) + rw / 2) * scale + ox AS int) AS x, cast((-{x} * sin({a}) + {y} * cos({a}) + rh / 2) * scale + oy AS int) AS y))"
    )})


def lift_contours(df: DataFrame, c: str = "contour") -> DataFrame:
    """Inverse of ``forward_contours``, rounded half to even."""
    u, v = "((p.x - ox) / scale - rw / 2)", "((p.y - oy) / scale - rh / 2)"
    a = "radians(angle)"
    return _once(df, **{c: F.expr(
        f"transform({c}, p -> struct(cast(bround({u} * cos({a}) - {v} * sin({a}) + cw / 2 + px) AS int) AS x, cast(bround({u} * sin({a}) + {v} * cos({a}) + chh / 2 + py) AS int) AS y))"
    )})


def globalise_contours(df: DataFrame, c: str = "contour") -> DataFrame:
    """Mask-local points moved to the box; the box's corners where the contour is empty."""
    moved = F.expr(f"transform({c}, p -> struct(cast(p.x + x1 AS int) AS x, cast(p.y + y1 AS int) AS y))")
    return df.withColumn(c, F.when(F.coalesce(F.size(c), F.lit(0)) > 0, moved).otherwise(corners("x1", "y1", "x2", "y2")))


def rotate_boxes(df: DataFrame, angle: float) -> DataFrame:
    """Bounding box of each box turned about its centre, cut toward zero, origin not below 0."""
    cos, sin = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rw, rh = w * cos + h * sin, w * sin + h * cos
    return df.withColumns(
        {"x1": F.greatest(F.lit(0), (cx - rw / 2).cast("int")), "y1": F.greatest(F.lit(0), (cy - rh / 2).cast("int")), "x2": (cx + rw / 2).cast("int"), "y2": (cy + rh / 2).cast("int")}
    )


def background_color(pixels: DataFrame, border: int = 10) -> DataFrame:
    """Median of each channel over border pixels of each image, cut to an integer; white where there is none."""
    edge = F.expr(f"x < {border} or y < {border} or x >= width - {border} or y >= height - {border}")
    return pixels.groupBy("image_id").agg(
        *[F.coalesce(F.percentile(F.when(edge, F.col(c)), F.lit(0.5)).cast("int"), F.lit(255)).alias(c) for c in "rgb"]
    )


def content_mask(pixels: DataFrame, background: DataFrame, least: int = 0) -> DataFrame:
    """Pixels any channel of which differs from the background by more than ``least``."""
    bg = background.select("image_id", *[F.col(c).alias("b" + c) for c in "rgb"])
    diff = F.greatest(*[F.abs(F.col(c) - F.col("b" + c)) for c in "rgb"])
    return pixels.join(bg, "image_id").filter(diff > least).drop("br", "bg", "bb")


def boxed_mask(pixels: DataFrame, background: DataFrame, boxes: DataFrame, least: int = 0, tile: int = 64) -> DataFrame:
    """Content pixels inside each of ``boxes(image_id, id, x1, y1, x2, y2)`` (right and lower edge outside), with its ``id``.

    An equi-join on image and tile; a pixel in several boxes is there for each.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile)))
    tiles = boxes.filter("x2 > x1 and y2 > y1").select("image_id", "id", *[F.col(c).alias("__" + c) for c in ("x1", "y1", "x2", "y2")])
    tiles = tiles.withColumn("__tx", span("__x1", "__x2")).withColumn("__ty", span("__y1", "__y2"))
    ink = content_mask(pixels, background, least).withColumns({"__tx": F.floor(F.col("x") / tile), "__ty": F.floor(F.col("y") / tile)})
    met = ink.join(tiles, ["image_id", "__tx", "__ty"]).filter("x >= __x1 and x < __x2 and y >= __y1 and y < __y2")
    return met.drop("__tx", "__ty", "__x1", "__y1", "__x2", "__y2")


def region_contours(pixels: DataFrame, epsilon: float = 2.0, most: int = 20, least: int = 4) -> DataFrame:
    """``region, contour``: hull of each region's pixels, simplified to at most ``most`` points, at least ``least``.

    Rows are reduced to their extreme pixels by Spark first; the hull of what is left is that of all pixels. A region is one
    row of its lines' extremes then, and Python takes many regions a call. Fewer than three pixels or a flat hull give an empty contour.
    """
    rows = pixels.groupBy("region", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    rows = rows.groupBy("region").agg(F.sum("n").alias("n"), F.collect_list("y").alias("y"), F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def trace(n: int, ys: list, los: list, his: list) -> list:
        pts = sorted({(int(x), int(y)) for y, lo, hi in zip(ys, los, his) for x in (lo, hi)})
        hull = _hull(pts) if n >= 3 else []
        if len(hull) < 3:
            return []
        eps, out = epsilon, hull
        while True:
            out = _simplify(hull, eps)
            if len(out) <= most or eps >= 100:
                break
            eps *= 1.5
        while len(out) < least:
            out = [q for a, b in zip(out, out[1:] + out[:1]) for q in (a, ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2))]
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1])) > 0:
            out = out[::-1]
        return [{"x": x, "y": y} for x, y in out]

    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trace(*r) for r in zip(*(b[c].to_pylist() for c in ("n", "y", "lo", "hi")), strict=True)]
            yield pa.RecordBatch.from_arrays([b["region"], pa.array(found, kind)], ["region", "contour"])

    return rows.mapInArrow(run, f"region {dict(pixels.dtypes)['region']}, contour array<struct<x:int,y:int>>")


def _hull(pts: list) -> list:
    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1]) if len(pts) > 2 else []


def _simplify(ring: list, eps: float) -> list:
    """Ramer-Douglas-Peucker on a closed ring, split at the point farthest from the first."""
    far = max(range(len(ring)), key=lambda k: math.dist(ring[0], ring[k]))

    def cut(line):
        (x1, y1), (x2, y2) = line[0], line[-1]
        length = math.hypot(x2 - x1, y2 - y1) or 1.0
        best, at = -1.0, 0
        for k in range(1, len(line) - 1):
            d = abs((x2 - x1) * (y1 - line[k][1]) - (x1 - line[k][0]) * (y2 - y1)) / length
            if d > best:
                best, at = d, k
        return cut(line[: at + 1])[:-1] + cut(line[at:]) if best > eps else [line[0], line[-1]]

    return cut(ring[: far + 1])[:-1] + cut(ring[far:] + ring[:1])[:-1]


def orientation_angle(dx: Column, dy: Column) -> Column:
    """Degrees that turn the direction (dx, dy) upwards."""
    return F.degrees(F.atan2(dx, -dy))


def reverse_levels(df: DataFrame, c: str = "contour", levels: str = "levels") -> DataFrame:
    """Contour points taken back through ``levels``, the deepest first, then rounded half to even.

    A level is ``struct<scale,ox,oy,crop_x,crop_y,angle,cx,cy>``: pad, scale and crop are undone, then its turn about
    (cx, cy). An empty list of levels only rounds.
    """
    x, y = "((q.x - l.ox) / l.scale + l.crop_x - l.cx)", "((q.y - l.oy) / l.scale + l.crop_y - l.cy)"
    a = "radians(-l.angle)"
    step = f"struct(cos({a}) * {x} + sin({a}) * {y} + l.cx AS x, -sin({a}) * {x} + cos({a}) * {y} + l.cy AS y)"
    start = "struct(cast(p.x AS double) AS x, cast(p.y AS double) AS y)"
    end = "q -> struct(cast(bround(q.x) AS int) AS x, cast(bround(q.y) AS int) AS y)"
    return df.withColumn(c, F.expr(f"transform({c}, p -> aggregate({levels}, {start}, (q, l) -> {step}, {end}))"))
