"""Skeletons, thickness of differences, averages of shapes, weak joints, recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import bitmaps, shapes
from gridloom.operators.bitmaps import EIGHT, PIXEL
from gridloom.operators.paths import compound, per_object, reduce_closed
from gridloom.scratch import materialise

#: Directions of runs: the key that is constant along a run, and the place that grows. In this order ties are decided.
_DIRECTIONS = (("y", "x"), ("x", "y"), ("x + y", "x"), ("x - y", "x"))


def _spans(bits: DataFrame) -> DataFrame:
    """Adds s0..s3, the length of the run through a pixel in each direction, and c0..c3, whether it is its middle."""
    out = bits.select(PIXEL).distinct()
    for k, (key, place) in enumerate(_DIRECTIONS):
        along = Window.partitionBy("image_id", "__key").orderBy("__at")
        run = Window.partitionBy("image_id", "__key", "__run")
        out = out.withColumn("__key", F.expr(key)).withColumn("__at", F.expr(place)).withColumn("__run", F.col("__at") - F.row_number().over(along))
        out = out.withColumn(f"s{k}", F.count(F.lit(1)).over(run)).withColumn(f"c{k}", F.col("__at") == F.min("__at").over(run) + F.floor((F.col(f"s{k}") - 1) / 2)).drop("__key", "__at", "__run")
    return out


def skeleton(bits: DataFrame) -> DataFrame:
    """``image_id, x, y, span``: middles of runs that are shortest in their direction.

    Of equally short directions the first counts: along rows, columns, x + y, x - y. Middles on the boundary of
    thicker parts and those without a neighbour are dropped.
    """
    s, c = [F.col(f"s{k}") for k in range(4)], [F.col(f"c{k}") for k in range(4)]
    chosen = F.lit(False)
    for k in range(4):
        rule = c[k]
        for j in range(4):
            if j != k:
                rule = rule & ((s[k] < s[j]) if j < k else (s[k] <= s[j]))
        chosen = chosen | rule
    middles = _spans(bits).filter(chosen).withColumn("span", F.least(*s)).select(*PIXEL, "span")
    edge = bitmaps.boundary(bits)
    kept = middles.filter("span = 1").unionAll(middles.filter("span > 1").join(edge, PIXEL, "left_anti"))
    near = bitmaps.neighbours(kept, EIGHT).select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    return kept.join(near, PIXEL, "left_semi")


def skeleton_stats(bits: DataFrame) -> DataFrame:
    return skeleton(bits).groupBy("image_id").agg(F.avg("span").alias("mean"), F.count(F.lit(1)).alias("n"))


def significance(difference: DataFrame, areas: DataFrame, width: int) -> DataFrame:
    """``image_id, score``: how much the parts of a difference weigh against ``areas`` (image_id, area).

    Each connected part weighs its size by the mean width and the length of its skeleton by its boundary.
    Truncation is part of the measure. Images of area 0 get null.
    """
    parts = bitmaps.components(difference, False, width)
    objects = parts.select(F.struct("image_id", "component").alias("o"), "x", "y").select(F.col("o").alias("image_id"), "x", "y")
    sizes = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("size"))
    edges = bitmaps.boundary(objects).groupBy("image_id").agg(F.count(F.lit(1)).alias("edge"))
    stat = skeleton_stats(objects)
    weight = F.floor(F.lit(4 * 128 * 128).cast("decimal(38,0)") * F.col("size") * F.floor(F.coalesce("mean", F.lit(0.0))) * F.coalesce("n", F.lit(0)) / F.col("edge"))
    scored = sizes.join(edges, "image_id").join(stat, "image_id", "left").groupBy(F.col("image_id.image_id").alias("image_id")).agg(F.sum(weight).alias("w"))
    return areas.join(scored, "image_id", "left").select("image_id", F.floor(F.coalesce("w", F.lit(0)) / F.nullif(F.col("area") * width, F.lit(0))).cast("long").alias("score"))


def clustered_difference(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The significance of where two bitmaps differ, against the area of the first; null where that has no pixel."""
    areas = a.groupBy("image_id").agg(F.count(F.lit(1)).alias("area"))
    every = areas.join(b.select("image_id").distinct(), "image_id", "full").select("image_id", F.coalesce("area", F.lit(0)).alias("area"))
    return significance(bitmaps.difference(a, b), every, width)


_NEAR = ((0, -1), (1, 0), (0, 1), (-1, 0))


def parts_of(pixels: set) -> list[set]:
    """4-connected parts by first raster pixel."""
    left, out = set(pixels), []
    for seed in sorted(pixels, key=lambda p: (p[1], p[0])):
        if seed in left:
            left.discard(seed)
            part, todo = {seed}, [seed]
            while todo:
                x, y = todo.pop()
                new = {(x + dx, y + dy) for dx, dy in _NEAR} & left
                left -= new
                part |= new
                todo += new
            out.append(part)
    return out


def average_of(a: set, b: set) -> set | None:
    """The shape half way from what two share to what either has, measured in steps inside the latter.

    Null if the two sets have different numbers of parts.
    """
    inner, outer = a & b, a | b
    if len(parts_of(inner)) != len(parts_of(outer)):
        return None
    rings, seen, front = [], set(inner), set(inner)
    while front:
        front = {(x + dx, y + dy) for x, y in front for dx, dy in _NEAR} & (outer - seen)
        rings.append(front)
        seen |= front
    # the last, empty ring counts as a step
    steps = len(rings) // 2
    return inner.union(*(rings[:steps] if steps else rings))


def averages(a: DataFrame, b: DataFrame) -> DataFrame:
    """``image_id, x, y`` of the average of two bitmaps of each image; nothing where there is none."""
    both = a.select(*PIXEL, F.lit(0).alias("side")).unionAll(b.select(*PIXEL, F.lit(1).alias("side")))

    def work(rows):
        left, right = ({(x, y) for x, y, s in rows if s == side} for side in (0, 1))
        return sorted(average_of(left, right) or ())

    return per_object(both, "image_id", work, ["x", "y", "side"], "x long, y long")


def break_weak_joints(pixels: set, least: int = 5) -> list[set]:
    """Splits an object where two steps meet in a Z or an S, as long as every part keeps ``least`` pixels."""
    x0, x1 = min(x for x, _ in pixels), max(x for x, _ in pixels)
    y0, y1 = min(y for _, y in pixels), max(y for _, y in pixels)

    def joint():
        for y in range(y0, y1 - 1):
            for x in range(x0, x1):
                top, mid, low = (((x, y + d) in pixels, (x + 1, y + d) in pixels) for d in range(3))
                if all(mid) and top[0] != top[1] and low == top[::-1]:
                    if (x + 2, y + 1) in pixels:
                        return x + 1, y + 1
                    if (x - 1, y + 1) in pixels:
                        return x, y + 1
        return None

    cut = joint()
    parts = parts_of(pixels - {cut}) if cut else []
    if not parts or min(map(len, parts)) < least:
        return [pixels]
    return [q for p in parts for q in break_weak_joints(p, least)]


def broken(bits: DataFrame) -> DataFrame:
    """``object_id, part, size``: objects ``object_id, x, y`` split at weak joints."""
    return per_object(bits, "object_id", lambda rows: [(k, len(p)) for k, p in enumerate(break_weak_joints(set(rows)))], ["x", "y"], "part int, size int")


def looks_like(bits: DataFrame, frames: DataFrame, ideal: DataFrame, share: int, width: int) -> DataFrame:
    """``image_id, alike``: whether a bitmap differs from its ideal by thin parts only.

    ``frames`` are ``image_id, w, h``; the parts may weigh w * h / ``share`` together.
    """
    score = shapes.thin_difference(bits, ideal, width)
    return frames.join(score.hint("merge"), "image_id", "left").select("image_id", (F.coalesce("score", F.lit(0)) <= F.floor(F.col("w") * F.col("h") / share)).alias("alike"))


def is_ellipse(bits: DataFrame, frames: DataFrame, width: int) -> DataFrame:
    """``image_id, ellipse, circle``: by the ideal ellipse of the frame; small frames and set corners rule it out."""
    alike = looks_like(bits, frames, shapes.ellipses(frames), 2, width)
    corner = F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)
    corners = bits.join(frames.hint("merge"), "image_id").filter(corner & ((F.col("y") == 0) | (F.col("y") == F.col("h") - 1))).groupBy("image_id").agg(F.count(F.lit(1)).alias("corners"))
    fine = F.col("alike") & ((F.col("w") > 4) | (F.col("h") > 4)) & (F.coalesce("corners", F.lit(0)) <= 1)
    near = F.greatest("w", "h") - F.least("w", "h") <= F.floor(F.greatest("w", "h") / 4)
    return alike.join(frames.hint("merge"), "image_id").join(corners.hint("merge"), "image_id", "left").select("image_id", fine.alias("ellipse"), (fine & near).alias("circle"))


def is_isosceles(bits: DataFrame, frames: DataFrame, width: int) -> DataFrame:
    """``image_id, isosceles``: by the triangle from the frame's foot to the middle of its top."""
    w, h = F.col("w"), F.col("h")
    zero = F.lit(0).cast("long")
    ideal = shapes.triangles(frames.select("image_id", zero.alias("ax"), h.alias("ay"), F.floor(w / 2).alias("bx"), zero.alias("by"), w.alias("cx"), h.alias("cy"))).join(frames.hint("merge"), "image_id").filter((F.col("x") < w) & (F.col("y") < h))
    return looks_like(bits, frames, ideal.select(PIXEL), 3, width).join(frames.hint("merge"), "image_id").select("image_id", (F.col("alike") & ((w >= 3) | (h >= 3))).alias("isosceles"))


def quadrilateral_of(pixels: set, tolerance: float) -> list[tuple[int, int]] | None:
    """Corners of the outer outline reduced to its extreme points, as four pixels; null if the outline reduces to nothing.

    The fourth takes its height from the second: this is how the measure is defined.
    """
    path = reduce_closed(compound(pixels)[0], tolerance) if pixels else None
    if path is None:
        return None
    (x0, y0), (x1, y1), (x2, y2), (x3, _) = path[:4]
    return [(x0 - 1, y0), (x1 - 1, y1 - 1), (x2, y2 - 1), (x3, y1 - 1)]


def is_quadrilateral(bits: DataFrame, frames: DataFrame, width: int) -> DataFrame:
    """``image_id, quadrilateral``: by the two triangles between the extreme points; null where there are none.

    ``frames`` are ``image_id, w, h``; an outline that is too small to reduce, or no pixel at all, gives null.
    """

    def work(rows):
        corners = quadrilateral_of({(x, y) for x, y, _, _ in rows}, float(min(rows[0][2:])))
        return [tuple(v for p in corners for v in p)] if corners else []

    # stored, as it is read three times and outlines are followed in Python
    found = materialise(per_object(bits.join(frames.hint("merge"), "image_id"), "image_id", work, ["x", "y", "w", "h"], ", ".join(f"{c}{k} long" for k in range(4) for c in "xy")), "corners")
    corner = lambda *ks: [F.col(f"{c}{k}").alias(f"{n}{c}") for n, k in zip("abc", ks, strict=True) for c in "xy"]
    halves = found.select("image_id", *corner(0, 1, 2)).unionAll(found.select("image_id", *corner(0, 2, 3)))
    ideal = shapes.triangles(halves).join(frames.hint("merge"), "image_id").filter((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    alike = looks_like(bits, frames, ideal.select(PIXEL).distinct(), 6, width)
    known = found.select("image_id", F.lit(True).alias("known"))
    return alike.join(known.hint("merge"), "image_id", "left").select("image_id", F.when(F.col("known"), F.col("alike")).alias("quadrilateral"))
