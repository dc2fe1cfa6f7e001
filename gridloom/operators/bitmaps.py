"""Bitmaps as tables of set pixels: image_id, x, y.

Spark takes a table of pixels to be as small as the frames that it was exploded from, and would broadcast it. Pixels are joined
with the hint "merge", so that none passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.components import connected_components
from gridloom.scratch import materialise

PIXEL = ["image_id", "x", "y"]
FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def from_text(df: DataFrame, text: str = "text", key: str = "image_id") -> DataFrame:
    """``*`` is a set pixel; rows are lines."""
    rows = df.select(F.col(key).alias("image_id"), F.posexplode(F.split(text, "\n")).alias("y", "line"))
    return rows.select("image_id", "y", F.posexplode(F.split("line", "")).alias("x", "c")).filter(F.col("c") == "*").select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def to_text(bits: DataFrame, width: int, height: int) -> DataFrame:
    """``image_id, text``: ``*`` and ``-``, each row closed by a line feed."""
    rows = bits.groupBy("image_id", "y").agg(F.collect_set("x").alias("xs"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda x: F.when(F.array_contains("xs", x), "*").otherwise("-")), "")
    lines = rows.select("image_id", "y", line.alias("line")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"))
    blank = "-" * width
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")), lambda y: F.concat(F.coalesce(F.try_element_at("lines", y), F.lit(blank)), F.lit("\n"))), "")
    return lines.select("image_id", text.alias("text"))


def grid(images: DataFrame, width: int, height: int) -> DataFrame:
    """All pixels of each image."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return images.select("image_id").distinct().withColumn("x", axis(width)).withColumn("y", axis(height))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(PIXEL).union(b.select(PIXEL)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(PIXEL).intersect(b.select(PIXEL))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels set in one of the two."""
    both = a.select(*PIXEL, F.lit(1).alias("side")).union(b.select(*PIXEL, F.lit(2).alias("side"))).distinct()
    return both.groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(PIXEL)


def negative(bits: DataFrame, width: int, height: int) -> DataFrame:
    """Unset pixels within the frame; there are no padding bits."""
    return grid(bits, width, height).join(bits.select(PIXEL), PIXEL, "left_anti")


def operation(a: DataFrame, b: DataFrame, rule: tuple[bool, bool, bool, bool], frame: DataFrame | None = None) -> DataFrame:
    """Any function of two pixels: ``rule`` says what becomes of pixels set in neither, in ``a`` alone, in ``b`` alone, in both.

    Where pixels set in neither are to be set, ``frame`` names all pixels.
    """
    if rule[0] and frame is None:
        raise ValueError("a rule that sets pixels which neither side has needs the frame")
    both = a.select(*PIXEL, F.lit(1).alias("side")).union(b.select(*PIXEL, F.lit(2).alias("side"))).distinct()
    if frame is not None:
        both = both.union(frame.select(*PIXEL, F.lit(0).alias("side")))
    held = both.groupBy(*PIXEL).agg(F.sum("side").alias("sides"))
    return held.filter(F.col("sides").isin([k for k, on in enumerate(rule) if on])).select(PIXEL)


def boundary_list(bits: DataFrame, transpose: bool = False) -> DataFrame:
    """``image_id, k, x, y``: boundary pixels in raster order, or column by column."""
    by = Window.partitionBy("image_id").orderBy(*(("x", "y") if transpose else ("y", "x")))
    return boundary(bits).select("image_id", (F.row_number().over(by) - 1).alias("k"), "x", "y")


def boundary_summary(bits: DataFrame) -> DataFrame:
    """``image_id, x, y, n``: the first boundary pixel in raster order, and how many there are."""
    found = boundary(bits).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.select("image_id", "first.x", "first.y", "n")


def to_colors(bits: DataFrame, width: int, height: int) -> DataFrame:
    """``image_id, x, y, r, g, b, a``: set pixels black, others white."""
    value = lambda c: F.when(F.col("on").isNull(), F.lit(255)).otherwise(F.lit(0)).cast("long").alias(c)
    return grid(bits, width, height).join(bits.select(*PIXEL, F.lit(1).alias("on")), PIXEL, "left").select(*PIXEL, *map(value, "rgb"), F.lit(255).cast("long").alias("a"))


def resample_into(target: DataFrame, source: DataFrame, rect: tuple[int, int, int, int], into: tuple[int, int, int, int], overlay: bool) -> DataFrame:
    """``target`` with the pixels of ``source``'s ``rect`` stretched over ``into``: added, or in place of what is there."""
    l, t, r, b = into  # noqa: E741
    drawn = offset(resample(source, rect, r - l, b - t), l, t)
    rest = target if overlay else target.filter(~(F.col("x").between(l, r - 1) & F.col("y").between(t, b - 1)))
    return union(rest, drawn)


def hamming(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


def bounding_rect(bits: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return bits.groupBy(*keys).agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"), F.count(F.lit(1)).alias("area"))


def neighbours(bits: DataFrame, offsets=FOUR) -> DataFrame:
    """A row for each set pixel and each place beside it."""
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))
    return bits.select(*PIXEL, F.explode(moves).alias("m")).select(*PIXEL, (F.col("x") + F.col("m.dx")).alias("nx"), (F.col("y") + F.col("m.dy")).alias("ny"))


def boundary(bits: DataFrame) -> DataFrame:
    """Set pixels with an unset or outside neighbour.

    Windows over rows and columns look at both sides, so the pixels are shuffled twice and never joined.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    near = lambda f, w, c, d: F.coalesce(f(c).over(w) == F.col(c) + d, F.lit(False))
    inner = near(F.lead, row, "x", 1) & near(F.lag, row, "x", -1) & near(F.lead, column, "y", 1) & near(F.lag, column, "y", -1)
    return bits.select(PIXEL).withColumn("inner", inner).filter(~F.col("inner")).select(PIXEL)


def components(bits: DataFrame, diagonal: bool, width: int) -> DataFrame:
    """Adds ``component``: the smallest raster index that a pixel is connected to.

    Runs of a row are the vertices, which leaves a fraction of the pixels; runs of neighbouring rows that touch are joined.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    run = materialise(bits.select(PIXEL).distinct().withColumn("start", F.col("x") - F.row_number().over(row)), "runs")
    runs = run.groupBy("image_id", "y", "start").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = materialise(runs.withColumn("id", F.struct("image_id", (F.col("y") * width + F.col("x0")).alias("at"))), "runs")
    reach = 1 if diagonal else 0
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("id").alias("b"))
    edges = runs.join(below.hint("merge"), ["image_id", "y"]).filter((F.col("u0") <= F.col("x1") + reach) & (F.col("u1") >= F.col("x0") - reach)).select(F.col("id").alias("a"), "b")
    # edges of an image of up to 4,096 rows lie together and are done in one task, without further rounds
    together = edges.repartition(F.col("a.image_id"), F.floor(F.col("a.at") / (4096 * width)))
    labels = connected_components(together)
    named = runs.join(labels.hint("merge"), "id", "left").select("image_id", "y", "start", F.coalesce("component", "id")["at"].alias("component"))
    return run.join(named.hint("merge"), ["image_id", "y", "start"]).select(*PIXEL, "component")


def crop(bits: DataFrame, l: int, t: int, r: int, b: int) -> DataFrame:  # noqa: E741
    return bits.filter(F.col("x").between(l, r - 1) & F.col("y").between(t, b - 1)).select("image_id", (F.col("x") - l).alias("x"), (F.col("y") - t).alias("y"))


def offset(bits: DataFrame, dx: Column | int, dy: Column | int) -> DataFrame:
    return bits.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def uncrop(bits: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Centred in a larger frame."""
    return offset(bits, (new_width - width) >> 1, (new_height - height) >> 1)


def paste(target: DataFrame, source: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    moved = offset(source, dx, dy).filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return union(target, moved)


def stroke(bits: DataFrame, size: int) -> DataFrame:
    """Dilated by a disc of diameter ``size``; the frame grows by that much."""
    half = size // 2
    disc = [(dx, dy) for dx in range(-half, half) for dy in range(-half, half) if int(math.sqrt(dx * dx + dy * dy)) < half]
    return neighbours(bits, disc).select("image_id", (F.col("nx") + half).alias("x"), (F.col("ny") + half).alias("y")).distinct()


def rotate(bits: DataFrame, width: int, height: int, angle: float) -> DataFrame:
    """By nearest pixels: each target pixel looks up where it came from."""
    s, c = math.sin(angle), math.cos(angle)
    away = lambda v: math.floor(abs(v) + 0.5)
    new_w, new_h = away(abs(c) * width + abs(s) * height), away(abs(s) * width + abs(c) * height)
    px, py = F.col("x") - new_w / 2, F.col("y") - new_h / 2
    sx, sy = F.round(px * c + py * s + width / 2).cast("long"), F.round(-px * s + py * c + height / 2).cast("long")
    looked = grid(bits, new_w, new_h).select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), sx.alias("x"), sy.alias("y"))
    return looked.join(bits.select(PIXEL), PIXEL, "left_semi").select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"))


def resample(bits: DataFrame, rect: tuple[int, int, int, int], new_width: int, new_height: int, square: bool = False) -> DataFrame:
    """The pixels of ``rect`` on a grid of the new size, nearest below; ``square`` pads to keep the shape."""
    l, t, r, b = rect  # noqa: E741
    w, h = r - l, b - t
    sw, sh = (max(w, h), max(w, h)) if square else (w, h)
    ox, oy = (sw - w) >> 1, (sh - h) >> 1
    place = lambda c, size, new, o, at: F.floor(F.col(c) * size / new) - o + at
    looked = grid(bits, new_width, new_height).select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), place("x", sw, new_width, ox, l).alias("x"), place("y", sh, new_height, oy, t).alias("y"))
    return looked.join(bits.select(PIXEL), PIXEL, "left_semi").select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"))


def sample_count(bits: DataFrame, l: int, t: int, r: int, b: int) -> DataFrame:  # noqa: E741
    """Set pixels in the rectangle; images without any are left out."""
    return crop(bits, l, t, r, b).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
