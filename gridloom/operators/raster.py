"""Grey and colour images as tables of pixels: prefix sums, pyramids, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_sums(df: DataFrame, value: str = "v") -> DataFrame:
    """``image_id, x, y, s``: the sum of all values left of and above a pixel, itself included."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("in_row", F.sum(value).over(row)).select("image_id", "x", "y", F.sum("in_row").over(column).alias("s"))


def region_sums(sums: DataFrame, regions: DataFrame) -> DataFrame:
    """``region_id, image_id, total, mean`` of regions x0, y0, x1, y1, corners included.

    Four signed lookups; one outside the image counts as 0. Regions that reach past the image give null.
    """
    corner = lambda dx, dy, sign: F.struct((F.col("x1") if dx else F.col("x0") - 1).alias("x"), (F.col("y1") if dy else F.col("y0") - 1).alias("y"), F.lit(sign).alias("sign"))
    looked = regions.withColumn("c", F.explode(F.array(corner(1, 1, 1), corner(0, 1, -1), corner(1, 0, -1), corner(0, 0, 1)))).select("region_id", "image_id", "x0", "y0", "x1", "y1", "c.x", "c.y", "c.sign")
    hit = looked.join(sums, ["image_id", "x", "y"], "left")
    size = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    out = hit.groupBy("region_id", "image_id", "x0", "y0", "x1", "y1").agg(F.sum(F.coalesce("s", F.lit(0)) * F.col("sign")).alias("total"), F.max(F.when(F.col("sign") == 1, F.col("s"))).alias("inside"))
    total = F.when(F.col("inside").isNotNull(), F.col("total"))
    return out.select("region_id", "image_id", total.alias("total"), (total / size).alias("mean"))


def pyramid(df: DataFrame, levels: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """``image_id, level, x, y`` and channels; level 0 is the image, each next one the truncated mean of four pixels."""
    level = df.select("image_id", F.lit(0).alias("level"), "x", "y", *channels)
    out = level
    for k in range(1, levels + 1):
        level = level.groupBy("image_id", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(*(F.floor(F.sum(c) / 4).alias(c) for c in channels)).select("image_id", F.lit(k).alias("level"), "x", "y", *channels)
        out = out.unionAll(level)
    return out


def spiral(size: int) -> list[tuple[int, int]]:
    """The cells of a square in clockwise spiral order from the left upper cell of the centre."""
    if size == 1:
        return [(0, 0)]
    x = y = size // 2 - 1
    out, arm = [], 0
    while len(out) < size * size:
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[arm % 4]
        for _ in range(arm // 2 + 1):
            out.append((x, y))
            x, y = x + dx, y + dy
        arm += 1
    return out[: size * size]


def spiral_order(spark, sizes: list[int]) -> DataFrame:
    """``size, x, y, place``: a fixed table, at most four thirds of the largest square."""
    rows = [(s, x, y, k) for s in sizes for k, (x, y) in enumerate(spiral(s))]
    return spark.createDataFrame(rows, "size int, x long, y long, place int")


def embed(df: DataFrame, side: int = 128) -> DataFrame:
    """``image_id, values``: all levels of the pyramid, coarse to fine, pixels in spiral order, r, g, b."""
    levels = side.bit_length() - 1
    order = spiral_order(df.sparkSession, [side >> k for k in range(levels + 1)]).withColumn("level", (F.lit(levels) - F.log2("size")).cast("int"))
    placed = pyramid(df, levels).join(order, ["level", "x", "y"])
    return placed.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("level"), "place", "r", "g", "b"))).alias("p")).select("image_id", F.flatten(F.transform("p", lambda p: F.array(p["r"], p["g"], p["b"]))).alias("values"))


def unembed(df: DataFrame, side: int = 128) -> DataFrame:
    """The image back from its embedding."""
    n = side * side
    pixels = df.select("image_id", F.posexplode(F.slice("values", F.size("values") - 3 * n + 1, F.lit(3 * n))).alias("k", "v"))
    wide = pixels.groupBy("image_id", F.floor(F.col("k") / 3).cast("int").alias("place")).agg(*(F.max(F.when(F.col("k") % 3 == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")))
    return wide.join(spiral_order(df.sparkSession, [side]), "place").select("image_id", "x", "y", "r", "g", "b")


def sample_bilinear(images: DataFrame, points: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """``point_id, image_id`` and channels at float32 points px, py, truncated; points outside are left out."""
    fine = points.filter((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") <= width - 1) & (F.col("py") <= height - 1))
    one = F.lit(1.0).cast("float")
    fx, fy = F.col("px") - F.floor("px").cast("float"), F.col("py") - F.floor("py").cast("float")
    corner = lambda cx, cy, w, k: F.struct(cx("px").cast("long").alias("x"), cy("py").cast("long").alias("y"), w.alias("w"), F.lit(k).alias("k"))
    four = F.array(corner(F.floor, F.floor, (one - fx) * (one - fy), 0), corner(F.ceil, F.floor, fx * (one - fy), 1), corner(F.floor, F.ceil, (one - fx) * fy, 2), corner(F.ceil, F.ceil, fx * fy, 3))
    looked = fine.select("point_id", "image_id", F.explode(four).alias("c")).select("point_id", "image_id", "c.x", "c.y", "c.w", "c.k").join(images, ["image_id", "x", "y"])
    part = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c).cast("float") * F.col("w")))
    return looked.groupBy("point_id", "image_id").agg(*(F.floor(part(c, 0) + part(c, 1) + part(c, 2) + part(c, 3)).alias(c) for c in channels))


def threshold(images: DataFrame, predicate: Column) -> DataFrame:
    """The bitmap of the pixels that satisfy a predicate."""
    return images.filter(predicate).select("image_id", "x", "y")
