"""Shapes drawn and told apart: discs, ellipses, lines, triangles; their layered signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import bitmaps
from gridloom.operators.raster import spiral, spiral_order


def _cells(df: DataFrame, w: Column, h: Column) -> DataFrame:
    """All pixels of frames. Few bytes of frames become many pixels: frames are dealt out to all tasks before they do."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    dealt = df.filter((w > 0) & (h > 0)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    return dealt.withColumn("x", upto(w)).withColumn("y", upto(h))


def discs(df: DataFrame) -> DataFrame:
    """Pixels of the disc in a frame w x h for each row of ``image_id, w, h``."""
    d = F.least("w", "h")
    r = F.floor(d / 2)
    dx, dy = F.col("x") - F.floor(F.col("w") / 2), F.col("y") - F.floor(F.col("h") / 2)
    near = (F.round(F.sqrt((dx * dx + dy * dy).cast("double"))) < r + d % 2) & (F.abs(dx) <= r) & (F.abs(dy) <= r)
    return _cells(df, F.col("w"), F.col("h")).filter(near).select("image_id", "x", "y")


def ellipses(df: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.floor(F.col("w") / 2), F.col("y") - F.floor(F.col("h") / 2)
    half = lambda c: F.nullif(F.floor(F.col(c) * F.col(c) / 4), F.lit(0))
    return _cells(df, F.col("w"), F.col("h")).filter(F.sqrt(dx * dx / half("w") + dy * dy / half("h")) < 1).select("image_id", "x", "y")


def rounded_rects(df: DataFrame) -> DataFrame:
    """For rows of ``image_id, w, h, radius``."""
    r = F.least(F.greatest(F.col("radius").cast("double"), F.lit(0.0)), F.least("w", "h") / 2.0)
    away = lambda c, n: (F.col(c) + 0.5) - F.least(F.greatest(F.col(c) + F.lit(0.5), r), F.col(n) - r)
    dx, dy = away("x", "w"), away("y", "h")
    return _cells(df, F.col("w"), F.col("h")).filter(dx * dx + dy * dy <= r * r).select("image_id", "x", "y")


def lines(df: DataFrame) -> DataFrame:
    """``line_id, k, x, y``: the points of straight lines x0, y0 to x1, y1, in order, without accumulating errors.

    Along the longer axis one step at a time; across it the nearest pixel, halves away from the start.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    across = lambda d: F.coalesce(F.floor((2 * F.col("k") * F.abs(d) + n) / F.nullif(2 * n, F.lit(0))), F.lit(0)) * F.signum(d.cast("double")).cast("long")
    return df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))).select("line_id", "k", (F.col("x0") + across(dx)).alias("x"), (F.col("y0") + across(dy)).alias("y"))


def triangles(df: DataFrame) -> DataFrame:
    """``image_id, x, y``: filled triangles ax, ay, bx, by, cx, cy; each row of pixels from edge to edge."""
    edge = lambda p, q: F.struct(*(F.col(f"{s}{c}").alias(f"{c}{i}") for i, s in ((0, p), (1, q)) for c in "xy"))
    edges = df.select(F.col("image_id").alias("line_id"), F.explode(F.array(edge("b", "c"), edge("a", "c"), edge("a", "b"))).alias("e")).select("line_id", "e.*")
    rows = lines(edges).groupBy("line_id", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return rows.select(F.col("line_id").alias("image_id"), F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def code_layers(bits: DataFrame, side: int) -> DataFrame:
    """``image_id, layer, place, value``: set pixels of each cell of a 2^layer grid, in spiral order.

    Counts above half a cell are lowered by one, so that a cell's value fits its bits.
    """
    layers = side.bit_length() - 1
    images = bits.select("image_id").distinct()
    order = spiral_order(bits.sparkSession, [1 << k for k in range(layers + 1)]).withColumn("layer", F.log2("size").cast("int"))
    # every image has every cell; the cells are a table of fixed size
    cells = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).join(F.broadcast(order), "layer")
    moved = bits.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    cell = F.expr(f"shiftright({side}, layer)")
    counted = moved.groupBy("image_id", "layer", F.floor(F.col("x") / cell).alias("x"), F.floor(F.col("y") / cell).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    half = F.expr(f"greatest(shiftright({side}, layer) * shiftright({side}, layer) div 2, 1)")
    n = F.coalesce("n", F.lit(0))
    return cells.join(counted.hint("merge"), ["image_id", "layer", "x", "y"], "left").select("image_id", "layer", "place", (n - F.when(n > half, F.lit(1)).otherwise(F.lit(0))).alias("value"))


def code_bits(layers: DataFrame, side: int) -> DataFrame:
    """``image_id, bits``: coarse to fine, of each layer the first bits of all its values, then the second.

    The next layer says what lower bits would, so two are enough, and one for the first layer.
    """
    wide = F.greatest(F.lit(1), F.lit(2 * (side.bit_length() - 1)) - 2 * F.col("layer"))
    used = F.least(wide, F.when(F.col("layer") == 0, F.lit(1)).otherwise(F.lit(2)))
    bit = layers.withColumn("offset", F.explode(F.sequence(F.lit(0), (used - 1).cast("int")))).withColumn("bit", F.expr(f"shiftright(value, cast(greatest(1, {2 * (side.bit_length() - 1)} - 2 * layer) - 1 - offset as int)) & 1"))
    ordered = F.array_sort(F.collect_list(F.struct("layer", "offset", "place", "bit")))
    return bit.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda b: b["bit"].cast("string")), "").alias("bits"))


def codes(bits: DataFrame, side: int) -> DataFrame:
    """``image_id, code``: ``code_bits`` of ``code_layers``, made image by image without a table of cells.

    Pixels of an image are gathered in one row, a number each; nothing is broadcast.
    """
    layers = side.bit_length() - 1
    schema = T.StructType([bits.schema["image_id"], T.StructField("code", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [np.array([y * (1 << k) + x for x, y in spiral(1 << k)]) for k in range(layers + 1)]
        for batch in batches:
            at = batch.column(1)
            ends, flat, texts = at.offsets.to_numpy(), at.values.to_numpy(), []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                pixels = np.bincount(flat[s:e], minlength=side * side).reshape(side, side)
                planes = []
                for k, place in enumerate(places):
                    cell, wide = side >> k, max(1, 2 * (layers - k))
                    n = pixels.reshape(1 << k, cell, 1 << k, cell).sum((1, 3)).ravel()[place]
                    n -= n > max(cell * cell // 2, 1)
                    planes += [(n >> (wide - 1 - j)) & 1 for j in range(1 if k == 0 else min(wide, 2))]
                texts.append((np.concatenate(planes) + 48).astype(np.uint8).tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["image_id", "code"])

    inside = F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1)
    rows = bits.groupBy("image_id").agg(F.collect_list(F.when(inside, F.col("y") * side + F.col("x")).cast("int")).alias("at"))
    return rows.mapInArrow(work, schema)


def hex_text(bits: Column, trim: bool = False) -> Column:
    """Bits in bytes padded with zeros, as capital hex digits; half a byte that holds padding alone is left out.

    ``trim`` leaves out the last byte if it is not full, so that codes of a shape at two sizes share a prefix.
    """
    n = F.length(bits)
    full = F.rpad(bits, (F.ceil(n / 8) * 8).cast("int"), "0")
    # cut once into numbers of 12 digits, as each look into a long text reads it from its start
    digits = F.array_join(F.transform(F.regexp_extract_all(full, F.lit("[01]{1,48}"), F.lit(0)), lambda part: F.lpad(F.conv(part, 2, 16), (F.length(part) / 4).cast("int"), "0")), "")
    spare = F.when((n % 8 > 0) & F.lit(trim), 2).when((n % 8).between(1, 4) & ~F.lit(trim), 1).otherwise(0)
    return F.substring(digits, F.lit(1), F.greatest(F.length(digits) - spare, F.lit(1)))


#: The weight of a mismatch in layers of 1, 4, 16, ... bits, as shifts, and of the tail of two short codes.
LAYER_SHIFTS = (8, 8, 8, 8, 8, 6, 4, 2, 0)
TAIL_SHIFTS = ((0, 8), (1, 8), (3, 8), (5, 8), (7, 8), (7, 6), (7, 4), (7, 2), (7, 0))


def code_length(area: int) -> int:
    """Bits of the code of a square of ``area`` pixels: a bit per pixel and two planes, or one, of each coarser grid."""
    return area + area // 4 + (code_length(area // 4) if area > 4 else 0)


def layer_places(k: int) -> tuple[int, int]:
    """Where layer ``k`` ends in codes that reach it, and its bits: the last plane of a code of 4^k pixels."""
    return code_length(1 << 2 * k), 1 << 2 * k


def code_size(length: Column) -> Column:
    """Side of the square that a code of this length is of."""
    return F.pow(F.lit(2), F.floor(F.floor(F.log2(length.cast("double"))) / 2)).cast("int")


def pack_code(bits: Column, second: bool = False, layers: int = len(LAYER_SHIFTS)) -> Column:
    """A code made ready for ``packed_distance``: struct of its length and, for each layer, its bits as numbers of up to 48.

    Missing bits are filled from a pattern that differs by side, every fourth being set: a code is packed for one side.
    """
    fill = "0100" if second else "1000"
    whole = code_length(1 << 2 * (layers - 1))
    full = F.concat(bits, F.substring(F.lit(fill * (whole // 4 + 1)), F.length(bits) + 1, F.lit(whole)))

    def numbers(k: int) -> Column:
        end, size = layer_places(k)
        step = min(size, 48)
        return F.transform(F.sequence(F.lit(end - size + 1), F.lit(end), F.lit(step)), lambda at: F.conv(F.substring(full, at, F.least(F.lit(step), F.lit(end + 1) - at)), 2, 10).cast("long"))

    return F.struct(F.length(bits).alias("length"), *(numbers(k).alias(f"l{k}") for k in range(layers)))


def packed_distance(a: Column, b: Column, layers: int = len(LAYER_SHIFTS)) -> Column:
    """Weighted mismatches of two packed codes, layer by layer; ``b`` is packed for the second side.

    A layer counts all its bits but one at most. Where both codes end, the rest weighs a fixed amount and layers end.
    """
    total, ended = F.lit(0).cast("long"), F.lit(False)
    for k, shift in enumerate(LAYER_SHIFTS):
        end, size = layer_places(k)
        short = (a["length"] <= end - size) & (b["length"] <= end - size)
        tail = sum((1 << p) << s for p, s in TAIL_SHIFTS[k:])
        here = F.lit(0).cast("long")
        if k < layers:
            apart = F.aggregate(F.zip_with(a[f"l{k}"], b[f"l{k}"], lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
            here = F.least(apart, F.lit(max(size - 1, 1)).cast("long")) * (1 << shift)
        total = total + F.when(ended, F.lit(0)).when(short, F.lit(tail)).otherwise(here)
        ended = ended | short
    return total


def code_distance(a: Column, b: Column, layers: int = len(LAYER_SHIFTS)) -> Column:
    """``packed_distance`` of two bit texts. ``layers``: those that the longer code reaches, or more."""
    return packed_distance(pack_code(a, False, layers), pack_code(b, True, layers), layers)


def nearest_codes(queries: DataFrame, codes: DataFrame, k: int, side: int, blocks: int = 16) -> DataFrame:
    """``a, rank, b, distance``: for each row of ``queries`` the ``k`` nearest of ``codes`` with another id (``image_id, code``),
    ties to the smaller id. Codes are packed once; each block of codes meets all queries. ``side`` bounds the images."""
    from pyspark.sql.window import Window

    layers = side.bit_length()
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = queries.select(F.col("image_id").alias("a"), pack_code(F.col("code"), False, layers).alias("pa")).withColumn("block", every)
    b = codes.select(F.col("image_id").alias("b"), pack_code(F.col("code"), True, layers).alias("pb"), F.pmod(F.xxhash64("image_id"), F.lit(blocks)).cast("int").alias("block"))
    pairs = a.join(b, "block").filter("a <> b").select("a", "b", packed_distance(F.col("pa"), F.col("pb"), layers).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).filter(F.col("rank") <= k).select("a", "rank", "b", "distance")


def hex_bits(text: Column) -> Column:
    """The bits of a code written in hex; null for lengths that no code of more than one bit has.

    A missing half byte is 0; a single byte 00 or 80 is a code of one bit.
    """
    full = F.concat(text, F.when(F.length(text) % 2 == 1, "0").otherwise(""))
    # digits become letters that no digit is, then four bits each; what is no digit counts as 0
    bits = F.translate(F.regexp_replace(full, "[^0-9A-Fa-f]", "0"), "0123456789ABCDEFabcdef", "ghijklmnopqrstuvqrstuv")
    for digit in range(16):
        bits = F.replace(bits, F.lit("ghijklmnopqrstuv"[digit]), F.lit(f"{digit:04b}"))
    known = {-(-code_length(1 << 2 * k) // 8) * 8: code_length(1 << 2 * k) for k in range(1, 9)}
    length = F.try_element_at(F.create_map(*(F.lit(v) for pair in known.items() for v in pair)), F.length(bits))
    return F.when(F.upper(full).isin("00", "80"), F.substring(bits, 1, 1)).otherwise(F.substring(bits, F.lit(1), length))


def decode(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """``image_id, x, y``: set pixels of the bitmaps that codes are of; the last plane holds them in spiral order."""
    sized = codes.select("image_id", F.col(code_col).alias("code"), code_size(F.length(code_col)).alias("size"))
    sizes = [r[0] for r in sized.select("size").distinct().collect()]  # a handful of powers of two
    last = F.substring("code", F.length("code") - F.col("size") * F.col("size") + 1, F.length("code"))
    placed = sized.select("image_id", "size", F.posexplode(F.split(last, "")).alias("place", "bit")).filter("bit = '1'")
    return placed.join(F.broadcast(spiral_order(codes.sparkSession, sizes)), ["size", "place"]).select("image_id", "x", "y")


#: A cubic that comes close to a quarter of the unit circle runs from (0, A) over (B, C) and (C, B) to (A, 0); as differences from 1.
ARC_A, ARC_B, ARC_C = 0.00005519, 0.44657314, 0.00126415


def arc(start: Column, corner: Column, end: Column) -> Column:
    """Four control points of the quarter circle from ``start`` to ``end`` that ``corner`` rounds off, structs of x and y.

    The legs are axis-parallel and of equal length; null for others.
    """
    u = {c: F.signum((corner[c] - start[c]).cast("double")) for c in "xy"}
    v = {c: F.signum((end[c] - corner[c]).cast("double")) for c in "xy"}
    r = F.abs(end["x"] - start["x"]).cast("double")
    place = lambda p, ku, kv: F.struct(*((p[c].cast("double") + r * (ku * u[c] + kv * v[c])).alias(c) for c in "xy"))
    points = F.array(place(start, 0.0, -ARC_A), place(corner, -ARC_B, ARC_C), place(corner, -ARC_C, ARC_B), place(end, ARC_A, 0.0))
    square = (F.abs(u["x"]) + F.abs(u["y"]) == 1) & (F.abs(v["x"]) + F.abs(v["y"]) == 1) & (u["x"] * v["x"] + u["y"] * v["y"] == 0) & (F.abs(end["x"] - start["x"]) == F.abs(end["y"] - start["y"]))
    return F.when(square, points)


def circle_spline(left: Column, top: Column, diameter: Column) -> Column:
    """Thirteen control points of a circle, clockwise from the middle of its top; of an odd diameter the even one below."""
    r = F.floor(diameter / 2)
    at = lambda i, j: F.struct((left + i * r).alias("x"), (top + j * r).alias("y"))
    quarters = [arc(at(*a), at(*b), at(*c)) for a, b, c in (((1, 0), (2, 0), (2, 1)), ((2, 1), (2, 2), (1, 2)), ((1, 2), (0, 2), (0, 1)), ((0, 1), (0, 0), (1, 0)))]
    return F.concat(quarters[0], *(F.slice(q, 2, 3) for q in quarters[1:]))


def thin_difference(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """``image_id, score``: how thick the parts are in which two shapes differ.

    Each connected part of the difference counts 1 + 3 * size - 2 * boundary, which is small for thin ones.
    """
    parts = bitmaps.components(bitmaps.difference(a, b), False, width)
    edge = bitmaps.boundary(parts.select("image_id", "x", "y")).withColumn("edge", F.lit(1))
    scored = parts.join(edge.hint("merge"), ["image_id", "x", "y"], "left").groupBy("image_id", "component").agg((1 + 3 * F.count(F.lit(1)) - 2 * F.count("edge")).alias("s"))
    return scored.groupBy("image_id").agg(F.sum("s").alias("score"))
