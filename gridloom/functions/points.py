"""Points as structs of x and y, y pointing down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def translate(p: Column, v: Column) -> Column:
    return point(p["x"] + v["x"], p["y"] + v["y"])


def scale(p: Column, k: Column) -> Column:
    return point(p["x"] * k, p["y"] * k)


def negate(p: Column) -> Column:
    return point(-p["x"], -p["y"])


def subtract(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def divide(p: Column, k: Column) -> Column:
    """Of integers, truncated; null where ``k`` is 0."""
    part = lambda c: F.call_function("div", c.cast("long"), F.nullif(k.cast("long"), F.lit(0)))
    return point(part(p["x"]), part(p["y"]))


def is_zero(p: Column) -> Column:
    return (p["x"] == 0) & (p["y"] == 0)


def to_rounded_int(p: Column) -> Column:
    """To the nearest whole point, halves away from zero."""
    return point(to_int(F.round(p["x"])), to_int(F.round(p["y"])))


def to_floats(p: Column, kind: str = "double") -> Column:
    return point(p["x"].cast(kind), p["y"].cast(kind))


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def norm(p: Column) -> Column:
    return F.sqrt(dot(p, p).cast("double"))


def distance(p: Column, q: Column) -> Column:
    return norm(point(p["x"] - q["x"], p["y"] - q["y"]))


def normalised(p: Column) -> Column:
    """Of length 1; the zero vector stays."""
    n = F.nullif(norm(p), F.lit(0.0))
    return point(F.coalesce(p["x"] / n, F.lit(0.0)), F.coalesce(p["y"] / n, F.lit(0.0)))


def to_polar(p: Column) -> Column:
    return F.struct(F.atan2(p["y"], p["x"]).alias("a"), norm(p).alias("r"))


def from_polar(q: Column) -> Column:
    return point(q["r"] * F.cos(q["a"]), q["r"] * F.sin(q["a"]))


def rotate(p: Column, angle: Column, origin: Column | None = None) -> Column:
    o = point(F.lit(0), F.lit(0)) if origin is None else origin
    dx, dy = p["x"] - o["x"], p["y"] - o["y"]
    return point(dx * F.cos(angle) - dy * F.sin(angle) + o["x"], dx * F.sin(angle) + dy * F.cos(angle) + o["y"])


def rotate_quarter(p: Column, origin: Column, clockwise: bool) -> Column:
    """By 90 degrees as seen on screen."""
    dx, dy = p["x"] - origin["x"], p["y"] - origin["y"]
    return point(origin["x"] - dy, origin["y"] + dx) if clockwise else point(origin["x"] + dy, origin["y"] - dx)


def to_int(c: Column) -> Column:
    """Towards zero, held within 32 bits, NaN as 0."""
    held = F.greatest(F.least(c, F.lit(2147483647.0)), F.lit(-2147483648.0))
    return F.when(F.isnan(c), F.lit(0)).otherwise(held.cast("int"))


def line_intersection(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Of the lines through p1, p2 and p3, p4: struct x, y, mua, mub.

    Null for parallel lines. For coinciding lines the middle of p1 and p2, with null parameters.
    """
    tiny = lambda v: F.abs(v) < F.lit(1e-7)
    ax, ay, bx, by = p2["x"] - p1["x"], p2["y"] - p1["y"], p4["x"] - p3["x"], p4["y"] - p3["y"]
    across = by * ax - bx * ay
    along_a = bx * (p1["y"] - p3["y"]) - by * (p1["x"] - p3["x"])
    along_b = ax * (p1["y"] - p3["y"]) - ay * (p1["x"] - p3["x"])
    safe = F.when(~tiny(across), across)
    mua, mub = along_a / safe, along_b / safe
    void = F.lit(None).cast("double")
    struct = lambda x, y, a, b: F.struct(x.alias("x"), y.alias("y"), a.alias("mua"), b.alias("mub"))
    same = tiny(across) & tiny(along_a) & tiny(along_b)
    return F.when(same, struct((p1["x"] + p2["x"]) / 2, (p1["y"] + p2["y"]) / 2, void, void)).when(~tiny(across), struct(p1["x"] + mua * ax, p1["y"] + mua * ay, mua, mub))


#: How far beyond a segment's ends a crossing still belongs to it.
_NEAR = 1e-3


def crossing_outside(at: Column) -> Column:
    """Whether a crossing of two lines lies outside of either segment; coinciding lines count as inside."""
    off = lambda m: F.coalesce((m < -_NEAR) | (m > 1 + _NEAR), F.lit(False))
    return off(at["mua"]) | off(at["mub"])


def lines_coincide(at: Column) -> Column:
    return at.isNotNull() & at["mua"].isNull() & at["mub"].isNull()


def same_crossing(a: Column, b: Column) -> Column:
    """By their places along the lines; all crossings of coinciding lines are the same."""
    return (lines_coincide(a) & lines_coincide(b)) | F.coalesce((a["mua"] == b["mua"]) & (a["mub"] == b["mub"]), F.lit(False))
