"""Integer rectangles as structs l, t, r, b; pixels lie in [l, r) x [t, b)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    """Four column expressions; every method is an expression."""

    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    @classmethod
    def of(cls, prefix: str = "") -> Rect:
        return cls(*(F.col(f"{prefix}{c}") for c in "ltrb"))

    @classmethod
    def from_size(cls, x: Column, y: Column, w: Column, h: Column) -> Rect:
        return cls(x, y, x + w, y + h)

    @property
    def width(self) -> Column:
        return self.r - self.l

    @property
    def height(self) -> Column:
        return self.b - self.t

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def is_empty(self) -> Column:
        """Neither width nor height; a line is not empty."""
        return (self.width == 0) & (self.height == 0)

    @property
    def centre_x(self) -> Column:
        return F.shiftright(self.l + self.r, 1)

    @property
    def centre_y(self) -> Column:
        return F.shiftright(self.t + self.b, 1)

    def squared_distance(self, o: Rect) -> Column:
        dx, dy = self.centre_x - o.centre_x, self.centre_y - o.centre_y
        return dx * dx + dy * dy

    @property
    def aspect_ratio(self) -> Column:
        """Longer by shorter side; infinite if one is 0, null if both are."""
        long, short = F.greatest(self.width, self.height), F.least(self.width, self.height)
        return F.when(short != 0, long / F.nullif(short, F.lit(0))).when(long != 0, F.lit(float("inf")))

    @property
    def aspect_ratio_doubled(self) -> Column:
        """Twice the ratio, truncated; null if a side is 0."""
        long, short = F.greatest(self.width, self.height), F.least(self.width, self.height)
        return F.floor(2 * long / F.nullif(short, F.lit(0)))

    def hit(self, o: Rect) -> Column:
        """Whether they share a point, borders included."""
        return (F.greatest(self.l, o.l) <= F.least(self.r, o.r)) & (F.greatest(self.t, o.t) <= F.least(self.b, o.b))

    def contains(self, o: Rect) -> Column:
        return (self.l <= o.l) & (self.t <= o.t) & (self.r >= o.r) & (self.b >= o.b)

    def intersects(self, o: Rect) -> Column:
        """They hit and neither contains the other."""
        return self.hit(o) & ~self.contains(o) & ~o.contains(self)

    def clip(self, o: Rect) -> Rect:
        return Rect(F.greatest(self.l, o.l), F.greatest(self.t, o.t), F.least(self.r, o.r), F.least(self.b, o.b))

    def squared(self) -> Rect:
        """The square around it, the spare pixels shared with the smaller half first."""
        side = F.greatest(self.width, self.height)
        l, t = self.l - F.shiftright(side - self.width, 1), self.t - F.shiftright(side - self.height, 1)  # noqa: E741
        return Rect(l, t, l + side, t + side)

    def translate(self, x: Column, y: Column) -> Rect:
        return Rect(self.l + x, self.t + y, self.r + x, self.b + y)

    def expand(self, x: Column, y: Column) -> Rect:
        return Rect(self.l - x, self.t - y, self.r + x, self.b + y)

    def on_boundary(self, x: Column, y: Column, tolerance: Column) -> Column:
        """On an edge's line, within the edge lengthened by the tolerance."""
        upright = ((x == self.l) | (x == self.r)) & y.between(self.t - tolerance, self.b + tolerance)
        level = ((y == self.t) | (y == self.b)) & x.between(self.l - tolerance, self.r + tolerance)
        return upright | level

    def inside(self, x: Column, y: Column) -> Column:
        return (x > self.l) & (x < self.r) & (y > self.t) & (y < self.b)

    def on_boundary_or_inside(self, x: Column, y: Column, tolerance: Column) -> Column:
        return self.on_boundary(x, y, tolerance) | self.inside(x, y)

    def corners(self) -> dict[str, tuple[Column, Column]]:
        return {"left_top": (self.l, self.t), "right_top": (self.r, self.t), "right_bottom": (self.r, self.b), "left_bottom": (self.l, self.b)}

    def to_whole(self) -> Rect:
        """The smallest rectangle of whole numbers around one of doubles."""
        return Rect(F.floor(self.l), F.floor(self.t), F.ceil(self.r), F.ceil(self.b))

    def add_point(self, x: Column, y: Column) -> Rect:
        return Rect(F.least(self.l, x), F.least(self.t, y), F.greatest(self.r, x), F.greatest(self.b, y))

    def merge(self, o: Rect) -> Rect:
        """Around both; a null rectangle is the empty one of doubles and changes nothing."""
        return Rect(F.least(self.l, o.l), F.least(self.t, o.t), F.greatest(self.r, o.r), F.greatest(self.b, o.b))

    def step_inside(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The neighbour of a boundary point inside."""
        move = lambda v, lo, hi: F.when(v == lo, v + 1).when(v == hi, v - 1).otherwise(v)
        return move(x, self.l, self.r), move(y, self.t, self.b)

    def step_outside(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The neighbour of a boundary point outside; from a corner diagonally."""
        move = lambda v, lo, hi: F.when(v == lo, v - 1).when(v == hi, v + 1).otherwise(v)
        return move(x, self.l, self.r), move(y, self.t, self.b)

    def boundary_walk(self, x: Column, y: Column, clockwise: bool = True) -> Column:
        """All boundary points from (x, y) on, as an array of structs; null for a point off the boundary.

        A perimeter parameter s runs clockwise from the left top corner; a walk is s, s + 1, ... around.
        """
        w, h = self.width, self.height
        length = 2 * (w + h)
        start = F.when(y == self.t, x - self.l).when(x == self.r, w + (y - self.t)).when(y == self.b, w + h + (self.r - x)).otherwise(2 * w + h + (self.b - y))

        def at(k: Column) -> Column:
            s = F.pmod(start + (k if clockwise else -k), length)
            px = F.when(s <= w, self.l + s).when(s <= w + h, self.r).when(s <= 2 * w + h, self.r - (s - w - h)).otherwise(self.l)
            py = F.when(s <= w, self.t).when(s <= w + h, self.t + (s - w)).when(s <= 2 * w + h, self.b).otherwise(self.b - (s - 2 * w - h))
            return F.struct(px.alias("x"), py.alias("y"))

        return F.when(self.on_boundary(x, y, F.lit(0)) & (length > 0), F.transform(F.sequence(F.lit(0).cast("long"), length - 1), at))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip((self.l, self.t, self.r, self.b), "ltrb", strict=True)]


def map_point(x: Column, y: Column, a: Rect, b: Rect) -> tuple[Column, Column]:
    """The point of ``b`` at the place that (x, y) has in ``a``, truncated; unchanged if either is empty."""

    def along(v, lo, size, to, to_size):
        whole = (v - lo) * to_size
        moved = F.when(whole < 0, -F.floor(-whole / F.nullif(size, F.lit(0)))).otherwise(F.floor(whole / F.nullif(size, F.lit(0))))
        return F.when(a.is_empty | b.is_empty, v).otherwise(to + moved)

    return along(x, a.l, a.width, b.l, b.width), along(y, a.t, a.height, b.t, b.height)


def map_rect(r: Rect, a: Rect, b: Rect) -> Rect:
    """Both corners by ``map_point``."""
    left, top = map_point(r.l, r.t, a, b)
    right, bottom = map_point(r.r, r.b, a, b)
    return Rect(left, top, right, bottom)
