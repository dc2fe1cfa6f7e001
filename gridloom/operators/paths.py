"""Outlines and their simplification: sequential per object, so one object is one group of rows.

Each function takes and returns points as Python lists; ``per_object`` runs them on grouped tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

Point = tuple[float, float]

#: Steps by direction on pixel corners (up, right, down, left), and the two pixels on either side of each.
_STEPS = ((0, -1), (1, 0), (0, 1), (-1, 0))
_SIDES = (((-1, -1), (0, -1)), ((0, 0), (0, -1)), ((-1, 0), (0, 0)), ((-1, 0), (-1, -1)))


def trace(pixels: set[tuple[int, int]], clockwise: bool = True) -> list[tuple[int, int]]:
    """The outline along pixel corners from the raster-first pixel, straight runs as one, closed.

    At a corner the first direction is taken, up, right, down, left or the reverse, that parts a set from an unset pixel and
    does not lead back to the last two corners.
    """
    if not pixels:
        return []
    y, x = min((y, x) for x, y in pixels)
    start = at = before = earlier = (x, y)
    out, last = [start], None
    order = (0, 1, 2, 3) if clockwise else (3, 2, 1, 0)
    for _ in range(4 * len(pixels) + 4):
        for d in order:
            nxt = (at[0] + _STEPS[d][0], at[1] + _STEPS[d][1])
            (ax, ay), (bx, by) = _SIDES[d]
            if nxt not in (before, earlier) and ((at[0] + ax, at[1] + ay) in pixels) != ((at[0] + bx, at[1] + by) in pixels):
                break
        else:
            raise ValueError("the shape has no outline to follow")
        if last is not None and d != last:
            out.append(at)
            if at == start:
                return out
        earlier, before, at, last = before, at, nxt, d
    raise ValueError("the outline does not close; split diagonal contacts first")


def holes(pixels: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """The 4-connected parts of what is unset that do not reach the border, by first raster pixel."""
    x0, x1 = min(x for x, _ in pixels) - 1, max(x for x, _ in pixels) + 1
    y0, y1 = min(y for _, y in pixels) - 1, max(y for _, y in pixels) + 1
    free = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - pixels
    parts = []
    while free:
        seed = min(free, key=lambda p: (p[1], p[0]))
        free.discard(seed)
        part, todo = {seed}, [seed]
        while todo:
            x, y = todo.pop()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in free:
                    free.discard(q)
                    part.add(q)
                    todo.append(q)
        if (x0, y0) not in part:
            parts.append(part)
    return parts


def compound(pixels: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The outline of a 4-connected object without its holes, clockwise, then each hole's, the other way."""
    inner = holes(pixels)
    return [trace(pixels.union(*inner)), *(trace(h, False) for h in inner)]


def _area2(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def without_stairs(path: list[Point], clockwise: bool = True) -> list[Point]:
    """Drops corners beside a step of one pixel, but those that turn outwards; both ends stay."""
    n = len(path)
    length = lambda i, j: abs(path[i][0] - path[j][0]) + abs(path[i][1] - path[j][1])

    def stays(i: int) -> bool:
        if i in (0, n - 1) or 1 not in (length(i, i - 1), length(i, i + 1)):
            return True
        turn = _area2(path[i - 1], path[i], path[i + 1])
        return turn != 0 and (turn > 0) == clockwise

    return [p for i, p in enumerate(path) if stays(i)]


def _penalty(a: Point, b: Point, c: Point) -> float:
    """How far b lies off the line from a to c, times its share of the area; 0 where that is undefined."""
    ab, bc, ca = math.dist(a, b), math.dist(b, c), math.dist(c, a)
    half = (ab + bc + ca) / 2
    square = half * (half - ab) * (half - bc) * (half - ca)
    if square < 0 or ca == 0:
        return math.inf if ca == 0 and square > 0 else 0.0
    area = math.sqrt(square)
    return area * area / ca


def limit_penalties(path: list[Point], most: float = 1.0) -> list[Point]:
    """Greedily spans as many points as keep every skipped one's penalty below ``most``."""
    if not path:
        return []
    out, last = [path[0]], 0
    for i in range(2, len(path)):
        if i != last + 1 and max((_penalty(path[last], path[k], path[i]) for k in range(last + 1, i)), default=0.0) >= most:
            last = i - 1
            out.append(path[last])
    return [*out, path[-1]] if len(path) > 1 else out


def simplify(path: list[Point], clockwise: bool = True) -> list[Point]:
    return limit_penalties(without_stairs(path, clockwise))


def _thinned(points: list[Point], least: float) -> list[Point]:
    """Points farther than ``least`` (squared) from the last one kept; both ends stay."""
    out = [points[0]]
    for p in points[1:]:
        if (p[0] - out[-1][0]) ** 2 + (p[1] - out[-1][1]) ** 2 > least:
            out.append(p)
    return out if out[-1] == points[-1] else [*out, points[-1]]


def _off_segment(p: Point, a: Point, b: Point) -> float:
    """Squared distance to the nearest point of a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long, 0.0), 1.0) if long else 0.0
    near = b if t == 1.0 else (a[0] + dx * t, a[1] + dy * t)
    return (p[0] - near[0]) ** 2 + (p[1] - near[1]) ** 2


def douglas_peucker(points: list[Point], squared: float) -> list[Point]:
    """Ramer-Douglas-Peucker with an explicit stack; of equally distant points the first."""
    if len(points) < 2:
        return list(points)
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        far = max(((_off_segment(points[i], points[a], points[b]), -i) for i in range(a + 1, b)), default=(0.0, 0))
        if far[0] > squared:
            k = -far[1]
            keep.add(k)
            todo += [(a, k), (k, b)]
    return [points[i] for i in sorted(keep)]


def reduce_open(points: list[Point], tolerance: float) -> list[Point]:
    """Thins by half the squared tolerance, then simplifies by all of it."""
    if len(points) <= 2 or tolerance == 0:
        return list(points)
    return douglas_peucker(_thinned(points, tolerance * tolerance * 0.5), tolerance * tolerance)


def reduce_closed(path: list[Point], tolerance: float) -> list[Point] | None:
    """Reduces the four stretches between the extreme points of a closed path; null if too little is left."""
    if not path or path[0] != path[-1]:
        return None
    ring = list(enumerate(path[:-1])) or [(0, path[0])]
    west = min(ring, key=lambda e: (e[1][0], e[0]))[0]
    north = min(ring, key=lambda e: (e[1][1], -e[0]))[0]
    east = max(ring, key=lambda e: (e[1][0], e[0]))[0]
    south = max(ring, key=lambda e: (e[1][1], e[0]))[0]
    if abs(path[west][0] - path[east][0]) < tolerance and abs(path[north][1] - path[south][1]) < tolerance:
        return None
    cut = sorted((west, north, east, south))
    parts = [path[a : b + 1] for a, b in zip(cut, cut[1:], strict=False)] + [path[cut[3] : -1] + path[: cut[0] + 1]]
    out = [p for part in parts[:3] for p in reduce_open(part, tolerance)[:-1]] + reduce_open(parts[3], tolerance)
    return out if len(out) > 3 else None


def number(v: float, precision: int | None = None) -> str:
    """Shortest text without exponent, or rounded to ``precision`` digits without trailing zeros."""
    if isinstance(v, int):
        return str(v)
    if precision is None:
        text = format(Decimal(repr(v)), "f")
        return text[:-2] if text.endswith(".0") else text
    text = f"{v:.{precision}f}"
    return text.rstrip("0").rstrip(".") if precision else text


def svg(path: list[Point], close: bool = True, dx: float = 0, dy: float = 0, precision: int | None = None) -> str:
    """Absolute commands; a closed path does not repeat its first point."""
    if not path:
        return ""
    points = path[:-1] if close and len(path) > 1 else path
    text = " ".join(f"{'L' if i else 'M'}{number(x + dx, precision)},{number(y + dy, precision)}" for i, (x, y) in enumerate(points))
    return f"{text} Z " if close else f"{text} "


def spline_svg(points: list[Point], close: bool = True, dx: float = 0, dy: float = 0, precision: int | None = None) -> str:
    """Cubics through 1 + 3n control points."""
    if not points:
        return ""
    if (len(points) - 1) % 3:
        raise ValueError("a spline has 1 + 3n points")
    text = [f"{number(float(x + dx), precision)} {number(float(y + dy), precision)}" for x, y in points]
    curves = "".join(f"C{' '.join(text[k : k + 3])} " for k in range(1, len(text), 3))
    return f"M{text[0]} {curves}{'Z ' if close else ''}"


def compound_svg(parts: list[list[Point]], splines: bool = False, close: bool = True, precision: int | None = None) -> tuple[str, Point]:
    """One text of an outline and its holes, moved so that it starts at the origin, and the offset that moves it back."""
    if not parts:
        return "", (0, 0)
    x, y = parts[0][0]
    draw = spline_svg if splines else svg
    return "".join(draw(p, close, -x, -y, precision) for p in parts), (x, y)


def per_object(df: DataFrame, key: str, work: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Applies ``work`` to the rows of each object, in the order of ``columns``; it returns rows without the key.

    An object has to fit into one task, as an image or a path does; objects spread over the cluster. Rows arrive
    sorted, so a task streams through its objects and holds one at a time.
    """
    whole = f"{key} {df.schema[key].dataType.simpleString()}, {schema}"
    fields = _parse_datatype_string(whole).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, group in groupby(objects(batches), key=lambda r: r[0]):
            out += ((k, *r) for r in work([r[1:] for r in group]))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return df.select(key, *columns).repartition(F.col(key)).sortWithinPartitions(key, *columns).mapInArrow(run, whole)


def outlines(bits: DataFrame, simplified: bool = True) -> DataFrame:
    """``object_id, svg, corners, holes`` of 4-connected objects ``object_id, x, y``."""

    def work(rows):
        found = compound(set(rows))
        found = [simplify(p, k == 0) for k, p in enumerate(found)] if simplified else found
        return [("".join(map(svg, found)), sum(map(len, found)), len(found) - 1)]

    return per_object(bits, "object_id", work, ["x", "y"], "svg string, corners int, holes int")


def reduced(paths: DataFrame, tolerance: float) -> DataFrame:
    """``path_id, k, x, y``: open polylines, points in order of x, reduced."""
    return per_object(paths, "path_id", lambda rows: [(k, x, y) for k, (x, y) in enumerate(reduce_open(rows, tolerance))], ["x", "y"], "k int, x long, y long")
