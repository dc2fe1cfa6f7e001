"""Colours as integer channels 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named colours and the palette.
NAMED = {"Black": (0, 0, 0, 255), "White": (255, 255, 255, 255), "Red": (255, 0, 0, 255)}


PALETTE = ((216, 51, 74), (255, 232, 96), (160, 212, 104), (72, 207, 173), (79, 193, 233), (93, 156, 236), (128, 103, 183), (172, 146, 236))


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def named(name: Column) -> Column:
    """A named colour; null for unknown names."""
    return F.try_element_at(F.create_map(*(v for n, c in NAMED.items() for v in (F.lit(n), rgba(*map(F.lit, c))))), name)


def palette(i: Column) -> Column:
    """One of eight colours, around and around."""
    return F.element_at(F.array(*(rgba(*map(F.lit, c), F.lit(255)) for c in PALETTE)), F.pmod(i, F.lit(len(PALETTE))).cast("int") + 1)


def color_text(c: Column) -> Column:
    """``rgba(r,g,b,alpha)`` with alpha in 0 to 1 as the shortest text."""
    alpha = c["a"] / F.lit(255.0)
    short = F.when(alpha == 0, "0").when(alpha == 1, "1").otherwise(alpha.cast("string"))
    return F.concat(F.lit("rgba("), F.concat_ws(",", *(c[x].cast("string") for x in "rgb"), short), F.lit(")"))


def channel(c: Column, k: Column) -> Column:
    """Channel 0 to 3; null beyond."""
    return F.get(F.array(*(c[x] for x in "rgba")), k)


def rgb_bytes(c: Column) -> Column:
    return F.array(*(c[x] for x in "rgb"))


def mean_of_four(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Truncated, alpha too."""
    return rgba(*(F.floor((w[c] + x[c] + y[c] + z[c]) / 4) for c in "rgba"))


def add(a: Column, b: Column) -> Column:
    return F.struct(*((a[c] + b[c]).alias(c) for c in "rgb"))


def subtract(a: Column, b: Column) -> Column:
    return F.struct(*((a[c] - b[c]).alias(c) for c in "rgb"))


def to_color(c: Column) -> Column:
    """An opaque colour; null where a channel is beyond 0 to 255."""
    return F.when(c["r"].between(0, 255) & c["g"].between(0, 255) & c["b"].between(0, 255), rgba(c["r"], c["g"], c["b"], F.lit(255).cast("long")))


def magnitude(c: Column) -> Column:
    return F.sqrt(sum((c[x] * c[x] for x in "rgb"), F.lit(0)).cast("double"))


def truncated_mean(total: Column, count: Column | int) -> Column:
    return F.floor(total / F.nullif(count if isinstance(count, Column) else F.lit(count), F.lit(0)))


def hex_string(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def grey(r: Column, g: Column, b: Column) -> Column:
    return truncated_mean(r + g + b, 3)


def difference(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Sum of channel differences."""
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def squared_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def largest_difference(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def same(a: tuple[Column, ...], b: tuple[Column, ...], shift: int, threshold: int) -> Column:
    """Channels without their ``shift`` low bits differ by ``threshold`` at most; not transitive."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (F.abs(F.shiftright(x, shift) - F.shiftright(y, shift)) <= threshold)
    return out


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h, s, v in 0 to 1; grey has hue 0; of equal largest channels red counts first, then green."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    turn = F.when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) / 6
    h = F.coalesce(F.when(turn < 0, turn + 1).otherwise(turn), F.lit(0.0))
    return F.struct(h.alias("h"), F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("s"), top.alias("v"))
