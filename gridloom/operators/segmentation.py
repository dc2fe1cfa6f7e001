"""Hierarchical colour segmentation of images, one image to a group.

Regions grow in raster order, which makes the outcome depend on that order, and then merge from small to large into
the neighbour of most similar colour. Regions that differ enough stay as children of what surrounds them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from gridloom.operators.morph import parts_of
from gridloom.operators.paths import compound, compound_svg, per_object

#: Red, green, blue, and alpha where a key colour asks for it.
Color = tuple[int, ...]


@dataclass(frozen=True)
class Settings:
    """``diagonal`` also joins along diagonals. ``hierarchical`` is the area up to which regions merge, None for no bound;
    0 leaves growth as it is. A region stays a child if its area lies strictly between ``min_area`` and ``max_area``,
    it is not all outline, and its colour differs by more than ``deepen``. It cuts a hole if it has ``hollow`` neighbours
    at most. Colours are the same if channels without ``shift`` low bits differ by ``threshold`` at most.

    Pixels of the ``key`` colour, alpha included, belong to no region: they make up region 0, or are dropped if ``discard``.
    The four rules may be given instead of those above: ``same`` and ``difference`` take two colours, ``deepens`` takes the
    segmenter, a region's id, its area and the colours of its sorted neighbours, ``hollows`` the segmenter, the id, the area
    and the neighbours' ids. They run on executors, so they have to be functions that can be sent there."""

    diagonal: bool = False
    hierarchical: int | None = None
    min_area: int = 16
    max_area: int = 65_536
    shift: int = 4
    threshold: int = 1
    deepen: int = 64
    hollow: int = 1
    key: Color | None = None
    discard: bool = False
    same: Callable[[Color, Color], bool] | None = None
    difference: Callable[[Color, Color], int] | None = None
    deepens: Callable[[Segmenter, int, int, list[Color]], bool] | None = None
    hollows: Callable[[Segmenter, int, int, list[int]], bool] | None = None


@dataclass
class Region:
    pixels: list[tuple[int, int]] = field(default_factory=list)
    holes: list[tuple[int, int]] = field(default_factory=list)
    total: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    residue: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    parent: int | None = None
    depth: int = 0

    @property
    def area(self) -> int:
        return len(self.pixels)

    def take(self, at: tuple[int, int], color: Color) -> None:
        self.pixels.append(at)
        self.total = [a + b for a, b in zip(self.total, (*color[:3], 1), strict=True)]

    def absorb(self, other: Region) -> None:
        self.pixels += other.pixels
        self.total = [a + b for a, b in zip(self.total, other.total, strict=True)]


def mean_color(sums: list[int]) -> Color:
    return tuple(c // sums[3] for c in sums[:3]) if sums[3] else (0, 0, 0)


def _outline_size(region: Region) -> int:
    inside = set(region.pixels) - set(region.holes)
    return sum(not {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} <= inside for x, y in inside)


class Segmenter:
    """Region 0 is reserved. ``label`` maps pixels to regions, ``output`` lists the regions that came out, in order."""

    def __init__(self, image: dict[tuple[int, int], Color], settings: Settings):
        self.image, self.s = image, settings
        self.regions: dict[int, Region] = {0: Region()}
        self.label: dict[tuple[int, int], int] = {}
        self.output: list[int] = []
        self._grow()
        if settings.hierarchical == 0:
            self.output = sorted((k for k, r in self.regions.items() if r.area), key=lambda k: self.regions[k].area * 65535 + k)
            for r in self.regions.values():
                r.residue = list(r.total)
        else:
            self._merge_up()

    def _same(self, p: tuple[int, int], q: tuple[int, int]) -> bool:
        a, b = self.image.get(p), self.image.get(q)
        if a is None or b is None:
            return False
        if self.s.same:
            return self.s.same(a, b)
        return all(abs((u >> self.s.shift) - (v >> self.s.shift)) <= self.s.threshold for u, v in zip(a[:3], b[:3], strict=True))

    def _difference(self, a: Color, b: Color) -> int:
        return self.s.difference(a, b) if self.s.difference else sum(abs(u - v) for u, v in zip(a, b, strict=True))

    def _join(self, source: int, target: int) -> None:
        for p in self.regions[source].pixels:
            self.label[p] = target
        self.regions[target].absorb(self.regions[source])
        self.regions[source].pixels, self.regions[source].total = [], [0, 0, 0, 0]

    def _grow(self) -> None:
        top = 1  # the next id
        spare = False  # an emptied newest region leaves its id to the next one; while one id waits, no other is freed
        for at in sorted(self.image, key=lambda p: (p[1], p[0])):
            x, y = at
            up, left, corner = (x, y - 1), (x - 1, y), (x - 1, y - 1)
            of = {p: self.label.get(p, 0) for p in (up, left, corner)}
            if of[left] != of[up] and self._same(left, up) and (self.s.diagonal or self._same(at, left) and self._same(at, up)):
                small, large = (left, up) if self.regions[of[left]].area <= self.regions[of[up]].area else (up, left)
                self._join(of[small], of[large])
                if small == left and of[left] == top - 1 and not spare:
                    top, spare = top - 1, True
                of[small] = of[large]
            if self.s.key is not None and self.image[at] == self.s.key:
                if not self.s.discard:
                    self.regions[0].take(at, self.image[at])
                continue
            near_corner = self._same(at, corner)
            if near_corner and self._same(at, up):
                mine = of[up]
            elif near_corner and self._same(at, left):
                mine = of[left]
            elif near_corner and self.s.diagonal:
                mine = of[corner]
            else:
                mine, top, spare = top, top + 1, False
                self.regions[mine] = Region()
            self.label[at] = mine
            self.regions[mine].take(at, self.image[at])

    def neighbours(self, k: int) -> list[int]:
        pixels = self.regions[k].pixels
        near = {self.label.get(q, 0) for x, y in pixels for q in ((x, y - 1), (x, y + 1), (x - 1, y), (x + 1, y))}
        return sorted(near - {0, self.label.get(pixels[0], 0)})

    def _merge_up(self) -> None:
        for r in self.regions.values():
            r.residue = list(r.total)
        known = {r.area for r in self.regions.values() if r.area}  # areas that occur or have occurred
        area = min(known, default=None)
        while area is not None:
            for k in sorted(self.regions):
                if self.regions[k].area == area:
                    self._settle(k, area, known)
            area = min((a for a in known if a > area), default=None)

    def _settle(self, k: int, area: int, known: set[int]) -> None:
        region, s = self.regions[k], self.s
        if s.hierarchical is not None and area > s.hierarchical:
            self.output.append(k)
            return
        mine = mean_color(region.total)
        near = sorted((self._difference(mine, mean_color(self.regions[o].total)) * 65535 + o, o) for o in self.neighbours(k))
        if not near:
            if area == max(known) or s.key is not None and s.discard:
                self.output.append(k)  # the background, or what dropped pixels cut off
            return
        target = self.regions[near[0][1]]
        diff = (near[0][0] - near[0][1]) // 65535
        child = s.hierarchical is None and self._deepens(k, area, diff, [o for _, o in near])
        hollow = s.hollows(self, k, area, [o for _, o in near]) if s.hollows else len(near) <= s.hollow
        kept = (list(region.pixels), list(region.total))
        if not child:
            target.residue = [a + b for a, b in zip(target.residue, region.residue, strict=True)]
        self._join(k, near[0][1])
        known.add(target.area)
        if child:
            region.pixels, region.total = kept
            self.output.append(k)
            if hollow:
                target.holes += region.pixels
            region.parent = near[0][1]
            target.depth += 1

    def _deepens(self, k: int, area: int, diff: int, near: list[int]) -> bool:
        s = self.s
        if s.deepens:
            return s.deepens(self, k, area, [mean_color(self.regions[o].total) for o in near])
        return s.min_area < area < s.max_area and (s.min_area == 0 or _outline_size(self.regions[k]) < area) and diff > s.deepen

    def shape(self, k: int, holes: bool = True) -> set[tuple[int, int]]:
        """Pixels of a region, without those of hollow children if ``holes``."""
        return set(self.regions[k].pixels) - set(self.regions[k].holes if holes else ())


def _per_image(df: DataFrame, settings: Settings, work: Callable[[Segmenter], list[tuple]], schema: str) -> DataFrame:
    """Images ``image_id, x, y, r, g, b``, and ``a`` where a key colour has four channels."""
    channels = ["r", "g", "b", "a"][: 4 if settings.key is not None and len(settings.key) == 4 else 3]
    return per_object(df, "image_id", lambda rows: work(Segmenter({(x, y): tuple(c) for y, x, *c in rows}, settings)), ["y", "x", *channels], schema)


def segment(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``image_id, place, area, r, g, b, l, t, n_children, parent_place``: the regions of images in order of output.

    Colours are those of the residue, without children. ``parent_place`` is null for what has no parent in the output.
    """

    def work(seg):
        place = {k: i for i, k in enumerate(seg.output)}
        return [(i, q.area, *mean_color(q.residue), min(x for x, _ in q.pixels), min(y for _, y in q.pixels), q.depth, place.get(q.parent)) for i, q in enumerate(seg.regions[k] for k in seg.output) if q.pixels]

    return _per_image(df, settings, work, "place int, area int, r int, g int, b int, l long, t long, n_children int, parent_place int")


def recolor(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``image_id, x, y, r, g, b``: images painted with their regions' colours; earlier regions of the output win."""

    def work(seg):
        painted = {p: mean_color(seg.regions[k].residue) for k in reversed(seg.output) for p in seg.regions[k].pixels}
        return [(x, y, *c) for (x, y), c in sorted(painted.items())]

    return _per_image(df, settings, work, "x long, y long, r int, g int, b int")


def region_neighbours(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``image_id, a, b``: neighbouring regions after growth, by their first raster pixel's index in the image's frame."""

    def work(seg):
        first = {k: min((y, x) for x, y in seg.regions[k].pixels) for k in seg.output}
        wide = max(x for x, _ in seg.image) + 1
        name = {k: y * wide + x for k, (y, x) in first.items()}
        return [(name[a], name[b]) for a in seg.output for b in seg.neighbours(a) if b in name]

    return _per_image(df, replace(settings, hierarchical=0), work, "a long, b long")


def region_at(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``image_id, x, y, place``: the region that each pixel ended in, null if that is not in the output. Look-ups are joins with it."""

    def work(seg):
        place = {k: i for i, k in enumerate(seg.output)}
        return [(x, y, place.get(seg.label.get((x, y), 0))) for x, y in sorted(seg.image)]

    return _per_image(df, settings, work, "x long, y long, place int")


def region_pixels(df: DataFrame, settings: Settings = Settings(), holes: bool = True) -> DataFrame:
    """``image_id, place, x, y``: the bitmap of every region of the output; hollow children are cut out if ``holes``."""
    return _per_image(df, settings, lambda seg: [(i, x, y) for i, k in enumerate(seg.output) for x, y in sorted(seg.shape(k, holes))], "place int, x long, y long")


def region_paths(df: DataFrame, settings: Settings = Settings(), holes: bool = True) -> DataFrame:
    """``image_id, place, svg, x, y, parts``: outlines and holes of every region of the output, each connected part traced alone.

    The text begins at the origin and belongs at x, y. Regions of which nothing is left give no row.
    """

    def work(seg):
        out = []
        for i, k in enumerate(seg.output):
            outlines = [path for part in parts_of(seg.shape(k, holes)) for path in compound(part)]
            if outlines:
                text, (x, y) = compound_svg(outlines)
                out.append((i, text, x, y, len(outlines)))
        return out

    return _per_image(df, settings, work, "place int, svg string, x long, y long, parts int")
