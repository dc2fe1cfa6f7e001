"""Small examples worked out by hand."""

import math
import random


import pytest
from pyspark.sql import functions as F

from gridloom.functions import colors as C
from gridloom.functions import points as P
from gridloom.functions.rects import Rect
from gridloom.operators import bitmaps, morph, paths, raster, segmentation, shapes, smoothing, spatial, stats
from gridloom.operators.components import connected_components


def bits_of(spark, *texts):
    return bitmaps.from_text(spark.createDataFrame(list(enumerate(texts)), "image_id long, text string"))


def points_of(df):
    return sorted((r.x, r.y) for r in df.collect())


def test_components_of_a_graph(spark):
    edges = [(2, 1), (3, 2), (3, 4), (10, 9), (7, 7), (5, None)] + [(k, k + 1) for k in range(100, 180)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 9, 10, 7)} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9, 7: 7}
    assert {got[k] for k in range(100, 181)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gap_groups(spark):
    df = spark.createDataFrame([(0, v) for v in (1, 1, 7, 9, 24, 1, 4, 7, 3, 8)], "k int, v int")
    got = {r.v: r.island for r in spatial.gap_groups(df, ["k"], "v", 1).collect()}
    assert got == {1: 1, 3: 3, 4: 3, 7: 7, 8: 7, 9: 7, 24: 24}


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 2), ("c", 3), ("d", None)], "k string, v int")
    got = {r.k: r for r in stats.sample(df, ["k"], "v").collect()}
    assert (got["a"].mean, got["a"].deviation, got["a"].mode, got["a"].median, got["a"].bins) == (1.0, 0.0, 1, 1, 1)
    assert (got["b"].mean, got["b"].deviation, got["b"].mode, got["b"].median) == (2.0, 1.0, 1, 2)
    assert (got["c"].mode, got["c"].median, got["c"].median_frequency, got["c"].bins) == (2, 2, 2, 3)
    assert "d" not in got
    assert {r.k: r.value for r in stats.percentile(df, ["k"], "v", 50).collect()} == {"a": 1, "b": 2, "c": 2}


def rect(l, t, r, b):  # noqa: E741
    return Rect(*map(F.lit, (l, t, r, b)))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rectangle_predicates(spark):
    a = rect(0, 0, 10, 10)
    for other, hit, holds, crosses in (((10, 10, 20, 20), True, False, True), ((11, 0, 20, 5), False, False, False), ((2, 2, 5, 5), True, True, False), ((0, 0, 10, 10), True, True, False), ((5, 5, 15, 8), True, False, True)):
        o = rect(*other)
        assert (value(spark, a.hit(o)), value(spark, a.contains(o)), value(spark, a.intersects(o))) == (hit, holds, crosses)
    assert value(spark, rect(3, 3, 3, 3).is_empty)
    assert not value(spark, rect(3, 3, 3, 8).is_empty)
    assert value(spark, rect(-7, 0, 0, 0).centre_x) == -4
    assert value(spark, rect(0, 0, 0, 5).aspect_ratio) == math.inf
    assert value(spark, rect(0, 0, 0, 5).aspect_ratio_doubled) is None


def test_rectangle_boundary_walk(spark):
    q = Rect(*(F.lit(v).cast("long") for v in (0, 0, 5, 6)))
    for clockwise in (True, False):
        walk = value(spark, q.boundary_walk(F.lit(0).cast("long"), F.lit(0).cast("long"), clockwise))
        assert len(walk) == 22 == len(set(walk))
        assert tuple(walk[1]) == ((1, 0) if clockwise else (0, 1))
        assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(walk, walk[1:] + walk[:1], strict=True))
    assert value(spark, q.boundary_walk(F.lit(2).cast("long"), F.lit(2).cast("long"))) is None


def test_enclosing_passes_over_empty(spark):
    df = spark.createDataFrame([(1, 9, 9, 9, 9), (1, 2, 3, 4, 5), (2, 7, 7, 7, 7)], "k int, l int, t int, r int, b int")
    assert sorted(map(tuple, spatial.enclosing(df, ["k"]).collect())) == [(1, 2, 3, 4, 5, 2), (2, 0, 0, 0, 0, 1)]


def test_overlap_pairs_equal_nested_loop(spark):
    import random

    rng = random.Random(4)
    data = [(k, x := rng.randrange(300), y := rng.randrange(300), x + rng.randrange(90), y + rng.randrange(60)) for k in range(150)]
    df = spark.createDataFrame(data, "rect_id long, l long, t long, r long, b long")
    got = {tuple(r) for r in spatial.overlap_pairs(df, expand=3, tile=20).collect()}
    hit = lambda a, b: a[1] - 3 <= b[3] + 3 and a[3] + 3 >= b[1] - 3 and a[2] - 3 <= b[4] + 3 and a[4] + 3 >= b[2] - 3
    assert got == {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and hit(a, b)}


def test_tile_map(spark):
    tiles = spatial.TileMap(100, 100, 10)
    df = spark.createDataFrame([(1, 5, 5), (2, -3, 200), (3, 95, 15)], "id int, x int, y int")
    assert {r.id: r.tile for r in tiles.of_point(df, F.col("x"), F.col("y")).collect()} == {1: 0, 2: 90, 3: 19}
    one = spark.createDataFrame([(1, 5, 5, 35, 35)], "id int, l int, t int, r int, b int")
    got = {r.tile for r in tiles.of_outline(one, Rect.of()).collect()}
    assert got == {y * 10 + x for x in range(4) for y in range(4)} - {11, 12, 21, 22}


def test_points(spark):
    p = lambda x, y: P.point(F.lit(x), F.lit(y))
    assert tuple(value(spark, P.rotate_quarter(p(3, 1), p(1, 1), True))) == (1, 3)
    assert tuple(value(spark, P.rotate_quarter(p(3, 1), p(1, 1), False))) == (1, -1)
    assert tuple(value(spark, P.normalised(p(0.0, 0.0)))) == (0.0, 0.0)
    assert value(spark, P.to_int(F.lit(1e20))) == 2147483647
    assert value(spark, P.to_int(F.lit(float("nan")))) == 0
    cross = value(spark, P.line_intersection(p(0.0, 0.0), p(2.0, 2.0), p(0.0, 2.0), p(2.0, 0.0)))
    assert tuple(cross) == (1.0, 1.0, 0.5, 0.5)
    assert value(spark, P.line_intersection(p(0.0, 0.0), p(2.0, 0.0), p(0.0, 1.0), p(2.0, 1.0))) is None
    assert tuple(value(spark, P.line_intersection(p(0.0, 0.0), p(2.0, 0.0), p(5.0, 0.0), p(9.0, 0.0)))) == (1.0, 0.0, None, None)


def test_colors(spark):
    c = lambda *v: tuple(map(F.lit, v))
    assert value(spark, C.hex_string(*c(255, 10, 0))) == "#FF0A00"
    assert tuple(value(spark, C.hsv(*c(255, 0, 0)))) == (0.0, 1.0, 1.0)
    assert tuple(value(spark, C.hsv(*c(9, 9, 9))))[:2] == (0.0, 0.0)
    assert value(spark, C.same(c(16, 16, 16), c(47, 16, 16), 4, 1))
    assert not value(spark, C.same(c(16, 16, 16), c(48, 16, 16), 4, 1))


def test_bitmap_text_round_trip_and_components(spark):
    text = "*-*\n-*-\n*-*\n"
    bits = bits_of(spark, text)
    assert bitmaps.to_text(bits, 3, 3).first().text == text
    count = lambda d: bitmaps.components(bits, d, 3).select("component").distinct().count()
    assert (count(False), count(True)) == (5, 1)


def test_bitmap_boundary_and_stroke(spark):
    bits = bits_of(spark, "*****\n*****\n*****\n*****")
    assert len(points_of(bitmaps.boundary(bits))) == 14
    assert points_of(bitmaps.stroke(bits_of(spark, "*"), 4)) == [(x, y) for x in (1, 2, 3) for y in (1, 2, 3)]


def test_prefix_sums_and_missing_corner(spark):
    pixels = spark.createDataFrame([(0, x, y, x + 10 * y) for x in range(6) for y in range(6)], "image_id long, x long, y long, v long")
    regions = spark.createDataFrame([(1, 0, 1, 2, 4, 5), (2, 0, 0, 0, 6, 2)], "region_id long, image_id long, x0 long, y0 long, x1 long, y1 long")
    got = {r.region_id: r.total for r in raster.region_sums(raster.prefix_sums(pixels), regions).collect()}
    assert got == {1: sum(x + 10 * y for x in range(1, 5) for y in range(2, 6)), 2: None}


def test_spiral():
    assert raster.spiral(0) == []
    assert raster.spiral(1) == [(0, 0)]
    assert raster.spiral(2) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert sorted(raster.spiral(8)) == [(x, y) for x in range(8) for y in range(8)]


def test_embedding_of_red_pixels(spark):
    red = {(0, 0), *((x, y) for x in range(64, 72) for y in range(64, 72))}
    rows = [(0, x, y, 255 if (x, y) in red else 0, 0, 0) for x in range(128) for y in range(128)]
    values = raster.embed(spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long")).first()["values"]
    assert len(values) == 65535
    # 65 of 16,384 pixels at 255, truncated level by level
    assert values[0] == 0 or values[0] == 1
    assert values[3 * (65535 // 3 - 128 * 128) + 3 * raster.spiral(128).index((0, 0))] == 255


def test_circles_and_lines(spark):
    disc = points_of(shapes.discs(spark.createDataFrame([(0, 3, 3)], "image_id long, w long, h long")))
    assert disc == [(x, y) for x in range(3) for y in range(3)]
    line = shapes.lines(spark.createDataFrame([(0, 0, 0, 4, -2), (1, 3, 3, 3, 3)], "line_id long, x0 long, y0 long, x1 long, y1 long"))
    got = sorted((r.line_id, r.k, r.x, r.y) for r in line.collect())
    assert got == [(0, 0, 0, 0), (0, 1, 1, -1), (0, 2, 2, -1), (0, 3, 3, -2), (0, 4, 4, -2), (1, 0, 3, 3)]


def test_shape_codes(spark):
    layers = shapes.code_layers(bits_of(spark, "**\n--"), 2)
    assert [(r.layer, r.place, r.value) for r in layers.orderBy("layer", "place").collect()] == [(0, 0, 2), (1, 0, 1), (1, 1, 1), (1, 2, 0), (1, 3, 0)]
    tail = lambda k: sum((1 << p) << s for p, s in shapes.TAIL_SHIFTS[k:])
    cases = [("1", "1", tail(1)), ("10010", "10001", (2 << 8) + tail(2)), ("10010", "00001", (1 << 8) + (2 << 8) + tail(2)), ("1101010101010011100011100", "1111010101011001100110101", (1 << 8) + (5 << 8) + tail(3))]
    for a, b, want in cases:
        assert value(spark, shapes.code_distance(F.lit(a), F.lit(b))) == want
    assert value(spark, shapes.code_distance(F.lit(cases[3][0]), F.lit(cases[3][1]))) == 53376
    assert [shapes.code_length(1 << 2 * k) for k in range(9)] == [1, 5, 25, 105, 425, 1705, 6825, 27305, 109225]


def brute_distance(a, b):
    total = 0
    for k, shift in enumerate(shapes.LAYER_SHIFTS):
        end, size = shapes.layer_places(k)
        if len(a) <= end - size and len(b) <= end - size:
            return total + sum((1 << p) << s for p, s in shapes.TAIL_SHIFTS[k:])
        x, y = ([c[i] == "1" if i < len(c) else i % 4 == side for i in range(end - size, end)] for side, c in enumerate((a, b)))
        total += min(sum(p != q for p, q in zip(x, y, strict=True)), max(size - 1, 1)) << shift
    return total


def test_code_distance_of_all_lengths(spark):
    rng = random.Random(3)
    code = lambda n: "".join(rng.choices("01", k=n))
    pairs = [(code(m), code(n)) for m in (1, 5, 25, 105, 1705, 6825) for n in (1, 25, 425, 6825)]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    got = {(r.a, r.b): r.d for r in df.select("a", "b", shapes.code_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {(a, b): brute_distance(a, b) for a, b in pairs}


def test_nearest_codes(spark):
    rng = random.Random(4)
    codes = [(k, "".join(rng.choices("01", k=425))) for k in range(60)] + [(60, "1" * 425), (61, "1" * 425)]
    df = spark.createDataFrame(codes, "image_id long, code string")
    got = sorted(map(tuple, shapes.nearest_codes(df.filter("image_id % 20 = 0"), df, 3, 16).collect()))
    want = []
    for a, ca in codes:
        if a % 20 == 0:
            best = sorted((brute_distance(ca, cb), b) for b, cb in codes if b != a)[:3]
            want += [(a, n + 1, b, d) for n, (d, b) in enumerate(best)]
    assert got == want


def test_decoding(spark):
    text = "*--*\n-**-\n-*--\n*---"
    codes = shapes.code_bits(shapes.code_layers(bits_of(spark, text), 4), 4)
    back = shapes.decode(codes, "bits").select("x", "y").collect()
    assert {tuple(r) for r in back} == {(x, y) for y, row in enumerate(text.split("\n")) for x, c in enumerate(row) if c == "*"}
    read = lambda t: value(spark, shapes.hex_bits(F.lit(t)))
    assert (read("D0"), read("D"), read("80"), read("00"), read("5051040"), read("123456")) == ("11010", "11010", "1", "0", "0101000001010001000001000", None)


def test_arcs(spark):
    points = value(spark, shapes.circle_spline(F.lit(0), F.lit(0), F.lit(200)))
    assert len(points) == 13 and abs(points[0]["x"] - 100) < 0.1 and abs(points[0]["y"]) < 0.1
    curve = [(p["x"], p["y"]) for p in points]
    for k in range(0, 12, 3):
        for t in (0, 0.25, 0.5, 0.75, 1):
            w = ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
            x, y = (sum(a * p[c] for a, p in zip(w, curve[k : k + 4], strict=True)) for c in (0, 1))
            assert abs(math.hypot(x - 100, y - 100) - 100) < 0.05
    assert value(spark, shapes.arc(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (5, 0), (5, 9))))) is None


def test_spline_text():
    points = [(2.22, 2.67), (3.5, 3.48), (4.19, 4.72), (5.68, 5.26)]
    assert [paths.spline_svg(points, False, precision=p) for p in (None, 1, 0)] == ["M2.22 2.67 C3.5 3.48 4.19 4.72 5.68 5.26 ", "M2.2 2.7 C3.5 3.5 4.2 4.7 5.7 5.3 ", "M2 3 C4 3 4 5 6 5 "]
    ring = {(x + 5, y + 7) for x in range(3) for y in range(3)} - {(6, 8)}
    text, at = paths.compound_svg(paths.compound(ring))
    assert at == (5, 7) and text.startswith("M0,0 L3,0 L3,3 L0,3 Z M") and text.count("Z") == 2
    assert paths.compound_svg([]) == ("", (0, 0))


def test_significance_weighs_against_the_first(spark):
    a, b = bits_of(spark, "****\n****\n****\n****"), bits_of(spark, "****\n----\n----\n****")
    bar = [(0, x, y) for x in range(4) for y in (1, 2)]
    stat = morph.skeleton_stats(spark.createDataFrame(bar, "image_id long, x long, y long")).first()
    want = 4 * 128 * 128 * 8 * int(stat["mean"] if stat else 0) * (stat.n if stat else 0) // 8 // (16 * 4)
    assert morph.clustered_difference(a, b, 4).first().score == want
    assert morph.clustered_difference(spark.createDataFrame([], "image_id long, x long, y long"), b, 4).first().score is None


def test_components_of_eight_neighbours(spark):
    rng = random.Random(9)
    pixels = [(i, x, y) for i in range(3) for x in range(40) for y in range(40) if rng.random() < 0.3]
    got = {(r.image_id, r.x, r.y): r.component for r in bitmaps.components(spark.createDataFrame(pixels, "image_id long, x long, y long"), True, 40).collect()}
    left = set(pixels)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i, x, y = todo.pop()
            part.add((i, x, y))
            near = {(i, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
            left -= near
            todo += near
        assert {got[p] for p in part} == {min(y * 40 + x for _, x, y in part)}


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_components_of_random_graphs(spark, monkeypatch, kind):
    from gridloom.operators import components

    monkeypatch.setattr(components, "HELD_EDGES", 7)
    rng = random.Random(kind)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200)]
    parent = {v: v for e in edges for v in e}
    for _ in range(len(parent)):
        for x, y in edges:
            parent[x] = parent[y] = min(parent[x], parent[y])
    name = {"long": lambda v: v, "string": lambda v: f"{v:04d}", "binary": lambda v: b"%04d" % v}[kind]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(5)
    got = {r.id if kind != "binary" else bytes(r.id): r.component if kind != "binary" else bytes(r.component) for r in components.connected_components(df).collect()}
    assert got == {name(v): name(p) for v, p in parent.items()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_outlines():
    square = {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert paths.trace(square) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert paths.trace(square, False)[1] == (0, 2)
    ring = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    outer, hole = paths.compound(ring)
    assert outer == [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]
    assert set(hole) == {(1, 1), (2, 1), (2, 2), (1, 2)}
    assert paths.trace(set()) == []


def test_simplification():
    stairs = [(0, 0), (10, 0), (10, 1), (11, 1), (11, 10), (0, 10), (0, 0)]
    assert (10, 1) not in paths.without_stairs(stairs)
    line = [(x, 0) for x in range(50)]
    assert paths.reduce_open(line, 2.0) == [(0, 0), (49, 0)]
    assert paths.reduce_open(line, 0) == line
    assert paths.douglas_peucker([(0, 0), (5, 4), (10, 0)], 9) == [(0, 0), (5, 4), (10, 0)]
    box = [(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert len(paths.reduce_closed(box, 1.0)) >= 4
    assert paths.reduce_closed([(0, 0), (0, 1), (1, 1), (0, 0)], 5.0) is None


def test_number_text():
    assert [paths.number(v) for v in (1.0, 0.5, 1e-7, 3)] == ["1", "0.5", "0.0000001", "3"]
    assert [paths.number(v, 2) for v in (1.005, 2.5, 3.0)] == ["1", "2.5", "3"]
    assert paths.number(3.5, 0) == "4"
    assert paths.svg([(0, 0), (1, 0), (1, 1)], close=False) == "M0,0 L1,0 L1,1 "
    assert paths.svg([(0, 0), (1, 0), (1, 1), (0, 0)]) == "M0,0 L1,0 L1,1 Z "


def test_smoothing_keeps_corners():
    box = [(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)]
    assert smoothing.smooth(box) == [tuple(map(float, p)) for p in box]
    ring = [(round(50 * math.cos(k / 8 * math.pi), 3), round(50 * math.sin(k / 8 * math.pi), 3)) for k in range(16)]
    round_path = smoothing.smooth([*ring, ring[0]])
    assert len(round_path) > 17 and round_path[0] == round_path[-1]
    assert len(smoothing.spline(round_path)) % 3 == 1


def test_segmentation():
    left, right = (10, 10, 10), (200, 200, 200)
    image = {(x, y): left if x < 4 else right for x in range(8) for y in range(8)}
    grown = segmentation.Segmenter(image, segmentation.Settings(hierarchical=0))
    assert sum(grown.regions[k].area for k in grown.output) == 64
    merged = segmentation.Segmenter(image, segmentation.Settings(min_area=4, max_area=60))
    assert [merged.regions[k].area for k in merged.output][-1] == 64
    assert segmentation.mean_color([0, 0, 0, 0]) == (0, 0, 0)
    plain = segmentation.Segmenter({(x, y): left for x in range(5) for y in range(5)}, segmentation.Settings())
    assert [plain.regions[k].area for k in plain.output] == [25]


def test_segmentation_with_a_key_colour():
    key, left, right = (0, 255, 0, 128), (10, 10, 10, 255), (200, 200, 200, 255)
    image = {(x, y): key if x == 4 else left if x < 4 else right for x in range(9) for y in range(6)}
    dropped = segmentation.Segmenter(image, segmentation.Settings(key=key, discard=True))
    assert [dropped.regions[k].area for k in dropped.output] == [24, 24]  # nothing joins across what was dropped
    assert all((4, y) not in dropped.label for y in range(6)) and dropped.regions[0].area == 0
    kept = segmentation.Segmenter(image, segmentation.Settings(key=key, hierarchical=0))
    assert kept.regions[0].area == 6 and kept.regions[0].total == [0, 1530, 0, 6]
    assert sum(kept.regions[k].area for k in kept.output) == 54
    # another alpha is another colour
    other = segmentation.Segmenter(image, segmentation.Settings(key=(*key[:3], 255), hierarchical=0))
    assert other.regions[0].area == 0


def test_segmentation_by_given_rules():
    image = {(x, y): (0, 0, 100) if x < 4 else (100, 0, 0) for x in range(8) for y in range(8)}
    alike = segmentation.Segmenter(image, segmentation.Settings(same=lambda a, b: sum(a) == sum(b), hierarchical=0))
    assert sorted(alike.regions[k].area for k in alike.output) == [1, 63]  # the first pixel joins later only
    rules = {"deepens": lambda seg, k, area, near: area == 32, "hollows": lambda seg, k, area, near: len(near) == 1}
    deep = segmentation.Segmenter(image, segmentation.Settings(**rules))
    first, last = deep.output
    assert deep.regions[first].area == 32 and deep.regions[first].parent == last and deep.regions[last].area == 64
    assert deep.shape(last) == deep.shape(last, False) - deep.shape(first) and len(deep.shape(last)) == 32
    assert segmentation.Segmenter(image, segmentation.Settings(difference=lambda a, b: 0)).output


def test_labels_and_regions_agree_after_growth():
    a, b = (0, 0, 0), (255, 255, 255)
    rows = ["aab", "aab", "bab", "aaa"]
    image = {(x, y): a if c == "a" else b for y, row in enumerate(rows) for x, c in enumerate(row)}
    seg = segmentation.Segmenter(image, segmentation.Settings(hierarchical=0))
    assert sum(seg.regions[k].area for k in seg.output) == len(image)
    assert set(seg.label) == set(image) and all(p in seg.regions[k].pixels for p, k in seg.label.items())


def test_regions_of_images(spark):
    rows = [(1, x, y, *((10, 10, 10) if 2 <= x < 6 and 2 <= y < 6 else (200, 200, 200))) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r int, g int, b int")
    settings = segmentation.Settings(min_area=4, max_area=60)
    at = {(r.x, r.y): r.place for r in segmentation.region_at(df, settings).collect()}
    assert len(at) == 64 and set(at.values()) == {1}
    inner = {(x, y) for x in range(2, 6) for y in range(2, 6)}
    pixels = segmentation.region_pixels(df, settings).collect()
    assert {(r.x, r.y) for r in pixels if r.place == 0} == inner
    assert {(r.x, r.y) for r in pixels if r.place == 1} == set(at) - inner
    assert segmentation.region_pixels(df, settings, holes=False).filter("place = 1").count() == 64
    paths_of = {r.place: r for r in segmentation.region_paths(df, settings).collect()}
    assert paths_of[0].svg == "M0,0 L4,0 L4,4 L0,4 Z " and (paths_of[0].x, paths_of[0].y, paths_of[0].parts) == (2, 2, 1)
    assert (paths_of[1].x, paths_of[1].y, paths_of[1].parts) == (0, 0, 2)
    assert segmentation.region_paths(df.limit(0), settings).count() == 0


def test_quadrilaterals(spark):
    texts = {  # the last is a triangle with steps
        "--***--\n-*****-\n*******\n*******\n*******\n-*****-\n--***--": False,
        "----*----\n---***---\n--*****--\n-*******-\n*********\n*********\n*********\n-*******-\n--*****--\n---***---\n----*----": True,
        "----*----\n--*****--\n-*******-\n-*******-\n*********\n*********\n*********\n-*******-\n-*******-\n--*****--\n----*----": False,
        "-***-\n-***-\n*****\n*****": False,
    }
    frames = spark.createDataFrame([(k, len(t.split("\n")[0]), t.count("\n") + 1) for k, t in enumerate(texts)], "image_id long, w long, h long")
    got = {r.image_id: r.quadrilateral for r in morph.is_quadrilateral(bits_of(spark, *texts), frames, 16).collect()}
    assert got == dict(enumerate(texts.values()))
    empty = spark.createDataFrame([(9, 5, 5)], "image_id long, w long, h long")
    assert morph.is_quadrilateral(bits_of(spark, *texts), empty, 16).first().quadrilateral is None


def test_hex_codes(spark):
    codes = lambda text, side: shapes.code_bits(shapes.code_layers(bits_of(spark, text), side), side).first().bits
    assert codes("*-\n-*", 2) == "11010"
    assert len(codes("*---\n----\n----\n----", 4)) == 25
    assert value(spark, shapes.hex_text(F.lit("11010"))) == "D0"
    assert value(spark, shapes.hex_text(F.lit("11010"), True)) == "D"
    assert value(spark, shapes.hex_text(F.lit("0101000001010001000001000"))) == "5051040"


def test_skeleton_of_a_bar(spark):
    bar = bits_of(spark, "*********\n*********\n*********\n*********\n*********")
    got = {(r.x, r.y) for r in morph.skeleton(bar).collect()}
    assert {(x, 2) for x in range(2, 7)} <= got
    assert morph.skeleton(bits_of(spark, "*")).count() == 0


def test_average_shape():
    row, column = {(x, 1) for x in range(3)}, {(1, y) for y in range(3)}
    assert morph.average_of(row, column) == row | column
    wide = {(x, y) for x in range(9) for y in range(3)}
    half = morph.average_of({(x, y) for x in range(3) for y in range(3)}, wide)
    assert half == {(x, y) for x in range(6) for y in range(3)}
    assert morph.average_of({(0, 0)}, {(5, 5)}) is None


def test_breaking_weak_joints():
    left, right = {(x, y) for x in range(3) for y in range(3)}, {(x, y) for x in range(3, 6) for y in range(2, 5)}
    parts = morph.break_weak_joints(left | right)
    assert sum(map(len, parts)) in (17, 18)
    assert morph.break_weak_joints({(0, 0), (1, 0)}) == [{(0, 0), (1, 0)}]


def test_recognition(spark):
    frames = spark.createDataFrame([(1, 20, 20), (2, 30, 12), (3, 4, 4)], "image_id long, w long, h long")
    got = {r.image_id: (r.ellipse, r.circle) for r in morph.is_ellipse(shapes.ellipses(frames), frames, 64).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_shape_queries_give_every_rectangle(spark):
    from pyspark.sql import functions as F

    from gridloom.plans.geometry import QUERIES
    from gridloom.sources.examples import load

    sf = "/root/testdata/sf0.001"
    rects = load(spark, sf, "fx_rects").count()
    for name in ("shape_average", "shape_recognise"):
        assert QUERIES[name](spark, sf).agg(F.count_distinct("image_id")).first()[0] == rects
