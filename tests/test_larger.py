"""What only larger tables show, on small ones made for it."""

import duckdb
import numpy as np
import pytest
from oracle import SF, agree

from gridloom.functions.rects import Rect
from gridloom.operators import morph, shapes, spatial
from gridloom.operators.components import connected_components
from gridloom.plans import elements, geometry  # noqa: F401

QUERIES = geometry.QUERIES  # to which elements adds its own


def parts(folder, rows):
    """A star schema that holds nothing but parts: rows of key and size."""
    values = ", ".join(f"({k}, {size})" for k, size in rows)
    duckdb.sql(f"copy (select k::bigint p_partkey, s::int p_size from (values {values}) v(k, s)) to '{folder}/part.parquet'")
    return str(folder)


#: The diagonals of the first three lie on the line from 0, 100 to 1000, 700.
ON_THE_LINE = [(181505, 49), (374363, 14), (711458, 34), (5, 3), (6, 12)]


@pytest.mark.parametrize("name", ["crossing_relations", "line_intersection"])
def test_lines_that_coincide_do_not_cross(spark, tmp_path, name):
    agree(QUERIES[name](spark, parts(tmp_path, ON_THE_LINE)), geometry.ORACLES[name], str(tmp_path))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, n):
    return spark.range(n).selectExpr("id AS image_id", "5 + id % 7 AS w", "6 + id % 5 AS h", "id % 4 AS radius")


def test_recognised_pixels_are_not_broadcast(spark):
    f = frames(spark, 30)
    ellipse, triangle = morph.is_ellipse(shapes.ellipses(f), f.select("image_id", "w", "h"), 64), morph.is_isosceles(shapes.rounded_rects(f), f.select("image_id", "w", "h"), 64)
    assert "BroadcastExchange" not in plan(ellipse) and "BroadcastExchange" not in plan(triangle)
    assert ellipse.count() == triangle.count() == 30


def test_quadrilateral_pixels_are_not_broadcast(spark):
    f = frames(spark, 12)
    assert "BroadcastExchange" not in plan(morph.is_quadrilateral(shapes.ellipses(f), f.select("image_id", "w", "h"), 64))


def test_quadrilateral_outlines_are_followed_once(spark):
    f = frames(spark, 12)
    found = morph.is_quadrilateral(shapes.ellipses(f), f.select("image_id", "w", "h"), 64)
    assert "MapInArrow" not in plan(found)
    assert found.count() == 12


def groups_by_pairs(df, expand, tile):
    found = connected_components(spatial.overlap_pairs(df, "rect_id", expand, tile))
    return df.selectExpr("rect_id AS id").join(found, "id", "left").selectExpr("id", "coalesce(component, id) AS component")


def test_overlap_groups_of_a_crowd_form_no_pairs(spark, monkeypatch):
    """Rectangles of many sizes, some of them lines, points or empty, in tiles that many share; the old way gives the same groups."""
    df = spark.range(700).selectExpr("id + 5 AS rect_id", "id * 37 % 397 - 50 AS l", "id * 91 % 409 - 50 AS t").selectExpr("*", "l + rect_id * 7 % 19 AS r", "t + rect_id * 5 % 13 - 1 AS b")
    want = sorted(map(tuple, groups_by_pairs(df, 1, 16).collect()))
    monkeypatch.setattr(spatial, "overlap_pairs", None)
    assert sorted(map(tuple, spatial.overlap_groups(df, expand=1, tile=16).collect())) == want
    assert 1 < len({c for _, c in want}) < 700
    crowd = spark.range(30_000).selectExpr("id AS rect_id", "id % 3 AS l", "id % 2 AS t", "id % 3 + 9 AS r", "id % 2 + 9 AS b")
    assert {r.component for r in spatial.overlap_groups(crowd).collect()} == {0}


@pytest.mark.parametrize("name", ["disjoint_group_items", "rect_merge_expand", "disjoint_count_sets"])
def test_groups_of_rectangles_form_no_pairs(spark, monkeypatch, tmp_path, name):
    folder = parts(tmp_path, [(20_000 * k + j, j % 50) for k in range(4) for j in range(40)])
    monkeypatch.setattr(spatial, "overlap_pairs", None)
    agree(QUERIES[name](spark, folder), geometry.ORACLES[name], folder)


def test_a_tile_cut_into_strips(monkeypatch):
    n = np.arange(60)
    box = np.stack([n * 37 % 41, n * 29 % 43, n * 37 % 41 + n % 7, n * 29 % 43 + n % 5], 1)

    def groups(a, b):
        root = {i: i for i in n}
        for _ in n:
            for x, y in zip(a, b, strict=True):
                root[x] = root[y] = min(root[x], root[y])
        return root

    pairs = [(i, j) for i in n for j in n if (np.maximum(box[i, :2], box[j, :2]) <= np.minimum(box[i, 2:], box[j, 2:])).all()]
    want = groups(*zip(*pairs, strict=True))
    for cells in (1, 90, 1 << 22):
        monkeypatch.setattr(spatial, "GRID_CELLS", cells)
        assert groups(*spatial._touching(n, box)) == want


@pytest.mark.parametrize("side", [1, 4, 64])
def test_codes_are_those_of_their_layers(spark, side):
    """Some images are full, some sparse, one has a pixel outside of the frame."""
    bits = spark.range(3 * side * side).selectExpr("id % 3 AS image_id", f"id div 3 % {side} AS x", f"id div 3 div {side} AS y").filter("image_id = 0 OR (x * 7 + y * y + image_id) % (image_id * 3) < 2 OR y = 0")
    bits = bits.unionAll(spark.createDataFrame([(1, side, 0)], "image_id long, x long, y long"))
    by_layers = shapes.code_bits(shapes.code_layers(bits, side), side)
    assert dict(map(tuple, shapes.codes(bits, side).collect())) == dict(map(tuple, by_layers.collect()))
    assert "BroadcastExchange" not in plan(shapes.codes(bits, side))


@pytest.mark.parametrize("name", ["shapecode_hex", "shapecode_decode", "shapecode_distance", "shapecode_from_hex", "shapecode_topk"])
def test_shape_codes_broadcast_no_cells(spark, monkeypatch, name):
    """Cells of layers are as many as pixels; their size is taken for that of the images."""
    monkeypatch.setattr(shapes, "code_layers", None)
    assert QUERIES[name](spark, SF).count() > 0


def test_outline_pairs_are_not_shuffled(spark):
    """Outlines of up to seven tiles a side, some of them within others, meet as often as counting says."""
    df = spark.range(90).selectExpr("id AS rect_id", "id * 37 % 90 AS l", "id * 53 % 80 AS t").selectExpr("*", "l + rect_id * rect_id % 67 AS r", "t + rect_id * 29 % 61 AS b")
    tiles = spatial.TileMap(100, 100, 10)
    placed = tiles.of_outline(df, Rect.of()).select("tile", "rect_id")
    counted = placed.withColumnRenamed("rect_id", "a").join(placed.withColumnRenamed("rect_id", "b"), "tile").filter("a < b").groupBy("a", "b").count()
    found = tiles.outline_pairs(df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counted.collect()))
    assert "Aggregate" not in plan(found)
