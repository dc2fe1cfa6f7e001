"""Example tables of rectangles, bitmaps, images and paths, derived from the star schema by integer SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import ship

#: In Spark SQL; other example tables may be named.
TABLES = {
    "fx_rects": """SELECT CAST(p_partkey AS BIGINT) AS rect_id, CAST((p_partkey*37)%997 AS BIGINT) AS l, CAST((p_partkey*91)%1009 AS BIGINT) AS t,
       CAST((p_partkey*37)%997 + p_size%20 + 1 AS BIGINT) AS r, CAST((p_partkey*91)%1009 + p_partkey%15 + 1 AS BIGINT) AS b FROM part""",
    "fx_bits": """SELECT DISTINCT l_orderkey div 300 AS image_id, CAST(l_partkey%40 AS BIGINT) AS x,
       CAST((CAST(l_quantity AS BIGINT)+l_suppkey)%40 AS BIGINT) AS y FROM lineitem""",
    "fx_samples": "SELECT CAST(l_suppkey AS BIGINT) AS grp, CAST(l_quantity AS BIGINT) AS v FROM lineitem",
    "fx_polyline": "SELECT user_id AS path_id, event_id AS x, CAST(floor(value*10) AS BIGINT) AS y FROM events",
    "fx_gray": """SELECT vec_id AS image_id, CAST(pos AS BIGINT) AS pos, CAST(pos%8 AS BIGINT) AS x, CAST(pos div 8 AS BIGINT) AS y,
       least(greatest(CAST(floor((CAST(v AS DOUBLE)+0.6)*200) AS BIGINT),0),255) AS g FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""",
    "fx_rgb": """SELECT a.image_id, a.x, a.y, a.g AS r, b.g AS g, c.g AS b FROM fx_gray a JOIN fx_gray b ON a.image_id=b.image_id AND b.pos=63-a.pos
       JOIN fx_gray c ON a.image_id=c.image_id AND c.pos=(a.pos*7)%64""",
    "fx_color128": """SELECT doc_id AS image_id, x, y, (x*3+y*5+n_chars)%256 AS r, (x*y+doc_id)%256 AS g, (x*x+y)%256 AS b
       FROM documents, (SELECT id AS x FROM range(128)), (SELECT id AS y FROM range(128)) WHERE doc_id < 4""",
}
#: The same in DuckDB's SQL where that differs.
_DUCK = {
    "fx_gray": """SELECT vec_id AS image_id, p AS pos, p%8 AS x, p//8 AS y,
       least(greatest(CAST(floor((CAST(embedding[p+1] AS DOUBLE)+0.6)*200) AS BIGINT),0),255) AS g FROM embeddings, range(64) t(p)""",
    "fx_color128": """SELECT doc_id AS image_id, x, y, (x*3+y*5+n_chars)%256 AS r, (x*y+doc_id)%256 AS g, (x*x+y)%256 AS b
       FROM documents, range(128) a(x), range(128) b(y) WHERE doc_id < 4""",
    # DuckDB rounds a cast from double; quantities and keys are whole numbers
    "fx_bits": """SELECT DISTINCT l_orderkey // 300 AS image_id, CAST(l_partkey%40 AS BIGINT) AS x, CAST((CAST(l_quantity AS BIGINT)+l_suppkey)%40 AS BIGINT) AS y FROM lineitem""",
}
_BASE = ("part", "lineitem", "events", "embeddings", "documents")
#: Width and height of the example bitmaps.
SIDE = 40


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The example table ``name``, computed from the Parquet files in ``sf_dir``."""
    ship(spark)
    sql = TABLES[name]
    for other in TABLES:
        if other != name and re.search(rf"\b{other}\b", sql):
            sql = re.sub(rf"\b{other}\b", f"({_inlined(other, sf_dir)})", sql)
    return spark.sql(_with_files(sql, sf_dir))


def _inlined(name: str, sf_dir: str) -> str:
    return _with_files(TABLES[name], sf_dir)


def _with_files(sql: str, sf_dir: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(_BASE)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql)


def duck_with(*names: str) -> str:
    """``name AS (...)`` clauses for DuckDB, to stand after WITH."""
    return ",\n".join(f"{n} AS ({_DUCK.get(n, TABLES[n])})" for n in names)
