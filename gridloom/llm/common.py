"""Shared plumbing of the corpus operators: scratch tables, Arrow mapping and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.scratch import materialise, release, temporary  # noqa: F401
from gridloom.session import ship

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a batch that Python workers work on at once, about.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``names`` (Spark compares without case)."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def position(df: DataFrame, name: str) -> int:
    """Place of a column, its name compared without case as Spark does."""
    return [c.lower() for c in df.columns].index(name.lower())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has: ``names``, lengthened where one is taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def slices(b: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes, a row at least."""
    rows = max(1, len(b) * size // max(1, b.nbytes)) if len(b) else 1
    for at in range(0, len(b), rows):
        some = b.slice(at, rows)
        # rows of very different length: halve what is still too large
        if len(some) > 1 and some.nbytes > 4 * size:
            yield from slices(some, size)
        else:
            yield some


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Adds columns computed from Arrow batches; an input column of the same name is replaced.

    ``make`` runs once per task and returns a function from a batch to the new arrays. It gets batches of a few
    megabytes, and one text at a time where texts are longer, so that memory does not depend on the data.
    """
    keep = without(df, [f.name for f in fields])
    at = [df.columns.index(c) for c in keep]
    schema = T.StructType([df.schema[i] for i in at] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *step(b)], names=schema.names)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8: bytes.lower and bytes.split act on ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
