"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; between stages the
documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, lang_id, line_dedup, minhash_dedup, mixing
from gridloom.llm.common import crc_mod, materialise, quoted, table
from gridloom.llm.queries import PATTERN, VOCABULARY
from gridloom.session import ship


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator's own columns have, so that further columns pass through whatever they are called."""
    return docs.toDF(*(f"in_{c}" for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language's model accepts; the models learn from a bounded labelled sample of ``docs``.

    Documents without a letter, null texts among them, are not accepted by any. Rows that repeat are judged alike.
    Without any labelled text nothing is known to be a language, and all go; an empty table stays empty.
    """
    ship(spark)
    model = lang_id.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    judged = lang_id.classify(_apart(docs), model, text_col="in_text").filter("lang_accepted")
    return judged.select(*(F.col(quoted(f"in_{c}")).alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that ten documents or more share out of all of them; the documents stay, ``n_chars`` is counted anew.

    Null texts stay null, with null ``n_chars``. Rows that repeat id and text are one document here and lose the same lines.
    """
    ship(spark)
    out = line_dedup.deduplicate(_apart(docs), "in_doc_id", "in_text").withColumn("in_n_chars", F.length("in_text").cast("long"))
    return out.select(*(F.col(quoted(f"in_{c}")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of smallest id, and of rows that repeat it one.

    Null, empty and blank texts are no duplicates of each other. Null ids come after all others.
    """
    ship(spark)
    return minhash_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them: not at all, once or twice.

    Texts without words, null ones too, are not taken. A null source is a source. Repeated rows count each.
    """
    ship(spark)
    return mixing.mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back.

    A null text counts as empty. Every row is encoded on its own; an empty table gives an empty one.
    """
    ship(spark)
    ids = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, PATTERN, decoded_col="decoded")
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Language models, sampled sketches and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
