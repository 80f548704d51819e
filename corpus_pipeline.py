"""The corpus pipeline (part of orrery.llm): five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
its decisions take effect: toxic documents go, one document of each text stays, one of
each class of near copies stays, sources are mixed to their target weights (a document
taken twice occurs twice), and the mixture is encoded to pieces. All stages but the last
return the columns of documents. Between stages `run` writes Parquet to the folder that
executors share and reads it again, so a lost executor costs at most a part of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import exactdup, mixing, neardup, pieces, toxicity
from orrery.llm.common import drop_tables, table, tables, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text scores 0.5 or more, by a grammar learned from `labels`; rows with a null id or text are scored like all others."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the one with the least id (a null counts as larger). Null texts are empty."""
    return exactdup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (0.8 over five-word runs): the one with the least id. Texts without words are one class."""
    return neardup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row floor(rate) times and once more by a draw on its id and text, so that sources come near their targets. A null source is a source."""
    return mixing.mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens, decoded_sha256, round_trip."""
    return pieces.tokenised(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Learned toxicity, signatures and pieces are beyond SQL; test_stages and the operators' tests in tests/llm
#: compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = len(tables)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop_tables(spark, mark, docs)  # what the stage left, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
