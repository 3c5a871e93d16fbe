"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import exact_dedup, mixing, ngram_join, packing, quality_classifier
from weirflow.llm.common import table, written
from weirflow.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant does not reject, with their own columns.

    Every row is judged by its own text; a null or empty one is judged as an empty text, rows that repeat alike. Without labels of both kinds all rows get one score.
    """
    return quality_classifier.good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space, with its own columns.

    The longest text stays, of those the smallest doc_id (a null one last). Null and empty texts are one group. Rows that repeat doc_id and text count as one.
    """
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more), with its own columns.

    The smallest doc_id stays (a null one last), of ties the least hash of doc_id and text. Rows without words all stay; they are like nothing.
    """
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: a row for each time, and one with the words of chosen blocks where those are not all.

    A null source is a source of its own. Rows without words are never taken. Rows that agree in doc_id and text are taken alike.
    """
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows that repeat a doc_id are packed each; a null or empty text is the end id alone.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Stages that learn, link, mix and pack are beyond SQL; tests compare the exact and near stages with brute force, and the others by their operators' tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is a table in the shared folder, and the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
