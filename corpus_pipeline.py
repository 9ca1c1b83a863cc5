"""A training-data pipeline of five stages, each one operator of threadloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written
as Parquet and read again.

Defined results: a null, empty or short text fails the quality rules and goes; rows with a null
doc_id stay in the near-duplicate stage, and a null source is a source of its own in the mix;
repeated rows are rows of their own until the near-duplicate stage, which keeps all rows of the
smallest doc_id of a group; texts of any length are taken whole; an empty table gives an empty
table.  All stages but the last return the columns of documents, whatever these are besides
doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import line_dedup, mixing, ngram_join, quality, sentencepiece_codec
from threadloom.llm._common import Scratch, documents
from threadloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents share; n_chars is counted again."""
    return line_dedup.filter_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, and the text that they decode to."""
    coded = sentencepiece_codec.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_pieces", "pieces_crc32", "piece_ids", "decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The n-gram sets, the Newton steps and the Viterbi search are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
