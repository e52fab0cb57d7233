"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.llm import fmindex, minmax, pieces, sentences
from sensorium.llm.base import Scratch, table
from sensorium.llm.queries import PIECE_MODEL
from sensorium.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.5 or more; the model learns from four fifths of the labels."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = sentences.train(docs, labels)
    return sentences.with_score(docs, model, result="_score").filter("_score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return minmax.drop_copies(docs, words=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in benchmark windows; the others stay as they are."""
    ship(spark)
    found = fmindex.with_contamination(docs, table(spark, sf_dir, "benchmark"), result="_found")
    return found.filter(~fmindex.contaminated(F.col("_found"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the SentencePiece ids of every document; null texts have null ids."""
    ship(spark)
    return pieces.with_pieces(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express none of the four stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
