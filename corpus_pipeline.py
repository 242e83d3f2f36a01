"""From raw documents to token ids: five stages, each a training-data operator.

A stage takes (spark, docs, sf_dir), docs being all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.

Cases: nulls, empty and very long texts, repeated rows, an empty table and further
columns are handled as the operators' docstrings say. A null text counts as an
empty one; documents keep their row even if nothing of their text is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import decontaminate, piece_bpe, simhash, suffix_dedup, toxicity
from changelens.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, 0.8 or more."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are cut out, the first stays."""
    out = suffix_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"), "document")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    import public_tokenizers

    return piece_bpe.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("piece_bpe", encode),
]

#: The stages learn models, follow chains of links and tokenize: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
