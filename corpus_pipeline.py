"""A corpus from raw documents to packed sequences, stage by stage.

Each stage reads the table that the stage before it wrote.  All but the last keep the columns of
documents; extra columns pass through, whatever their names.

Edge cases: documents without text or words are never toxic, contaminated or copies, and are packed
as their end id alone; very long texts are read whole; a score of exactly 0.5 rejects; of a group of copies
the smallest doc_id stays, among rows that share a doc_id, or have none, the first row of each group; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaicore.llm import decontaminate, neardup, packing, pii, toxicity
from mosaicore.llm.common import discard, place_of, table, tables_since, written
from mosaicore.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: two-word shingles, as in op3_near_duplicates, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, n=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of 13 words of a benchmark item occurs go, however long they are.

    So do those with shorter items in a twentieth of their words or more; from others the shorter items are cut out.
    """
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), whole_windows=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; every document stays."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet and read again; what a stage wrote besides is deleted."""
    before = len(tables_since())
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, *(path for path in tables_since(before) if path != place_of(docs)))
    return docs


#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None
