"""The corpus pipeline: documents without toxic ones, with one of each group of near
copies, without repeated passages and benchmark items, packed into batches.

Each stage is (name, function(spark, docs, sf_dir)); all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared
folder and reads it again, so a stage depends on stored rows only; a stage's table is
deleted when the next one is stored.

Odd rows: null and empty texts pass the first four stages (they have no words, no
copies and no passages) and are packed with length 0; of rows that repeat an id and a text
one stays; null ids come last where ids decide; null labels do not teach and null items
match nothing; empty tables give no rows; further columns are kept as they are, whatever
their names. The last stage keeps doc_id and the assignments, not the text.
"""

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, packing, set_join, substring_dedup, toxicity
from strandloom.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return set_join.first_of_groups(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that occur earlier lose their words."""
    return substring_dedup.rewrite(docs, width=50)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        kept: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), name, kept)
        discard(spark, before)
        before = kept
    return docs
