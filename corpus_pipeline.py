"""The training-data pipeline: good documents, without near copies, without personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's docs. All but the last give the columns of documents, whatever else they are called.

Null and empty texts are texts without words: scored like any other, copies of each other, without personal data, of size
0 (so the mix takes them only in whole epochs), and one end id long. Rows that repeat id and text are copies and one stays;
rows that repeat an id beside other texts are documents of their own; rows without an id are never taken for copies. Ties
are settled by id, then by hashes. Empty tables give empty tables; without labels every document passes the classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import mixing, nearcopies, packing, pii, quality
from tidewright.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3's SimHash links of five-word shingles, then what they miss, all at a verified Jaccard similarity of .8 or more: one
    document of a group stays."""
    return nearcopies.keep_one(docs, shingle=5, threshold=0.8)


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and what discloses it is replaced; every document stays."""
    return pii.sanitise(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a document comes as often as the mix takes it."""
    return mixing.repeated(docs, mixing.mix(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of sequences, their ids included."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_sanitisation", pii_sanitisation),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: A trained classifier, components and a tokenizer: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
