"""From raw documents to token ids: rules, classifier, near-dedup, mixing, segmentation.

Every stage takes all rows its predecessor kept and decides for itself; ``run`` writes each stage's
rows to the shared folder and reads them back as the next one's documents. All but the last return the
columns of ``documents``; the last adds piece_ids, n_pieces, score and margin.

Defined cases: NULL and empty texts fail the base rules and go in the first stage; very long texts are worked on
whole; rows that repeat an id are judged row by row, and near_dedup keeps one of those with the same fingerprint;
an empty table stays empty through all stages; extra columns are carried to the end, but for those named like the
columns that the last stage adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import staged, table
from drayline.llm.mixing import mixed_documents
from drayline.llm.quality_classifier import keep_predicted, train
from drayline.llm.quality_rules import keep_good
from drayline.llm.segmentation import SegmentOptions, with_segments
from drayline.llm.simhash import SimhashOptions, one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the rules call good."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more, by a model of at most ``sample_rows`` labelled documents.

    Those are drawn outside the held-out fold, documents that the rules rejected included.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return keep_predicted(docs, train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents connected by SimHash fingerprints of three-word shingles at 2 or fewer bits the one with the least id."""
    return one_of_each(docs, SimhashOptions(words=3, distance=2))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed by weights 5, 2, 1 to 150% of all words; a document comes twice at most."""
    return mixed_documents(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their best segmentation."""
    # workers live on through all stages: what they remember is kept small
    return with_segments(docs, SegmentOptions(remembered=24 << 20))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("segmentation", segmentation),
]

#: Fits, near-duplicate search and segmentation can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
