"""Documents to training sequences in five stages, each one of the operators in matchloom.llm.

1. toxicity: documents scored at the threshold or over go.
2. quality rules: documents that the rules reject go; the others keep their whole text.
3. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.
4. substring dedup: passages of at least 50 words that nearly equal one of an earlier document are cut out.
5. packing: what is left is packed into sequences.

All stages but the last return the columns of documents. Each is written to the shared folder and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table, written
from matchloom.llm.jaccard import jaccard_components
from matchloom.llm.packing import pack
from matchloom.llm.quality import quality_rules
from matchloom.llm.substring import near_duplicate_passages, remove_passages
from matchloom.llm.toxicity import THRESHOLD, fit, score


def _kept(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in keep(doc_id); docs' columns alone."""
    return docs.join(keep.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold. Rows without a doc_id go; of rows that share one, all stay if one does."""
    labels = table(spark, sf_dir, "labels")
    return _kept(docs, score(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line-first rules keep; null and empty texts go."""
    return _kept(docs, quality_rules(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near duplicates; documents without words stay."""
    return _kept(docs, jaccard_components(docs).where("doc_id = component_id"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages that nearly equal one of an earlier document; no row goes."""
    return remove_passages(docs, near_duplicate_passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack_sequences),
]

#: Training a classifier, min-hash candidates and retrieval are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
