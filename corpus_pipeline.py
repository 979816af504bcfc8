"""From documents to tokens: the operators of provenant.llm, one stage after the other.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and
returns documents with the same columns; the last one returns the encoding of each document. Nulls, empty
texts and repeated rows follow the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import decontamination, jaccard, linededup, sentencepieces, toxicity
from provenant.llm.common import prepared, scratch, staged, table, tokenizer_file
from provenant.llm.queries import PIECE_MODEL

REJECTED_FROM = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    named = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    with scratch(spark):
        scorer = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
        scored = toxicity.score(named, scorer, keep=["doc_id", "version"])
        # A score depends on the text alone, so rows with one id and text stay or go together.
        rejected = scored.where(F.col("score") >= REJECTED_FROM).select(F.col("doc_id").alias("i"), F.col("version").alias("v")).distinct()
        rejected = staged(rejected, "rejected", keep=True)
    here = F.col("d.doc_id").eqNullSafe(F.col("r.i")) & (F.xxhash64("d.text") == F.col("r.v"))
    return docs.alias("d").join(rejected.hint("merge").alias("r"), here, "left_anti").select([F.col(f"d.`{c}`") for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return linededup.cleaned(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return jaccard.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return sentencepieces.digests(docs, tokenizer_file(PIECE_MODEL))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL cannot express the models of the first and last stages; the tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
