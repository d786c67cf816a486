"""From raw documents to token ids: a pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns that came in; the last returns token ids and their digests.  ``run``
writes the result of each stage as Parquet to the shared folder, reads it as the
next one's input, and drops what no later stage reads.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptrace.llm import bpe, decontam, langid, quality, simhash
from cliptrace.llm.common import cut, documents, fresh, remove, scratch, shared_dir
from cliptrace.llm.queries import GOOD, digests, language_model, quality_model

#: Documents whose language has at least this posterior stay.
SURE = 0.5
#: Words of a shingle, and bits in which fingerprints of near-duplicates may
#: differ: 0.906 of all bits agree.
NEAR_WORDS, NEAR_BITS = 5, 6


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones.  Null and
    empty texts are scored like any other; repeated rows stay or go together; an
    empty table stays empty."""
    model = quality_model(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels").select("doc_id", "quality"))
    name = fresh(docs, "_score")
    return quality.score(docs, model, out=name).filter(F.col(name) >= GOOD).drop(name)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; what has no letters (null and empty
    texts too), or is of no language for sure, goes.  Repeated rows stay or go
    together; an empty table stays empty."""
    model = language_model(docs.select("doc_id", "text", "lang"))
    name, sure = fresh(docs, "_lang"), fresh(docs, "_sure")
    judged = langid.identify(docs, model, name=name, score=sure)
    return judged.filter((F.col(name) != langid.UNDETERMINED) & (F.col(sure) >= SURE)).drop(name, sure)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of five-word
    shingles that differ in at most ``NEAR_BITS`` bits, and what these link):
    the one with the smallest id, and of several such rows the first.  Null and
    empty texts are one group, a null id comes last; an empty table stays empty."""
    row, fp = fresh(docs, "_row"), fresh(docs, "_fp")
    # Rows are numbered in a written table: the numbers never change.
    numbered = cut(simhash.with_fingerprint(docs, out=fp, width=NEAR_WORDS).withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.classes(numbered.select(F.col(row).alias("_key"), F.col(fp).alias("fp"), F.col("doc_id").alias("_id")), NEAR_BITS)
    first = F.min(F.struct(F.col("_id").isNull(), "_id", F.col("_key").alias("at")))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first.at").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row, fp)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited.  Null and empty
    texts hold none; repeated rows stay or go together; an empty table, and an
    empty benchmark, leave all as it is."""
    name = fresh(docs, "_matches")
    return decontam.find(docs, documents(spark, sf_dir, "benchmark"), out=name).filter(F.size(name) == 0).drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text that
    they decode to.  A null text is an empty one; all rows stay."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = digests(bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: The classifier, the hashes and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
