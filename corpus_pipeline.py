"""A training corpus from raw documents: five stages, each one operator of ``tessera.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``. An empty table passes every stage
as an empty table; extra columns pass the first four stages.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, packing, pii, simhash_golay, tokens, toxicity
from tessera.session import drop_path, prepare_session, scratch_path
from tessera.sources.tables import read_table

#: A deployment passes its own secret.
PII_KEY = "corpus-pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


#: Ids that are broadcast at most, as 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids``; texts are not shuffled while the ids are few."""
    ids = ids.checkpoint()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays, once.

    A document without an id can't be named and stays; one that repeats its id is kept once."""
    found = simhash_golay.near_duplicates(docs, shingle=3, max_bits=3).where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    out = without(docs, gone)
    if twice.isEmpty():
        return out
    one = out.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return without(out, twice).unionAll(one)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; ``n_chars`` follows the new text."""
    out = pii.replace(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, functools.partial(tokens.encoder_for, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_surrogates", replace_personal_data),
    ("vector_packing", pack_sequences),
]

#: SQL has no classifier fit, XXH64 with a seed or tokenizer: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table. A stage's folder goes when the next one's is written."""
    prepare_session(spark)
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return docs
