"""From raw documents to packed sequences: language ID, near copies, repeated passages, benchmarks, packing.

Each stage works on all that the one before it kept. Its result is written as Parquet and read again as the next
one's docs, so a stage begins by dropping the tables that the stage before it left in the shared folder.

Defined results of every stage: an empty table gives an empty one. All columns but ``text`` (and ``n_chars`` where
repeats are cut) come out as they went in, whatever their names, until the last stage, which returns pieces. Nulls:
documents without a text or a letter go in the first stage; rows without an id are kept by each stage as rows of
their own; a null source is packed as the queue ''. Repeated rows: of one id and text, all are cut alike; of
equal texts, the one with the smallest id stays. Whole texts are read, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, jaccard, langid, packing, repeats
from millrace.llm.batches import bound_batches
from millrace.llm.registry import tokenizer_path
from millrace.plans import scratch
from millrace.plans.scratch import table

OWNER = "corpus_pipeline"


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop_tables(spark, OWNER)
        bound_batches(spark, 4)
        with scratch.owned_by(OWNER):
            return f(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the labelled ones are in, null texts and texts without a letter."""
    return langid.drop_unknown(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five words, similarity of 0.8)."""
    return jaccard.drop_near_copies(docs)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that start earlier in the corpus from the texts; n_chars follows."""
    kept = repeats.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


@_stage
def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, sources in their natural mixture."""
    return packing.pack_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("benchmarks", drop_benchmarks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder; the rows of the last. A stage's copy goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch.shared_dir(spark)}/millrace/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Not for SQL: the language model and the sorted merge can't be told in it. tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
