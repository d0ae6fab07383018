"""A corpus pipeline: toxic texts, copies and near copies go, sources are mixed to weights, and the rest is packed.

Each stage gets what the stage before it kept, as a table, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import cut, table
from cellweave.llm.exact_dedup import keep_first
from cellweave.llm.mixing import mixed
from cellweave.llm.near_dedup import keep_representatives
from cellweave.llm.packing import pack
from cellweave.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models do not call toxic."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies, the document with the smallest id."""
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document comes as often as the mix uses it, at most three times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
                                   ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the models of the first stage nor the packing of the last; tests compare with brute force.
ORACLE_SQL: str | None = None


#: Rows of an Arrow batch at most: several stages send whole texts to Python, two batches at a time for each task.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written as Parquet and read again.

    Lowers the session's rows of an Arrow batch to ROWS, which bounds an executor's memory beside its heap.
    """
    given = int(spark.conf.get(BATCH_ROWS))
    if given <= 0 or given > ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
