"""Helpers that several corpus operators share: tables, lineage cuts, salted ranks, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir.  Only a local session without the setting gets a new one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    marked = F.regexp_replace(plain_text(name), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.regexp_replace(marked, SPACE, "")).cast("long")


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt_from: list[str], name: str,
                rows_per_salt: int = 100_000) -> DataFrame:
    """Adds a gapless number from 0 within keys, without gathering a hot key in one task.

    Rows of a key are spread by a hash of salt_from over as many salts as the table's size asks for; each salt is
    numbered by `order` and starts where the salts before it end.
    """
    salts = max(1, -(-df.count() // rows_per_salt))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)))
    names = [*keys, "_salt"]
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*names).agg(F.count("*").alias("_n"))
    starts = counts.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(names)],
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    condition = F.lit(True)
    for i, k in enumerate(names):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    within = Window.partitionBy(*names).orderBy(*order)
    return (salted.join(starts, condition)
            .withColumn(name, F.row_number().over(within) - F.lit(1) + F.col("_start"))
            .select(*df.columns, name))
