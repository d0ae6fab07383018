"""Exact duplicates: frequent digests leave map-side, the others are shuffled.

A Misra-Gries summary (Spark's freqItems, at most 1/support entries) finds every digest that may hold more than
`support` of the rows.  These candidates are counted exactly, and the verified ones with their winners are
broadcast: their copies are settled without a shuffle, however hot a group is.  All other digests are grouped and
joined by ordinary shuffles, in which no group can exceed `support` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import SPACE, cut, plain_text


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(plain_text(text), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space became one space; null counts as
    empty.  The row with the smallest id stays; null ids come after all others, and of rows that share the
    smallest id exactly one is kept.  An empty table gives an empty result.  Columns besides id and text are ignored.
    """
    hashed = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "digests")
    # at most 1/support rows of 32 bytes, whatever the input
    candidates = hashed.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    winners = (hashed.join(F.broadcast(candidates.distinct()), "digest")
               .groupBy("digest").agg(first, F.count("*").alias("group_size"))
               .filter(F.col("group_size") > 1))
    winners = cut(winners, "winners")
    frequent = hashed.join(F.broadcast(winners), "digest")
    others = hashed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = others.groupBy("digest").agg(first, F.count("*").alias("group_size"))
    settled = frequent.unionByName(others.join(groups, "digest"))
    return settled.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs (all columns) that stay."""
    kept = exact_dedup(docs, id_col, text_col, **options).filter("kept").select(
        F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    own = F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256))
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("own_id"), own.alias("own"))
    found = marked.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left_semi")
    one = F.row_number().over(Window.partitionBy("own_id", "own").orderBy("own"))
    return found.withColumn("nth", one).filter("nth = 1").select("doc.*")
