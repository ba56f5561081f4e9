"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import cut, marked

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits, as 32 hex digits."""
    return F.md5(text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row for each row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of white space became one space; null text
    counts as empty. keep_id is the smallest id of the equal texts (null ids are passed over;
    null if there is no other), group_size counts their rows. kept holds for exactly one row
    of a group: of rows that repeat both id and text, one is kept. An empty table gives an
    empty result. Other columns of docs are ignored, whatever their names.

    Only ids and hashes of all rows are shuffled. Texts are read again where a hash occurs more
    than once, which a broadcast bitmap of 8 MB tells (and lets a few others through), and are
    grouped by hash and bytes before their shuffle, so a text repeated in a third of all rows
    crosses once for each task. Where one hash has several texts, its rows are matched by their
    bytes; if there is no such hash, as is usual, that step is left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    listed = cut(
        rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("doc_id", "h", "text_sha256")
        .agg(F.count("*").alias("times"))
    )
    groups = cut(
        listed.groupBy("h").agg(
            F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("members")
        )
    )
    repeated = groups.where("group_size > 1").select(F.xxhash64("h").alias("k"))
    texts = marked(rows.withColumn("k", F.xxhash64("h")), "k", repeated).groupBy("h", "norm").agg(F.min("doc_id").alias("text_keep"), F.count("*").alias("text_size"))
    clashing = cut(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    both = listed.join(groups.drop("members"), "h")
    if not clashing.isEmpty():
        some = marked(rows.withColumn("k", F.xxhash64("h")), "k", clashing.select(F.xxhash64("h").alias("k"))).drop("k")
        split = (
            some.groupBy("h", "norm", "doc_id")
            .agg(F.count("*").alias("times"))
            .join(clashing, "h", "left_semi")
            .join(texts.join(clashing, "h", "left_semi"), ["h", "norm"])
            .select("h", "doc_id", F.sha2("norm", 256).alias("text_sha256"), "times", F.col("text_keep").alias("keep_id"), F.col("text_size").alias("group_size"))
        )
        both = both.join(clashing, "h", "left_anti").unionByName(split)
    return both.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
