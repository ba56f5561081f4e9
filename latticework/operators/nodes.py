"""Nodes of candidates: dictionary entries, and unknown words made from templates and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import trie

#: Copies of the entries, where they are too many to be sent to all tasks, so that a frequent word
#: is dealt out to as many tasks.
SALTS = 16


def attached(hits: DataFrame, entries: DataFrame, ids: list[str], surface: str = "surface", how: str = "inner") -> DataFrame:
    """hits with the fields of the entries of their surface, a row for each entry; with how="left"
    hits without one stay. Entries go to all
    tasks if a block of the trie would hold them; else both sides are dealt out by surface and salt."""
    size = entries.agg(F.sum(F.length(surface) + 8 * len(entries.columns))).first()[0] or 0
    if size <= trie.BLOCK:
        return hits.join(F.broadcast(entries), surface, how)
    salted = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("_salt", F.pmod(F.xxhash64(*ids, "start"), F.lit(SALTS)).cast("int")).join(salted, [surface, "_salt"], how).drop("_salt")


def materialised(seeds: DataFrame, templates: DataFrame, fields: list[str]) -> DataFrame:
    """Seeds (maker, surface, ..) with the fields of their maker's template: those that the maker
    overlays hold the surface instead. templates: (maker, <fields>, overlaid array<string>), one
    row for each maker, as template_rows() has it."""
    rows = seeds.join(F.broadcast(templates), "maker")  # a row for each maker
    own = [F.when(F.array_contains("overlaid", f), F.col("surface")).otherwise(F.col(f"_t_{f}")).alias(f) for f in fields]
    return rows.select(*[c for c in seeds.columns if c not in fields], *own)


def template_rows(entries: DataFrame, makers: dict[str, tuple[int, list[str]]], fields: list[str], row_no: str = "row_no") -> DataFrame:
    """The templates of makers, name -> (row number of an entry, fields that hold the surface), for
    materialised(). A maker whose row isn't there is an error where it is used: it has no row."""
    told = entries.sparkSession.createDataFrame([(name, row, over) for name, (row, over) in makers.items()], f"maker string, {row_no} long, overlaid array<string>")
    return entries.join(F.broadcast(told), row_no).select("maker", *[F.col(f).alias(f"_t_{f}") for f in fields], "overlaid")


def normalised(sentences: DataFrame, entries: DataFrame, ids: list[str], fields: list[str], overlaid: tuple[str, ...] = ("surface",)) -> DataFrame:
    """(<ids>, start, end, <fields>, flags): nodes cloned from the entries that a sentence holds in an
    altered spelling. The overlaid fields hold what is written; the others are the entry's."""
    hits = trie.lookup(sentences, entries, ids, alike=True).withColumnRenamed("surface", "_entry")
    rows = attached(hits, entries.withColumn("_entry", F.col("surface")), ids, "_entry")
    return rows.select(*ids, "start", "end", *[(F.col("written") if f in overlaid else F.col(f)).alias(f) for f in fields], "flags")


def unmatched(seeds: DataFrame, entries: DataFrame, template: dict[str, str], overlaid: list[str], surface: str = "surface") -> DataFrame:
    """Seeds but for those whose surface is an entry that agrees with the template in every field
    that isn't overlaid: such a word is in the dictionary already."""
    same = entries
    for f, value in template.items():
        if f not in overlaid and f != surface:
            same = same.where(F.col(f).eqNullSafe(F.lit(value)))
    return seeds.join(same.select(surface).distinct(), surface, "left_anti")
