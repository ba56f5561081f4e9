"""Dictionaries: encoding, aliasing, matching, prefixes, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, count, id): distinct non-empty values, numbered from 1 by falling count, then by
    value. The sort is by ranges; a partition's numbers start after those of the ones before,
    whose sizes are a row each, so no task holds the whole vocabulary."""
    counted = values.where(F.col(value) != "").groupBy(F.col(value).alias("value")).count()
    ordered = counted.orderBy(F.desc("count"), "value").withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.select("value", "count", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"))
    ordered = ordered.persist()  # sizes and numbers must be of the same partitions
    sizes = ordered.groupBy("part").agg((F.max("own") + 1).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return ordered.join(before, "part").select("value", "count", (F.col("before") + F.col("own") + 1).alias("id"))


def alias(entries: DataFrame, keys: list[str], data: list[str], row_no: str) -> DataFrame:
    """Entries with equal keys as one, its data columns in a list ordered by row number."""
    rows = F.array_sort(F.collect_list(F.struct(row_no, *data)))
    return entries.groupBy(*keys).agg(F.min(row_no).alias("first_row"), F.count("*").alias("n_aliases"), rows.alias("aliases"))


def split_templates(entries: DataFrame, row_no: str, rows: list[int]) -> tuple[DataFrame, DataFrame]:
    """(templates, entries without them)."""
    is_template = F.col(row_no).isin(rows)
    return entries.where(is_template), entries.where(~is_template)


def match_any(items: Column, values: list[str]) -> Column:
    """1 if the list has one of the values."""
    return F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, values))).cast("int"), F.lit(0))


def match_rows(entries: DataFrame, table: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """entries with a column `bit`, 1 where their keys are a row of the table."""
    return entries.join(table.select(*keys).distinct().withColumn(bit, F.lit(1)), keys, "left").fillna(0, [bit])


def field_ids(tokens: DataFrame, known: DataFrame, field: str) -> DataFrame:
    """tokens with `id`: that of their field in known (value, id), or, for a value it hasn't,
    below zero, -1 - k for the k-th unknown value (from 1, the frequent ones first)."""
    of = tokens.withColumnRenamed(field, "value")
    unknown = encode(of.join(known.select("value"), "value", "left_anti")).select("value", (-1 - F.col("id")).alias("id"))
    return of.join(known.select("value", "id").unionByName(unknown), "value").withColumnRenamed("value", field)


def with_ids(rows: DataFrame, table: DataFrame, name: str, id_name: str) -> DataFrame:
    """rows with the number that a table (<name>, id) has for their name, 0 if it has none. Spark
    sends the table to all tasks if it is small enough."""
    return rows.join(table.select(name, F.col("id").alias(id_name)), name, "left").fillna(0, [id_name])


def prefixes(words: DataFrame, word: str = "surface") -> DataFrame:
    """(prefix, is_word): all proper and improper prefixes of the words."""
    each = words.select(F.col(word).alias("w"), F.explode(F.sequence(F.lit(1), F.length(word))).alias("n"))
    return each.groupBy(F.substring("w", F.lit(1), F.col("n")).alias("prefix")).agg(F.max((F.length("w") == F.col("n")).cast("int")).alias("is_word"))


def windows(sentences: DataFrame, ids: list[str], width: int, text: str = "text", where=None) -> DataFrame:
    """(<ids>, start, ahead): for each character, or those for which where(ch) holds, the
    `width` characters from it on. Rows carry that much text, never the whole sentence."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    rows = sentences.where(F.length(text) > 0).select(*ids, chars.alias("_c"))
    every = F.sequence(F.lit(0), F.size("_c") - 1)
    some = every if where is None else F.filter(every, lambda i: where(F.get(F.col("_c"), i)))
    cut = F.transform(some, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("_c", i + 1, F.lit(width)), "").alias("ahead")))
    return rows.select(*ids, F.explode(cut).alias("_w")).select(*ids, "_w.start", "_w.ahead")
