"""Sources: sentences with comments, tokens, gold corpora, partial annotations, dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.sources.dictionary import quoted


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent, text): the lines of each text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("sent", "text"))


def with_comments(lines: DataFrame) -> DataFrame:
    """(doc_id, sent, comment, text): a line that begins with `# ` and is longer than that is the
    comment of the next other line. lines: (doc_id, sent, text)."""
    is_comment = F.col("text").startswith("# ") & (F.length("text") > 2)
    before = F.lag(F.when(is_comment, F.substring("text", 3, 1 << 30))).over(Window.partitionBy("doc_id").orderBy("sent"))
    return lines.withColumn("comment", before).where(~is_comment).select("doc_id", "sent", "comment", "text")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, pos, start, end, surface): words between spaces; start and end count the
    characters of the sentence without its spaces, so tokens tile it."""
    line = F.col("text")
    words = F.filter(F.split(line, " "), lambda w: w != "")
    rows = sentences(docs).select("doc_id", "sent", words.alias("w")).where("size(w) > 0").select("doc_id", "sent", "w", running_ends("w").alias("e"))
    return rows.select("doc_id", "sent", F.posexplode(F.arrays_zip("w", "e")).alias("pos", "t")).select("doc_id", "sent", "pos", (F.col("t.e") - F.length("t.w")).alias("start"), F.col("t.e").alias("end"), F.col("t.w").alias("surface"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _running_ends(words: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.utf8_length(words.flatten()), 0).to_numpy().astype(np.int64)
    offsets = words.offsets.to_numpy() - (words.offsets[0].as_py() if len(words.offsets) else 0)
    sums = np.concatenate(([0], sizes.cumsum()))
    ends = sums[1:] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ends.astype(np.int32)))


def running_ends(words: str) -> Column:
    """Ends of words that follow one another, as array<int>; null has none."""
    return _running_ends(F.coalesce(F.col(words), F.array().cast("array<string>")))


def spans(words: str, ends: str) -> Column:
    """array<struct<start, end, surface>> of words that follow one another and their running_ends()."""
    return F.transform(F.arrays_zip(words, ends), lambda t: F.struct((t[ends] - F.length(t[words])).alias("start"), t[ends].alias("end"), t[words].alias("surface")))


def gold_tokens(lines: DataFrame, fields: list[str], separator: str = "_") -> DataFrame:
    """(doc_id, sent, comment, pos, <fields>) of lines `a_b_c d_e_f # comment`: tokens by space,
    fields by separator. A token with too few fields has nulls for the rest."""
    body, comment = F.split("text", " # ", 2), F.get(F.split("text", " # ", 2), F.lit(1))
    rows = lines.select("doc_id", "sent", comment.alias("comment"), F.posexplode(F.filter(F.split(F.get(body, F.lit(0)), " "), lambda w: w != "")).alias("pos", "token"))
    parts = F.split("token", quoted(separator))
    return rows.select("doc_id", "sent", "comment", "pos", *[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def gold_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, sent, <fields>) of a corpus with one word a line as CSV; `EOS` or an empty line
    ends a sentence, `# ` lines are comments. lines: (doc_id, sent, text), sent being the line."""
    ends = ((F.col("text") == "EOS") | (F.col("text") == "")).cast("int")
    w = Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.select("doc_id", "sent", "text", F.coalesce(F.sum(ends).over(w), F.lit(0)).alias("sentence"), ends.alias("end"))
    kept = numbered.where((F.col("end") == 0) & ~F.col("text").startswith("# "))
    parsed = kept.withColumn("row", F.from_csv("text", F.lit(", ".join(f"{f} string" for f in fields)), {"quote": '"', "escape": '"'}))
    return parsed.select("doc_id", "sentence", F.col("sent").alias("line"), "row.*")


def partial_examples(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, comment, surface, must_break, no_break, nodes) of partially annotated paragraphs
    (doc_id, text): a line is a stretch between sure breaks, `&` in it marks where none may be;
    a line that begins with a tab is a whole word and its `field:value` tags."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    comment = F.get(F.transform(F.filter(lines, lambda x: x.startswith("# ")), lambda x: F.substring(x, F.lit(3), F.length(x))), F.lit(0))
    body = F.filter(lines, lambda x: ~x.startswith("# "))
    bare = lambda x: F.when(x.startswith("\t"), F.get(F.split(x, "\t"), F.lit(1))).otherwise(F.replace(x, F.lit("&"), F.lit("")))
    rows = paragraphs.select("doc_id", comment.alias("comment"), body.alias("body"), F.transform(body, bare).alias("parts")).where("size(body) > 0")
    rows = rows.withColumn("ends", running_ends("parts"))
    start = lambda i: F.coalesce(F.get(F.col("ends"), i - 1), F.lit(0))
    glued = F.flatten(F.transform("body", lambda x, i: F.when(x.startswith("\t"), F.array().cast("array<int>")).otherwise(within(x, start(i)))))
    tagged = F.filter(
        F.transform(
            "body",
            lambda x, i: F.struct(
                start(i).alias("boundary"),
                F.length(F.get(F.col("parts"), i)).alias("length"),
                F.get(F.col("parts"), i).alias("surface"),
                F.when(x.startswith("\t"), F.transform(F.slice(F.split(x, "\t"), 3, 1000), lambda t: F.struct(F.substring_index(t, ":", 1).alias("field"), F.substring(t, F.locate(":", t) + 1, F.length(t)).alias("value")))).alias("tags"),
            ),
        ),
        lambda n: n["tags"].isNotNull(),
    )
    return rows.select("doc_id", "comment", F.array_join("parts", "").alias("surface"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))).alias("must_break"), glued.alias("no_break"), tagged.alias("nodes"))


def within(line: Column, start: Column) -> Column:
    """Positions of the `&` of a line, counted without them."""
    parts = F.split(line, "&")
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, w: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(w))))
    return F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda e: e + start)


def key_values(text: Column, separator: str = " ", colon: str = ":") -> Column:
    """array<struct<k, v>> of a key[:value] list; keys may repeat, a missing value is null."""
    items = F.filter(F.split(text, quoted(separator)), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.substring_index(x, colon, 1).alias("k"), F.when(F.locate(colon, x) > 0, F.substring(x, F.locate(colon, x) + len(colon), F.length(x))).alias("v")))
