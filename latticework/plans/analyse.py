"""From sentences to formatted output in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import formats, search, trie

#: Output formats by name: (tokens, ids) -> (<ids>, out).
FORMATS = {
    "segmented": lambda t, ids: formats.segmented(t, ids),
    "morph": lambda t, ids: formats.morph(t, ids, ["surface", "kind"]),
    "columns": lambda t, ids: formats.columns(t.withColumn("alias_no", F.lit(0)), ids, ["kind"]),
}
ERROR = "# ERROR\nEOS\n"
MOST_BYTES = 4096


def analyse(sentences: DataFrame, words: DataFrame, ids: list[str], output: str = "segmented", most_bytes: int | None = None) -> DataFrame:
    """(<ids>, out) of sentences (<ids>, text) over the words (surface). A null sentence, and
    with most_bytes one that is longer, gets the error output instead; an empty one none."""
    fits = F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes if most_bytes else F.lit(True))
    good = sentences.where(fits)
    tokens = search.segment(trie.with_edges(good, words, ids), ids)
    bad = sentences.where(~fits).select(*ids, F.lit(ERROR).alias("out"))
    return FORMATS[output](tokens, ids).unionByName(bad)


def penalised(score: Column, violation: Column) -> Column:
    """A connection's score less what the constraint it breaks costs."""
    return score - F.when(violation == "none", 0).when(violation == "tag", 1000).otherwise(10000)
