"""All candidates of sentences, in two stages: makers of low priority only where the others, with
the dictionary, don't lead from a sentence's start to its end."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.chars import classes_of
from latticework.operators import nodes, search, seeds, trie


@dataclass(frozen=True)
class Maker:
    """A maker of unknown words. kind: single, chunk, numeric, onomatopoeia or normalize; classes: of
    the characters that it takes; price: of its words on a path; low: for the second stage. template:
    fields of a number's template with their values, overlaid those that hold the surface: a
    number that is a word is made too if no entry of the word agrees with the template."""

    name: str
    kind: str
    classes: str = ""
    price: int = search.OTHER_COST
    low: bool = False
    template: tuple[tuple[str, str], ...] = ()
    overlaid: tuple[str, ...] = ()


def made(maker: Maker, sentences: DataFrame, words: DataFrame, ids: list[str]) -> DataFrame:
    """(<ids>, start, end, surface, flag) of a maker's words. flag: whether the word begins no
    dictionary word, or the changes of an altered spelling."""
    if maker.kind == "single":
        rows = seeds.single(sentences, words, ids, maker.classes).withColumnRenamed("not_prefix", "flag")
    elif maker.kind == "chunk":
        rows = seeds.chunks(sentences, words, ids, maker.classes).withColumnRenamed("not_prefix", "flag")
    elif maker.kind == "numeric":
        found = seeds.numbers(sentences, ids, words)
        rows = found.where("not_prefix >= 0")
        if maker.template:
            other = nodes.unmatched(found.where("not_prefix < 0"), words, dict(maker.template), list(maker.overlaid))
            rows = rows.unionByName(other.withColumn("not_prefix", F.lit(0)))
        rows = rows.withColumnRenamed("not_prefix", "flag")
    elif maker.kind == "onomatopoeia":
        rows = seeds.onomatopoeia(sentences, words, ids, maker.classes).withColumn("flag", F.lit(0))
    elif maker.kind == "normalize":
        rows = trie.lookup(sentences, words, ids, alike=True).drop("surface").withColumnsRenamed({"written": "surface", "flags": "flag"})
    else:
        raise ValueError(f"no maker is called {maker.kind}")
    return rows.select(*ids, "start", "end", "surface", "flag")


#: How makers find their words where the sentences are: kind -> (classes -> finder).
FINDERS = {"single": seeds.singles_of, "chunk": seeds.chunks_of, "numeric": lambda classes: seeds.numbers_of, "onomatopoeia": seeds.twice_of, "normalize": lambda classes: seeds.altered}


def _added(lattices: DataFrame, text: str, makers: list[Maker], wanted: list[int], words: DataFrame, ids: list[str]) -> DataFrame:
    """lattices with the words that the wanted makers find in the column text among their edges. Only
    those of a maker with a template are joined; the others come without a shuffle."""
    for k in wanted:
        m = makers[k - 1]
        told = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(m.price).alias("price"), F.lit(k).alias("maker"), e["flag"].alias("flag"))  # noqa: B023, E731
        if m.template:
            rows = made(m, lattices.select(*ids, F.col(text).alias("text")), words, ids)
            grouped = rows.groupBy(*ids).agg(F.collect_list(F.struct("start", "end", F.col("flag").cast("int").alias("flag"))).alias("_made"))
            found = lattices.join(grouped, ids, "left").withColumn("_made", F.coalesce("_made", F.array().cast("array<struct<start:int,end:int,flag:int>>")))
        else:
            found = seeds.listed(lattices, words, FINDERS[m.kind](m.classes), text, "_made")
        lattices = found.withColumn("edges", F.concat("edges", F.transform("_made", told))).drop("_made")
    return lattices


def _at_once(sentences: DataFrame, block: trie.Block, makers: list[Maker], ids: list[str], price: int) -> DataFrame:
    """candidates() of sentences (<ids>, text) in one pass, for a dictionary of one block: a task has one
    process for all makers, which hold their words as arrays until a stretch of sentences is done."""
    shared = sentences.sparkSession.sparkContext.broadcast(block)
    names = ("start", "end", "price", "maker", "flag")

    def each(batches):
        block = shared.value
        for batch in batches:
            for low, begins, codes in trie.texts_of(batch, "text"):
                start, end, _ = block.trie.walk(codes)
                found = [np.stack((start, end, np.full(len(start), price), 0 * start, 0 * start))]
                connects = None
                for late in (False, True):
                    if connects is not None:  # only what doesn't connect is left to the others
                        codes = np.where(np.repeat(connects, np.diff(begins)), 0, codes)
                    kinds = np.where(codes > 0, classes_of(codes), 0)
                    for k, m in enumerate(makers, 1):
                        if m.low == late and codes.any():
                            start, end, flag = FINDERS[m.kind](m.classes)(block, codes, kinds)
                            found.append(np.stack((start, end, np.full(len(start), m.price), np.full(len(start), k), flag)))
                    each_ = [x[:, np.lexsort((x[1], x[0]))] for x in found]
                    every = np.concatenate(each_, axis=1).astype(np.int64)
                    row = np.searchsorted(begins, every[0], side="right") - 1
                    every[:2] -= begins[row]
                    connects = search.connecting(begins, row, every[0], every[1])
                    if connects.all():
                        break
                order = np.argsort(row, kind="stable")
                offsets = np.searchsorted(row[order], np.arange(len(begins))).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int32)) for x in every], names=names)
                part = batch.slice(low, len(begins) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(connects)], names=[*part.schema.names, "edges", "connects"])

    kind = ",".join(f"{n}:int" for n in names)
    return sentences.mapInArrow(each, f"{trie.schema_of(sentences, ids)}, text string, edges array<struct<{kind}>>, connects boolean")


def candidates(sentences: DataFrame, words: DataFrame, makers: list[Maker], ids: list[str], price: int = search.WORD_COST) -> DataFrame:
    """(<ids>, text, edges array<struct<start, end, price, maker, flag>>, connects): dictionary words
    are of maker 0, others of the place of their maker, from 1. connects is false for a sentence
    that both stages leave without a path: there is an error to report. Null sentences are left
    out; an empty one connects. No id may repeat."""
    good = sentences.where("text is not null").select(*ids, "text")
    blocks = trie.blocks(words)
    some = list(islice(blocks, 2))
    if len(some) == 1 and not any(m.template for m in makers):
        return _at_once(good, some[0], makers, ids, price)
    own = F.transform("edges", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(price).alias("price"), F.lit(0).alias("maker"), F.lit(0).alias("flag")))
    base = trie.with_edges(good, words, ids).withColumn("edges", own)
    first = [k for k, m in enumerate(makers, 1) if not m.low]
    second = [k for k, m in enumerate(makers, 1) if m.low]
    tried = search.with_connects(_added(base, "text", makers, first, words, ids), ids)
    if not second:
        return tried
    left = tried.withColumn("_left", F.when(~F.col("connects"), F.col("text"))).drop("connects")
    return search.with_connects(_added(left, "_left", makers, second, words, ids).drop("_left"), ids)


def rows_of(lattices: DataFrame, ids: list[str]) -> DataFrame:
    """(<ids>, start, end, surface, price, maker, flag): candidates as rows."""
    each = lattices.select(*ids, "text", F.explode("edges").alias("e"))
    surface = F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    return each.select(*ids, "e.start", "e.end", surface.alias("surface"), "e.price", "e.maker", "e.flag")
