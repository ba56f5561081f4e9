"""Candidates for unknown words, and whether candidates connect."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.chars import class_by_name, classes_of
from latticework.functions.kana import MOST_FIGURES, NUMBER
from latticework.operators import trie


def made(sentences: DataFrame, words: DataFrame, ids: list[str], find) -> DataFrame:
    """(<ids>, start, end, surface, not_prefix) of what find(block, codes, classes) -> (start, end,
    begins no word) finds in the sentences of a batch. Each block of the dictionary tells of what
    begins with its own characters."""
    out = None
    for block in trie.blocks(words):
        rows = _made(sentences, block, ids, find)
        out = rows if out is None else out.unionByName(rows)
    return out


def _made(sentences: DataFrame, block: trie.Block, ids: list[str], find) -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(block)

    def each(batches):
        for batch in batches:
            for low, begins, codes in trie.texts_of(batch, "text"):
                start, end, flag = find(shared.value, codes, np.where(codes > 0, classes_of(codes), 0))
                row = np.searchsorted(begins, start, side="right") - 1
                order = np.lexsort((end, start))
                start, end, flag, row = start[order], end[order], flag[order], row[order]
                said = codes.astype("<u4").tobytes().decode("utf-32-le")
                columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row + low)) for c in ids]
                columns += [pa.array((k - begins[row]).astype(np.int32)) for k in (start, end)]
                columns += [pa.array([said[a:z] for a, z in zip(start.tolist(), end.tolist())], pa.string()), pa.array(flag.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*ids, "start", "end", "surface", "not_prefix"])

    return sentences.select(*ids, "text").mapInArrow(each, f"{trie.schema_of(sentences, ids)}, start int, end int, surface string, not_prefix int")


def listed(sentences: DataFrame, words: DataFrame, find, text: str, into: str) -> DataFrame:
    """sentences with a column of what find finds in the column text, array<struct<start, end, flag>>,
    found where the sentences are. A null text has nothing."""
    for block in trie.blocks(words):
        own = _listed(sentences, block, find, text, "_found")
        sentences = own.withColumn(into, F.concat(into, "_found") if into in sentences.columns else F.col("_found")).drop("_found")
    return sentences


def _listed(sentences: DataFrame, block: trie.Block, find, text: str, into: str) -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(block)

    def each(batches):
        for batch in batches:
            for low, begins, codes in trie.texts_of(batch, text):
                start, end, flag = find(shared.value, codes, np.where(codes > 0, classes_of(codes), 0))
                row = np.searchsorted(begins, start, side="right") - 1
                order = np.lexsort((end, start))
                row = row[order]
                items = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)) for k in (start[order] - begins[row], end[order] - begins[row], flag[order])], names=["start", "end", "flag"])
                offsets = pa.array(np.searchsorted(row, np.arange(len(begins))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, len(begins) - 1).columns, pa.ListArray.from_arrays(offsets, items)], names=[*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema)
    return sentences.mapInArrow(each, f"{kinds}, {into} array<struct<start:int,end:int,flag:int>>")


def single(sentences: DataFrame, words: DataFrame, ids: list[str], classes: str) -> DataFrame:
    """(<ids>, start, end, surface, not_prefix): characters of the classes that are no words."""
    return made(sentences, words, ids, singles_of(classes))


def singles_of(classes: str):
    wanted = class_by_name(classes)

    def find(block, codes, kinds):
        start = np.nonzero((kinds & wanted != 0) & block.mine(codes))[0]
        told = block.trie.words_at(codes, start, start + 1)
        return start[told < 1], start[told < 1] + 1, -told[told < 1]

    return find


def chunks(sentences: DataFrame, words: DataFrame, ids: list[str], classes: str) -> DataFrame:
    """(<ids>, start, end, surface, not_prefix): all substrings that are no words of the longest
    stretches of characters of the classes. Their number grows with the square of a stretch."""
    return made(sentences, words, ids, chunks_of(classes))


def chunks_of(classes: str):
    wanted = class_by_name(classes)

    def find(block, codes, kinds):
        start, end, flag = block.trie.stretches(codes, kinds & wanted != 0)
        some = block.mine(codes[start])
        return start[some], end[some], flag[some]

    return find


def numbers(sentences: DataFrame, ids: list[str], words: DataFrame | None = None, ahead: int | None = None) -> DataFrame:
    """(<ids>, start, end, surface, not_prefix): the longest number at each start, of MOST_FIGURES parts at
    most as the reference has them; with `ahead` of any number of parts, as far as whole parts lie
    within so many characters. With words, those that are dictionary words are told by
    not_prefix -1; else all have 1."""
    none = sentences.sparkSession.createDataFrame([], "surface string")
    return made(sentences, none if words is None else words, ids, numbers_at(ahead))


def numbers_at(ahead: int | None = None):
    begin = class_by_name("FAMILY_DIGITS|FIGURE_EXCEPTION")
    pattern = NUMBER.removeprefix("^")
    number = re.compile(pattern if ahead is None else pattern.removesuffix(f"{{0,{MOST_FIGURES}}}+") + "*+")

    def size_of(said: str) -> int:
        size = number.match(said).end()
        if ahead is None or size <= ahead:
            return size
        group = re.search("[,，][^,，]{0,2}$", said[:ahead])  # three figures follow its comma, if whole
        return group.start() if group else ahead

    def find(block, codes, kinds):
        start = np.nonzero((kinds & begin != 0) & block.mine(codes))[0]
        said = codes.astype("<u4").tobytes().decode("utf-32-le")
        window = 4 * MOST_FIGURES if ahead is None else ahead + 5
        size = np.array([size_of(said[a : a + window].split("\0", 1)[0]) for a in start.tolist()], np.int64)
        start, size = start[size > 0], size[size > 0]
        return start, start + size, -block.trie.words_at(codes, start, start + size)

    return find


#: The longest number at each start, as the reference has them.
number_at = numbers_at()


def numbers_of(block, codes, kinds):
    """Of number_at() what is no word."""
    start, end, flag = number_at(block, codes, kinds)
    return start[flag >= 0], end[flag >= 0], flag[flag >= 0]


def onomatopoeia(sentences: DataFrame, words: DataFrame, ids: list[str], classes: str) -> DataFrame:
    """(<ids>, start, end, surface): ABAB, ABCABC and ABCDABCD of one class that are no words. What
    ends a sentence must have more than four characters before it, so a final ABAB is missed."""
    return made(sentences, words, ids, twice_of(classes)).drop("not_prefix")


def twice_of(classes: str):
    wanted = class_by_name(classes)

    def find(block, codes, kinds):
        ends = np.nonzero(codes == 0)[0]
        room = ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes))
        out = []
        for half in (2, 3, 4):
            ok = (kinds & wanted != 0) & block.mine(codes) & (room >= max(2 * half, 5))
            start = np.nonzero(ok)[0]
            for k in range(half):
                start = start[(codes[start + k] == codes[start + half + k]) & (kinds[start + k] & kinds[start] != 0)]
            out.append((start, start + 2 * half))
        start, end = (np.concatenate(k) for k in zip(*out))
        told = block.trie.words_at(codes, start, end)
        return start[told < 1], end[told < 1], 0 * start[told < 1]

    return find


def altered(block, codes, kinds):
    """Altered spellings of dictionary words, with the flags of their changes. Different words may be
    written alike; each counts."""
    start, end, _, flags = block.trie.walk_alike(codes)
    return start, end, flags


def connections(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Left nodes beside the right nodes that begin where they end."""
    left = nodes.select(*ids, *[F.col(c).alias(f"l_{c}") for c in ("start", "end", "surface")])
    right = nodes.select(*ids, *[F.col(c).alias(f"r_{c}") for c in ("start", "end", "surface")])
    return left.withColumn("_at", F.col("l_end")).join(right.withColumn("_at", F.col("r_start")), [*ids, "_at"]).drop("_at")
