"""Dictionary lookup by a trie in arrays: all starts of a batch of sentences go down together.

A dictionary is sent to the tasks in blocks of bounded size, so sentences are never shuffled to
meet it; one beyond a block's size costs a pass over the sentences for each block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import kana

#: Characters of words in a block, at most, whatever the dictionary's size.
BLOCK = 1 << 22
#: Characters of sentences that are looked up at once.
AT_ONCE = 1 << 18


class Trie:
    """Nodes are numbered so that a node is the place, plus one, of its key among the sorted keys
    (parent, character); the root is 0. word[node] is the place of the word that ends there, or -1."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        begin = sizes.cumsum() - sizes
        at, own, keys, total = np.zeros(len(words), np.int64), np.arange(len(words)), [], 0
        for depth in range(int(sizes.max(initial=0))):
            own = own[sizes[own] > depth]
            found, place = np.unique((at[own] << 21) | codes[begin[own] + depth], return_inverse=True)
            at[own] = total + place + 1
            keys.append(found)
            total += len(found)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.word = np.full(total + 1, -1, np.int64)
        self.word[at[sizes > 0]] = np.nonzero(sizes > 0)[0]

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there are none."""
        wanted = (nodes << 21) | codes
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at + 1, 0) if len(self.keys) else np.zeros(len(nodes), np.int64)

    def starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose character begins a word, and the nodes there."""
        kinds, which = np.unique(codes, return_inverse=True)
        nodes = self.step(np.zeros(len(kinds), np.int64), kinds)[which]
        at = np.nonzero(nodes)[0]
        return at, nodes[at]

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, word) of every word at every place."""
        start, node = self.starts(codes)
        at, out = start + 1, []
        while len(start):
            hit = self.word[node] >= 0
            out.append((start[hit], at[hit], self.word[node[hit]]))
            node = self.step(node, codes[at])
            some = node > 0
            start, at, node = start[some], at[some] + 1, node[some]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def stretches(self, codes: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, begins no word) of every stretch of places that are ok and isn't a word."""
        start = np.nonzero(ok)[0]
        node, at, out = self.step(np.zeros(len(start), np.int64), codes[start]), start + 1, []
        dead = node == 0
        while len(start):
            hit = dead | (self.word[node] < 0)
            out.append((start[hit], at[hit], dead[hit].astype(np.int64)))
            some = ok[at]
            start, at, node, dead = start[some], at[some], node[some], dead[some]
            node = np.where(dead, 0, self.step(node, codes[at]))
            dead = dead | (node == 0)
            at = at + 1
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def words_at(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of stretches: 1 for words, 0 for what begins a word, -1 for others."""
        node, at = np.zeros(len(start), np.int64), start.copy()
        alive = np.ones(len(start), bool)
        while (going := alive & (at < end)).any():
            node[going] = self.step(node[going], codes[at[going]])
            at[going] += 1
            alive &= node > 0
        return np.where(~alive, -1, (self.word[node] >= 0).astype(np.int64))

    def walk_alike(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, word, flags) of every word that the text holds in an altered spelling: after
        its first character each may stand for itself, for another, or for none. Of the ways to one
        word and end, the one of the smallest flags is told."""
        alts, drop = kana.alternatives(codes)
        start, node = self.starts(codes)
        flags, depth, out = np.full(len(start), kana.ORIGINAL), 1, []
        while len(start):
            at, none = start + depth, np.zeros(len(start), np.int64)
            ways = [(start, self.step(node, codes[at]), flags, none)]
            for alt, flag in alts:
                some = alt[at] > 0
                ways.append((start[some], self.step(node[some], alt[at[some]]), flags[some] | flag[at[some]], none[some]))
            some = drop[at] > 0
            ways.append((start[some], node[some], flags[some] | drop[at[some]], none[some] + kana.DELETE_LAST))
            start, node, flags, last = (np.concatenate([w[k][w[1] > 0] for w in ways]) for k in range(4))
            depth += 1
            hit = (self.word[node] >= 0) & (flags != kana.ORIGINAL)
            out.append((start[hit], start[hit] + depth, self.word[node[hit]], (flags | last)[hit]))
            # Different ways to one node go on as one where their flags are the same.
            start, node, flags = np.unique(np.stack((start, node, flags)), axis=1)
        start, end, word, flags = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((flags, word, end, start))
        start, end, word, flags = start[order], end[order], word[order], flags[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (word[1:] != word[:-1])
        return start[first], end[first], word[first], flags[first]


def texts_of(batch: pa.RecordBatch, text: str, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, begins, codes) of stretches of a batch: characters as numbers, with a 0 after each
    sentence and at the end; begins has a place more than there are sentences. Null counts as empty."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
    low = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size > at_once or k == len(texts) - 1:
            yield low, *codes_of(texts[low : k + 1])
            low, size = k + 1, 0


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))), codes


def blocks(words: DataFrame, word: str = "surface", fields: tuple[str, ...] = ()) -> Iterator[Block]:
    """The distinct words in blocks, one at a time on the driver: all words of some first characters,
    BLOCK characters at most where more than one first character is in it. Of the rows of a
    word one tells its fields."""
    rows = words.select(F.col(word).alias("w"), *fields).where("w <> ''").dropDuplicates(["w"])
    first = F.substring("w", 1, 1)
    parts, size = [[]], 0
    for r in rows.groupBy(first.alias("c")).agg(F.sum(F.length("w")).alias("n")).orderBy("c").collect():  # a row a character
        if size and size + r.n > BLOCK:
            parts.append([])
            size = 0
        parts[-1].append(r.c)
        size += r.n
    for part in parts:
        block = rows if len(parts) == 1 else rows.where(first.isin(part))
        elsewhere = sorted(ord(c) for other in parts if other is not part for c in other)
        own = None if part is parts[0] else np.array(sorted(map(ord, part)), np.int64)
        found = block.toPandas().sort_values("w")
        yield Block(Trie(found.w.tolist()), own, np.array(elsewhere, np.int64), {f: pa.array(found[f], pa.string()) for f in fields})


@dataclass
class Block:
    """The trie of a block, its first characters (None for the first block, which has all that no
    other block has), those of the others, and fields of the words in their order."""

    trie: Trie
    own: np.ndarray | None
    others: np.ndarray
    fields: dict[str, pa.Array]

    def mine(self, codes: np.ndarray) -> np.ndarray:
        """Which characters begin words that are for this block to tell."""
        return np.isin(codes, self.own) if self.own is not None else ~np.isin(codes, self.others) if len(self.others) else np.ones(len(codes), bool)


def schema_of(sentences: DataFrame, ids: list[str]) -> str:
    return ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ids)


def _hits(sentences: DataFrame, block: Block, ids: list[str], text: str, alike: bool) -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(block)

    def each(batches):
        trie = shared.value.trie
        for batch in batches:
            for low, begins, codes in texts_of(batch, text):
                start, end, word, *flags = trie.walk_alike(codes) if alike else trie.walk(codes)
                row = np.searchsorted(begins, start, side="right") - 1
                order = np.argsort(row, kind="stable")
                start, end, row = start[order], end[order], row[order]
                rows = pa.array(row + low)
                columns = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in ids]
                columns += [pa.array((start - begins[row]).astype(np.int32)), pa.array((end - begins[row]).astype(np.int32)), trie.words.take(pa.array(word[order]))]
                if alike:
                    said = codes.astype("<u4").tobytes().decode("utf-32-le")
                    columns += [pa.array([said[a:z] for a, z in zip(start.tolist(), end.tolist())], pa.string()), pa.array(flags[0][order].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*ids, "start", "end", "surface", *["written", "flags"] * alike])

    more = ", written string, flags int" if alike else ""
    return sentences.select(*ids, text).mapInArrow(each, f"{schema_of(sentences, ids)}, start int, end int, surface string{more}")


def lookup(sentences: DataFrame, words: DataFrame, ids: list[str], text: str = "text", word: str = "surface", alike: bool = False) -> DataFrame:
    """(<ids>, start, end, surface) of every dictionary word at every start; alike: of words in
    altered spelling only, with what is written and the flags of its changes. A spelling of
    many characters that may go has as many ends."""
    out = None
    for block in blocks(words, word):
        found = _hits(sentences, block, ids, text, alike)
        out = found if out is None else out.unionByName(found)
    return out


def with_edges(sentences: DataFrame, words: DataFrame, ids: list[str], text: str = "text", word: str = "surface", fields: tuple[str, ...] = ()) -> DataFrame:
    """(<ids>, text, edges array<struct<start, end, <fields>>>): sentences with their dictionary words by
    start and end, found where the sentences are, and fields of the words as strings. A sentence
    without any has an empty list."""
    out = sentences.select(*ids, F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k, block in enumerate(blocks(words, word, fields)):
        out = _listed(out, block, ids, k)
    return out


def _listed(sentences: DataFrame, block: Block, ids: list[str], nth: int) -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(block)
    names = ["start", "end", *block.fields]

    def each(batches):
        trie, told = shared.value.trie, shared.value.fields
        for batch in batches:
            for low, begins, codes in texts_of(batch, "text"):
                start, end, word = trie.walk(codes)
                row = np.searchsorted(begins, start, side="right") - 1
                order = np.lexsort((end, start))
                start, end, row, word = (start - begins[row])[order], (end - begins[row])[order], row[order], pa.array(word[order])
                n = len(begins) - 1
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                items = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *(of.take(word) for of in told.values())], names=names)
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, items)], names=[*part.schema.names, "found"])

    kind = f"array<struct<start:int,end:int{''.join(f',{f}:string' for f in block.fields)}>>"
    kept = f", edges {kind}" if nth else ""
    listed = sentences.mapInArrow(each, f"{schema_of(sentences, ids)}, text string{kept}, found {kind}")
    edges = F.array_sort(F.array_union("edges", "found")) if nth else F.col("found")
    return listed.select(*ids, "text", edges.alias("edges"))
