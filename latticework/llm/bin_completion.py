"""Best-fit packing of documents into sequences by bin completion on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.bpe_chunks import byte_chars
from latticework.llm.common import written

CAPACITY = 4096
END_ID = 1
#: Words kept in a Python worker's store, twice over at most.
STORE_WORDS = 450_000
#: Nodes that the search for one filling may visit, and the fillings kept for branching.
FILLING_NODES, BRANCHES = 400, 3
#: Whole solutions that the search may try after the first.
SOLUTIONS = 12
#: Rows of one length that are numbered together, about.
NUMBERED = 100_000


class WordIds(dict):
    """Bytes of a word between ASCII white space -> its ids, little-endian unsigned 32-bit.

    The tokenizer's pre-tokens never reach over white space, and its normaliser works by
    character, so a text's ids are those of its words in turn. A Latin-1 word has the ids of
    its lower case; one that ends in an ASCII letter or digit and then one of `.,` has its own
    and the mark's, for no pre-token holds both; one of letters alone is a single pre-token
    and goes to the tokenizer's model at once. Any other goes through the whole tokenizer.
    Holds the STORE_WORDS words last met and, until they are as many again, those before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.chars = byte_chars()
        self.before: dict[bytes, bytes] = {}

    def ids(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalnum():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) <= "\xff":
            if (lower := text.lower()) != text:
                return self[lower.encode()]
            return np.array([t.id for t in self.model.tokenize("".join([self.chars[b] for b in word]))], "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.ids(word)
        if len(self) >= STORE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found


_stores: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's store for the tokenizer at path."""
    if path not in _stores:
        _stores[path] = WordIds(path)
    return _stores[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with end_id after them."""
    end = np.array([end_id], "<u4").tobytes()

    def each(parts):
        ids_of = word_ids(tokenizer_path)
        for part in parts:
            out = []
            for doc_id, text in zip(part.doc_id, part.text):
                words = text.encode().split() if isinstance(text, str) else []
                data = b"".join([ids_of[w] for w in words]) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(each, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(kind))


def fillings(sizes: list[int], left: dict[int, int], room: int, keep: int = BRANCHES, nodes: int = FILLING_NODES) -> list[tuple[int, ...]]:
    """The best undominated fillings of `room`, least waste first; sizes: ascending, those that
    `left` still has.

    Items go in from large to small. The first incumbent is the best fit alone. A filling that
    sums to no more than the best-fitting item is dominated by that item, and so is pruned by
    its waste; one without waste ends the search."""
    at = bisect.bisect_right(sizes, room)
    if not at:
        return [()]
    found: dict[tuple[int, ...], int] = {(sizes[at - 1],): room - sizes[at - 1]}
    used: dict[int, int] = {}
    seen = 0

    def down(chosen: tuple[int, ...], rest: int, most: int) -> bool:
        nonlocal seen
        seen += 1
        worst = sorted(found.values())[: keep][-1] if len(found) >= keep else room
        if chosen and (rest < worst or rest == 0):
            found[chosen] = rest
        if rest == 0:
            return True
        if rest <= most and left.get(rest, 0) > used.get(rest, 0):
            found[(*chosen, rest)] = 0
            return True
        k = bisect.bisect_right(sizes, min(rest, most)) - 1
        while k >= 0 and seen < nodes:
            s = sizes[k]
            if left[s] > used.get(s, 0):
                used[s] = used.get(s, 0) + 1
                done = down((*chosen, s), rest - s, s)
                used[s] -= 1
                if done:
                    return True
            k -= 1
        return False

    down((), room, room)
    return sorted(found, key=lambda f: (found[f], len(f)))[:keep]


def complete(lengths: dict[int, int], capacity: int, choose) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
    """(number of bins, [(lengths in a bin, number of such bins)]): the largest length left is
    completed by choose(fillings), as often as what is left allows."""
    left = {k: v for k, v in lengths.items() if v}
    sizes, out, bins = sorted(left), [], 0
    while sizes:
        largest = sizes[-1]
        left[largest] -= 1
        own = sizes if left[largest] else sizes[:-1]
        filling = choose(fillings(own, left, capacity - largest))
        left[largest] += 1
        items = (largest, *filling)
        needs = {s: items.count(s) for s in set(items)}
        times = min(left[s] // n for s, n in needs.items())
        for s, n in needs.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
        out.append((items, times))
        bins += times
    return bins, out


def solve(lengths: dict[int, int], capacity: int = CAPACITY, solutions: int = SOLUTIONS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns [(lengths in a bin, number of such bins)] that hold all items.

    The first solution takes the best filling everywhere. While it has more bins than the
    bound, total length over capacity rounded up, others branch off: at one completion after
    another the next best filling is taken instead. The best is the incumbent; a solution with
    as many bins as the bound is optimal and ends the search. The work depends on the number
    of distinct lengths, at most `capacity`, not on the number of items."""
    least = -(-sum(k * v for k, v in lengths.items()) // capacity)
    best, patterns = complete(lengths, capacity, lambda f: f[0])
    for turn in range(solutions):
        if best <= least:
            break
        step = iter(range(1 << 62))
        bins, other = complete(lengths, capacity, lambda f, t=turn: f[1] if next(step) == t and len(f) > 1 else f[0])
        if bins < best:
            best, patterns = bins, other
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, columns (first rank, first bin, copies in a bin, first offset): its
    items numbered from a pattern's first rank on go to that pattern's bins in turn."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for items, times in patterns:
        offset = 0
        for s in sorted(set(items), reverse=True):
            n = items.count(s)
            out.setdefault(s, []).append((rank.get(s, 0), base, n, offset))
            rank[s] = rank.get(s, 0) + times * n
            offset += n * s
        base += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of docs: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset).

    A document is its ids and then END_ID; null text is empty, so such a document is that one
    id. Documents longer than `capacity` are cut into pieces of that length, the last may be
    shorter; no other is cut. Repeated rows are packed as often as they occur, null ids too.
    An empty table gives an empty result; other columns are ignored.

    Only the histogram of lengths, at most `capacity` rows, goes to the driver, which solves
    it. Pieces are numbered within their length, salted so that a length of a third of all
    rows is dealt to many tasks, and find their sequence and offset by that number.
    """
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, capacity))
    lengths = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    places = slots(solve(lengths, capacity))
    salts = max(64, max(lengths.values(), default=0) // NUMBERED)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "before", "own")

    def place(parts):
        for part in parts:
            sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            length, rank = part.length.to_numpy(), part["rank"].to_numpy()
            for s in np.unique(length):
                mine, rows = length == s, places[int(s)]
                first, base, copies, start = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1].T
                n = rank[mine] - first
                sequence[mine], offset[mine] = base + n // copies, start + n % copies * s
            yield part.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ids = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", "rank")
    placed = ids.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType.simpleString()))
