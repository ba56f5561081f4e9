"""Alignment of two tokenizers' tokens by pointer jumping, and counts of the ids that it links."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.bpe_chunks import byte_chars
from latticework.llm.common import cut, written

#: Bytes of text, about, that are tokenised and aligned at once.
AT_ONCE = 1 << 21
#: Pairs of ids that a task counts before it hands its counts on.
HELD = 1 << 21
#: A group of more pairs of tokens than this is counted by its distinct ids.
LARGE = 64
#: A pair that makes up so large a share of all (document, pair) rows, or more, is frequent; there
#: are at most so many frequent pairs, 1.7 MB, which go to all tasks. The others are joined.
FREQUENT = 1 << 17
#: Characters before this one have not changed their class since the first versions of Unicode, so
#: that both libraries of the first vocabulary split them alike.
SETTLED = "ɐ"


class Pair:
    """The two tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, byte_json: str, piece_model: str, ranks_path: str | None = None, pattern: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(byte_json)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        self.byte_level, self.ranks = t, None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        known = {c: bytes([b]) for b, c in byte_chars().items()}
        tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [b"".join(known[c] for c in x) if all(c in known for c in x) else x.encode() for x in tokens]
        size = self.pieces.get_piece_size()
        named = [self.pieces.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(named)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Decimal ids with what may follow them in the text of groups.
        self.written = [f"{i}{sign}" for sign, n in ((",", len(self.a_bytes)), ("|", len(self.a_bytes)), (",", size), (";", size)) for i in range(n)]

    def a_ids(self, text: str) -> list[int]:
        """As the first tokenizer's library has it; its ranks, in the faster library, give the same ids."""
        if self.ranks and max(text) < SETTLED:
            return self.ranks.encode_ordinary(text)
        return self.byte_level.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids by both, for a space and the text; none where the bytes of either aren't just these."""
        if not text:
            return [], []
        data = (" " + text).encode()
        a, b = self.a_ids(" " + text), self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return [], []
        return a, b


_pairs: dict[tuple, Pair] = {}


def pair_of(*paths) -> Pair:
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of A, then each of B, the token of A with which its group ends.

    Each token points to the token of the other side that holds its last byte, which of all
    that overlap with it reaches farthest to the right; a token of A that ends where that one
    does points to itself. Following pointers twice as far each time ends at the terminals."""
    n = len(a_ends)
    over, under = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    at = np.concatenate((np.where(b_ends[over] == a_ends, np.arange(n), over + n), under)) if n else np.zeros(0, np.int64)
    while True:
        farther = at[at]
        if np.array_equal(farther, at):
            return at
        at = farther


def some_pairs(ids: np.ndarray, of: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): tokens of small groups as they are, those of large ones by distinct id."""
    plain = ~large[of]
    if plain.all():
        return of, ids, np.ones(len(ids), np.int64)
    found, times = np.unique(np.stack((of[~plain], ids[~plain])), axis=1, return_counts=True)
    group, code = np.concatenate((of[plain], found[0])), np.concatenate((ids[plain], found[1]))
    order = np.argsort(group, kind="stable")
    return group[order], code[order], np.concatenate((np.ones(plain.sum(), np.int64), times))[order]


def align(tokens: list[tuple[list[int], list[int]]], own: Pair) -> list[tuple]:
    """For each text: number of groups, of links, hash of the groups, its distinct linked pairs
    as id_a * size_b + id_b, and how often each is linked."""
    a, b = (np.fromiter((i for t in tokens for i in t[k]), np.int64) for k in (0, 1))
    a_ends, b_ends = own.a_sizes[a].cumsum(), own.b_sizes[b].cumsum()
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    last = terminals(a_ends, b_ends)
    ends = np.nonzero(last[: len(a)] == np.arange(len(a)))[0]
    of_a, of_b = np.searchsorted(ends, last[: len(a)]), np.searchsorted(ends, last[len(a) :])
    in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
    text_of = np.searchsorted(n_a.cumsum(), ends, side="right")
    n_groups = np.bincount(text_of, minlength=len(tokens))
    n_links = np.bincount(text_of, weights=None if not len(ends) else (in_a * in_b).astype(np.float64), minlength=len(tokens)).astype(np.int64)
    # Groups in writing: a group's tokens of A, then those of B.
    size_a, size_b = len(own.a_bytes), len(own.b_bytes)
    codes = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[in_a.cumsum() - 1] = True
    ends_b[in_b.cumsum() - 1] = True
    codes[np.arange(len(a)) + (in_b.cumsum() - in_b)[of_a]] = a + size_a * ends_a
    codes[np.arange(len(b)) + in_a.cumsum()[of_b]] = b + 2 * size_a + size_b * ends_b
    # Pairs: each token of A, or distinct id of a large group, beside all of B in its group.
    large = in_a * in_b > LARGE
    g, x, x_times = some_pairs(a, of_a, large)
    h, y, y_times = some_pairs(b, of_b, large)
    many = np.bincount(h, minlength=len(ends))
    begin = many.cumsum() - many
    reps = many[g]
    left = np.repeat(np.arange(len(g)), reps)
    right = begin[g][left] + np.arange(len(left)) - np.repeat(reps.cumsum() - reps, reps)
    pairs, times = x[left] * size_b + y[right], x_times[left] * y_times[right]
    keys, inverse = np.unique(text_of[g][left] * (size_a * size_b) + pairs, return_inverse=True)
    sums = np.bincount(inverse, weights=times.astype(np.float64), minlength=len(keys)).astype(np.int64)
    cuts = np.searchsorted(keys, np.arange(len(tokens) + 1) * (size_a * size_b))
    at, out = np.concatenate(([0], (n_a + n_b).cumsum())), []
    for k in range(len(tokens)):
        said = "".join(map(own.written.__getitem__, codes[at[k] : at[k + 1]].tolist()))[:-1]
        some = slice(cuts[k], cuts[k + 1])
        out.append((int(n_groups[k]), int(n_links[k]), hashlib.sha256(said.encode()).hexdigest() if said else "", keys[some] - k * size_a * size_b, sums[some]))
    return out


def blocks(texts, most: int = AT_ONCE):
    """Stretches of neighbouring texts of about `most` characters in all."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def aligned(docs: DataFrame, paths: tuple, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row."""

    def each(parts):
        own = pair_of(*paths)
        for part in parts:
            out = []
            for some in blocks(part.text):
                tokens = [own.tokens(t if isinstance(t, str) else None) for t in some]
                for (a, b), (groups, links, said, pairs, times) in zip(tokens, align(tokens, own)):
                    out.append((len(a), len(b), groups, links, said, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            made = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            made.insert(0, "doc_id", part.doc_id.to_numpy())
            yield made

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInPandas(each, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    return made.withColumn("key", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many rows each pair is, and whether no pair of its first id is in
    more. Tasks count before they shuffle; the highest counts are a row for each id of A."""

    def each(parts):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            for some in blocks(part.pairs, HELD):
                found, n = np.unique(np.frombuffer(b"".join(some), "<u4").astype(np.int64), return_counts=True)
                keys, inverse = np.unique(np.concatenate((keys, found)), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield pd.DataFrame({"pair": keys, "n": counts})
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"pair": keys, "n": counts})

    counted = cut(rows.select("pairs").mapInPandas(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.floor(F.col("pair") / size_b)
    most = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_alignment(docs: DataFrame, byte_json: str, piece_model: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256).

    Null and empty texts, and those whose tokens don't give back a space and the text, have no
    tokens: zeros and an empty string. Strings of special tokens are plain text. A row counts
    as a document of its own, so repeated rows count twice and null ids are kept; an empty
    table gives an empty result; other columns are ignored.

    Texts are tokenised and aligned once, without a shuffle; what they link is written to the
    shared folder as distinct pairs. Pairs are counted in tasks first, so a pair that every
    document has crosses once for each task. Frequent pairs, at most FREQUENT by their share of
    all, go to all tasks; the rest, with none of them hot, are joined. A task needs memory for
    its longest text.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    paths = (byte_json, piece_model, ranks_path, pattern)
    own = pair_of(*paths)
    size_b = len(own.b_bytes)
    if len(own.a_bytes) * size_b > 1 << 32:
        raise ValueError("pairs of ids of these vocabularies don't fit 32 bits")
    rows = written(aligned(docs, paths, id_col, text_col))
    counts = cut(pair_counts(rows, size_b))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * FREQUENT >= total
    top = counts.where(frequent).toPandas().sort_values("pair")  # at most FREQUENT rows
    shared = spark.sparkContext.broadcast((top.pair.to_numpy(np.int64), top.n.to_numpy(np.int64), top.best.to_numpy(bool)))

    def each(parts):
        known, n, best = shared.value
        for part in parts:
            out = []
            for key, pairs, times in zip(part.key, part.pairs, part.times):
                p, t = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
                hit = known[at] == p if len(known) else np.zeros(len(p), bool)
                at, own = at[hit], t[hit]
                out.append((key, int(own[best[at]].sum()), int((own * n[at]).sum()), p[~hit].tolist(), t[~hit].tolist()))
            yield pd.DataFrame(out, columns=["key", "n_best", "count_sum", "rare", "times"])

    told = written(rows.select("key", "pairs", "times").mapInPandas(each, "key long, n_best long, count_sum long, rare array<long>, times array<long>"))
    rare = told.where("size(rare) > 0").select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(~frequent), "pair").select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = told.select("key", "n_best", "count_sum").unionByName(met).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "key").select(F.col("doc_id").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
