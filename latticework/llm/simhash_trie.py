"""SimHash near-dedup: fingerprints linked by a self-join of their binary trie."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import components, cut, free_name

SEED = 42
SHINGLE = 3
BUDGET = 2
#: Fingerprints that a subtree may hold before the top of the trie splits it, and the bits
#: that the top may use: at most 2^TOP_BITS nodes, so its size has a bound at any input.
SUBTREE = 4096
LEAST_BITS, TOP_BITS = 5, 12
#: Only subtrees below the top of over DEEP_SUBTREE fingerprints are split too, STEP bits at a time.
DEEP_SUBTREE, STEP = 16 * SUBTREE, 4
#: Node pairs that one step of the traversal holds.
FRONTIER = 1 << 18
AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> bytes:
    """8 bytes, big-endian: a bit is 1 if set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        some = b"".join([digest(data[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def each(parts):
        for part in parts:
            fps = np.frombuffer(b"".join(map(fingerprint, part.text)), ">i8").astype(np.int64)
            yield pd.DataFrame({"doc_id": part.doc_id, "fp": fps})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(each, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType.simpleString()))


def top_pairs(sizes: dict[int, int], bits: int, subtree: int = SUBTREE, least: int = LEAST_BITS, budget: int = BUDGET) -> list[tuple[int, int, bool]]:
    """(prefix, pair, right side) for pairs of subtrees whose roots differ in at most
    `budget` bits; sizes: fingerprints by their first `bits` bits. The top of the trie is
    split where a node has over `subtree` fingerprints, and traversed in node pairs."""
    return [(p, pair, right) for _, p, pair, right in leaf_pairs({(bits, p): n for p, n in sizes.items()}, bits, subtree, subtree, least, budget)]


def leaf_pairs(leaves: dict[tuple[int, int], int], top: int, subtree: int, deep: int, least: int = LEAST_BITS, budget: int = BUDGET) -> list[tuple[int, int, int, bool]]:
    """(depth, prefix, pair, right side), as top_pairs(), of leaves at different depths, none
    below another; nodes from depth `top` on are split where they have over `deep` fingerprints."""
    total, under = {}, {}
    for (bits, prefix), n in leaves.items():
        for depth in range(bits + 1):
            key = (depth, prefix >> (bits - depth))
            total[key] = total.get(key, 0) + n
            under.setdefault(key, []).append((bits, prefix))
    inner = lambda x: x not in leaves and (x[0] < least or total[x] > (subtree if x[0] < top else deep))
    out, pairs, todo = [], 0, [((0, 0), (0, 0), 0)] if leaves else []
    while todo:
        a, b, spent = todo.pop()
        if not inner(a) and not inner(b):
            for side, x in enumerate((a, b)):
                out += [(*leaf, pairs, side == 1) for leaf in under[x] if side == 0 or a != b]
            pairs += 1
            continue
        kids = lambda x: [(x[0] + 1, 2 * x[1] + i) for i in (0, 1) if (x[0] + 1, 2 * x[1] + i) in total] if inner(x) else [x]
        for x in kids(a):
            for y in kids(b):
                if a == b and x > y:
                    continue
                depth = min(x[0], y[0])
                differ = ((x[1] >> (x[0] - depth)) ^ (y[1] >> (y[0] - depth))).bit_count()
                if differ <= budget:
                    todo.append((x, y, differ))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET):
    """Yields index arrays (i, j) of the pairs of a and b (a and a, i < j, if b is None)
    within `budget` bits. Both are sorted, distinct and unsigned.

    Pairs of trie nodes, which are ranges of the sorted arrays, go down one bit at a time. A
    pair whose nodes turn to different sides has spent a bit; it ends when none is left. A
    frontier grown too wide is halved, one half waiting, so memory has a bound."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    todo = [(0, np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64))]
    while todo:
        bit, f = todo.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            todo += [(bit, f[:, :half]), (bit, f[:, half:])]
            continue
        small = (f[1] - f[0]) * (f[3] - f[2]) <= 16
        if bit == 64:
            small[:] = True
        if small.any():
            g, f = f[:, small], f[:, ~small]
            n = g[1] - g[0]
            m = (g[3] - g[2]) * n
            at = np.repeat(np.arange(len(m)), m)
            k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            i, j = g[0][at] + k % n[at], g[2][at] + k // n[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if alone:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if not f.shape[1]:
            continue
        side = np.uint64(1) << np.uint64(63 - bit)

        def split(x, lo, hi):
            """Where, in a node from lo to hi, the bit turns to one."""
            lo, hi = lo.copy(), hi.copy()
            while True:
                going = lo < hi
                if not going.any():
                    return lo
                mid = (lo + hi) >> 1
                one = (x[np.minimum(mid, len(x) - 1)] & side) != 0
                hi = np.where(going & one, mid, hi)
                lo = np.where(going & ~one, mid + 1, lo)

        am, bm = split(a, f[0], f[1]), split(b, f[2], f[3])
        kids = []
        for x in (0, 1):
            for y in (0, 1):
                g = np.array([f[0] if x == 0 else am, am if x == 0 else f[1], f[2] if y == 0 else bm, bm if y == 0 else f[3], f[4] + (x != y)])
                keep = (g[0] < g[1]) & (g[2] < g[3]) & (g[4] <= budget)
                if alone and (x, y) == (1, 0):
                    keep &= f[0] != f[2]  # a node with itself: its mirror image
                kids.append(g[:, keep])
        todo.append((bit + 1, np.concatenate(kids, axis=1)))


def forest(n: int, pairs) -> np.ndarray:
    """For each of n items, the smallest item of its group, as far as the pairs link them."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def leaves_of(fps: DataFrame, top: int = TOP_BITS, deep: int = DEEP_SUBTREE, step: int = STEP) -> dict[tuple[int, int], int]:
    """Fingerprints by (depth, prefix). Prefixes of `top` bits with over `deep` fingerprints, and
    only these, are counted by the next bits too, level by level: at most 2^top rows come
    first, then 2^step for each `deep` fingerprints."""
    count = lambda rows, depth: {r[0]: r[1] for r in rows.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("p")).count().collect()}
    leaves, depth, now = {}, top, count(fps, top)
    while True:
        hot = [p for p, n in now.items() if n > deep and depth + step < 64]
        leaves |= {(depth, p): n for p, n in now.items() if n <= deep or depth + step >= 64}
        if not hot:
            return leaves
        among = fps.sparkSession.createDataFrame([(p,) for p in hot], "hot long")
        now = count(fps.join(F.broadcast(among), F.shiftrightunsigned("fp", 64 - depth) == F.col("hot"), "left_semi"), depth + step)
        depth += step


def links(fps: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE, deep: int = DEEP_SUBTREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp, enough to connect all within `budget`
    bits: each pair of subtrees yields a spanning forest of its close pairs, so a cluster
    gives as many links as it has members, not all its pairs."""
    leaves = leaves_of(fps, deep=deep)
    table = leaf_pairs(leaves, TOP_BITS, subtree, deep, budget=budget)
    pairs = fps.sparkSession.createDataFrame(table, "depth int, prefix long, pair int, right boolean")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(part.fp[~part.right].to_numpy().view(np.uint64))
        right = np.unique(part.fp[part.right].to_numpy().view(np.uint64)) if part.right.any() else None
        both = left if right is None else np.concatenate((left, right))
        found = close_pairs(left, right, budget)
        root = forest(len(both), found if right is None else ((i, j + len(left)) for i, j in found))
        at = np.nonzero(root != np.arange(len(both)))[0]
        return pd.DataFrame({"a": both[at].view(np.int64), "b": both[root[at]].view(np.int64)})

    # The table of pairs has at most 2^TOP_BITS prefixes in 79 pairs each, and more only below
    # prefixes of over `deep` fingerprints, in proportion to these.
    depths = sorted({depth for depth, _ in leaves} | {TOP_BITS})
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("fp", 64 - d).alias("prefix")) for d in depths]))
    dealt = fps.select("fp", at.alias("at")).select("fp", "at.*").join(F.broadcast(pairs), ["depth", "prefix"])
    return dealt.select("pair", "fp", "right").groupBy("pair").applyInPandas(join, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint, component_id).

    The text's A-Z are lower-cased, its words, split at ASCII white space, make 3-word
    shingles (one of all words if there are fewer), repeats included; a bit of the fingerprint
    is 1 if set in over half of their XXH64. Null, empty and blank texts have fingerprint zero,
    which links like any other. Documents link at `budget` or fewer differing bits;
    component_id is the smallest id of the documents reachable (null ids are passed over).
    Repeated rows are returned as they are. An empty table gives an empty result; other
    columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    return grouped(marked, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(marked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows (doc_id, fp, ...) with their component_id and its root, a fingerprint that tells
    components apart even if no member has an id."""
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(classes.select("fp"), budget))
    rooted = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id", "root")
    return marked.join(of, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """docs, all columns kept, with one document of each component: the row with the smallest
    id, null ids last, and of rows with that id any one. Repeated rows count as one."""
    key = free_name(docs.columns, "_key")
    named = docs.withColumn(key, F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.lit("\x1e"), F.col(text_col))))
    kind = docs.schema[id_col].dataType.simpleString()

    def each(parts):
        for part in parts:
            fps = np.frombuffer(b"".join(map(fingerprint, part.text)), ">i8").astype(np.int64)
            yield pd.DataFrame({"doc_id": part.doc_id, "key": part.key, "fp": fps})

    rows = named.select(F.col(id_col).cast("string").alias("doc_id"), F.col(key).alias("key"), F.col(text_col).alias("text"))
    marked = cut(rows.mapInPandas(each, "doc_id string, key string, fp long").withColumn("doc_id", F.col("doc_id").cast(kind)))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    kept = grouped(marked, budget).groupBy("root").agg(F.min(order).alias("first"))
    times = marked.groupBy("key").count()
    kept = cut(kept.select(F.col("first.key").alias("key")).join(times, "key").select(F.col("key").alias(key), "count"))
    once, often = kept.where("count = 1").select(key), kept.where("count > 1").select(key)
    rest = named.join(often, key, "left_semi").dropDuplicates([key])
    return named.join(once, key, "left_semi").unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
