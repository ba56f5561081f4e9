"""The trie of the prefixes that conversations share, peeled from its deepest turns up."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import shared_dir, written

#: Conversations are rebuilt in families of so many neighbouring ids, with fewer than HEADS turns of the family's first.
FAMILY, HEADS = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
#: Levels are peeled together while they have at most so many rows in all; a larger level is peeled by itself.
ROWS = 4096
#: A parent of a thousandth of all nodes, or more, is a hot one: there are at most so many.
HOT = 1000
#: Ids of a chunk of a node's list of ends, as a power of two.
CHUNK_BITS = 12
DIGEST = 16
NODE = "h binary, up binary, chain binary, words array<int>, depth int, m long, n long, n_children long, n_leaves long, saved long"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest binary, words int>>) of every conversation, its first
    turns taken from its family's first one. A turn is told by the 128-bit digest of its role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("own"))
    first = whole.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_first"), F.slice("own", 1, HEADS - 1).alias("heads"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = whole.withColumn("_first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "_first", "left").withColumn("h", h)
    heads = F.slice(F.coalesce("heads", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(heads, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def chained(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, chain, words): chain holds a digest for each prefix, one after the other."""

    def each(parts):
        for part in parts:
            chains = []
            for digests in part.digests:
                running = hashlib.md5()
                chain = []
                for d in digests:
                    running.update(d)
                    chain.append(running.digest())
                chains.append(b"".join(chain))
            yield pd.DataFrame({"conv_id": part.conv_id, "depth": [len(c) // DIGEST for c in chains], "chain": chains, "words": part.words})

    rows = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return rows.mapInPandas(each, "conv_id long, depth int, chain binary, words array<int>")


def prefix(depth) -> Column:
    """The digest of a chain's first `depth` turns, empty for none."""
    depth = F.col(depth) if isinstance(depth, str) else F.lit(depth)
    return F.substring("chain", F.greatest((depth - 1) * DIGEST + 1, F.lit(1)), F.when(depth > 0, DIGEST).otherwise(0))


def stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Surviving nodes without their last turn, as children of nodes at `depth`."""
    return nodes.select(F.substring("chain", 1, depth * DIGEST).alias("chain"), F.slice("words", 1, depth).alias("words"), F.lit(depth).alias("depth"), "m", "n", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")


def level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level from the rows that meet there: children stripped of their last
    turn, and conversations that end. Spark combines them before its shuffle, however many
    share a node."""
    words = F.element_at("words", depth) if depth else F.lit(0)
    found = rows.groupBy(prefix(depth).alias("_h")).agg(
        F.any_value("chain").alias("chain"), F.any_value("words").alias("words"), F.lit(depth).alias("depth"), F.min("m").alias("m"), F.sum("n").alias("n"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
    )
    whole = found.withColumns({"up": prefix(depth - 1) if depth else F.lit(None).cast("binary"), "n_leaves": F.greatest("n_leaves", F.lit(1)), "saved": F.col("saved") + (F.col("n") - 1) * words})
    return whole.select(F.col("_h").alias("h"), "up", "chain", "words", "depth", "m", "n", "n_children", "n_leaves", "saved")


def levels(rows: DataFrame, low: int) -> DataFrame:
    """The nodes of all levels from `low` on, from at most ROWS rows, the same way: those that
    share their first `low` turns are peeled in one task, level by level. Chains go on with
    the nodes of the last level alone."""

    def peel(parts):
        at: dict[int, list] = {}
        for part in parts:
            for r in part.itertuples(index=False):
                at.setdefault(r.depth, []).append((r.chain, r.words, r.m, r.n, r.n_children, r.n_leaves, r.saved))
        out, up = [], []
        for depth in range(max(at, default=0), low - 1, -1):
            met: dict[bytes, list] = {}
            for chain, words, m, n, children, leaves, saved in [*up, *at.get(depth, ())]:
                own = met.setdefault(chain[(depth - 1) * DIGEST : depth * DIGEST], [chain, words, m, 0, 0, 0, 0])
                own[2] = min(own[2], m)
                for k, v in enumerate((n, children, leaves, saved), 3):
                    own[k] += v
            up = []
            for h, (chain, words, m, n, children, leaves, saved) in met.items():
                told = (m, n, children, max(leaves, 1), saved + (n - 1) * int(words[depth - 1]))
                out.append((h, chain[max(depth - 2, 0) * DIGEST : (depth - 1) * DIGEST], *((chain[: depth * DIGEST], words[:depth]) if depth == low else (None, None)), depth, *told))
                up.append((chain, words, m, n, 1, *told[3:]))
        yield pd.DataFrame(out, columns=["h", "up", "chain", "words", "depth", "m", "n", "n_children", "n_leaves", "saved"])

    return rows.repartition(prefix(low)).mapInPandas(peel, NODE)


def ends_digests(members: DataFrame) -> DataFrame:
    """(h, ends_sha256): the hash of each node's list of conversations that end there. Ids are
    put together in chunks of neighbouring ones, then hashed chunk by chunk in order, so that
    no list is ever held whole."""
    chunks = members.groupBy(prefix("depth").alias("h"), F.shiftright("conv_id", CHUNK_BITS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def each(parts):
        now, running = None, None
        for part in parts:
            out = []
            for h, ids in zip(part.h, part.ids):
                if now is not None and h == now:
                    running.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = h, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["h", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, running.hexdigest())], columns=["h", "ends_sha256"])

    return chunks.repartition("h").sortWithinPartitions("h", "part").select("h", "ids").mapInPandas(each, "h binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), all but the last long.

    Turns are ordered by turn, null first, then by the digest of role and text, so repeated
    rows and ties have one order; null role and text count as empty. Rows without conv_id
    belong to no conversation and are left out. An empty table gives an empty result, not even
    a root; other columns are ignored.

    Conversations that end at one node are one row from the start. From the deepest level on,
    nodes lose their last turn and meet with those that end a turn higher; each meeting finds
    the nodes of a level with all that is told of their subtrees. A level of many rows is one
    grouping, combined before its shuffle, so that a prefix shared by a third of all
    conversations is no hot key; deep levels of few rows are peeled together. Rounds are
    written to the shared folder. A conversation is held in one task, as 20 bytes a turn.
    """
    spark = conversations.sparkSession
    members = written(chained(rebuilt(conversations)))
    one = F.lit(0).cast("long")
    ended = members.groupBy(prefix("depth").alias("_h"), "depth").agg(F.any_value("chain").alias("chain"), F.any_value("words").alias("words"), F.min("conv_id").alias("m"), F.count("*").alias("n"))
    ended = written(ended.select("chain", "words", "depth", "m", "n", one.alias("n_children"), one.alias("n_leaves"), one.alias("saved")))
    ends_at = {r["depth"]: r["count"] for r in ended.groupBy("depth").count().collect()}  # a row a depth
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    depth, alive, up, k = max(ends_at, default=-1), 0, None, 0
    while depth >= 0:
        low, rows = depth, alive + ends_at.get(depth, 0)
        while low > 1 and rows + ends_at.get(low - 1, 0) <= ROWS:
            low -= 1
            rows += ends_at.get(low, 0)
        some = ended.where(F.col("depth").between(low, depth))
        some = some if up is None else some.unionByName(stripped(up, depth))
        found = levels(some, low) if low < depth else level(some, depth)
        found.write.parquet(f"{path}/round={k}")
        up = spark.read.schema(NODE).parquet(f"{path}/round={k}").where(F.col("depth") == low)
        depth, alive, k = low - 1, rows, k + 1
    if not k:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = spark.read.schema(NODE).parquet(*[f"{path}/round={i}" for i in range(k)])
    total = nodes.count()
    named = nodes.select("h", "up", F.col("m").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    parents = named.where("n_children > 0").select(F.col("h").alias("up"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HOT >= total).alias("hot"))
    hot = F.broadcast(parents.where("hot").select("up", "parent_conv_id"))  # at most HOT rows
    below = named.where("depth > 0")
    met = below.join(hot, "up").unionByName(below.join(hot, "up", "left_anti").join(parents.where("not hot").select("up", "parent_conv_id"), "up"))
    whole = met.unionByName(named.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).join(ends_digests(members), "h", "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: unicode({0}[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id
), re AS (
  SELECT o.conv_id, {_CRC.format('(o.conv_id::VARCHAR)')} % 4 AS h, o.turns, coalesce(f.turns, []) AS heads FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20
), r AS (
  SELECT conv_id, list_concat(heads[1:h], turns[h + 1:]) AS turns FROM re
), p AS (
  SELECT conv_id, len(turns) AS size, d, turns[1:d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END * (count(*) - 1) AS own_saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY node, d
), c AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.node[1:n.d] = n.node) AS n_children FROM n
), up AS (
  SELECT conv_id, d, unnest(range(0, d + 1)) AS a, node, own_saved, n_children FROM c
), s AS (
  SELECT a AS d, node[1:a] AS node, sum(own_saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, b.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM c JOIN s ON s.d = c.d AND s.node = c.node LEFT JOIN c b ON b.d = c.d - 1 AND b.node = c.node[1:b.d]
"""
