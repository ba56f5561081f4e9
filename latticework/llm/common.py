"""What the operators of this subpackage share: scratch tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits, as a power of two, of the filters that keep rows from being shuffled in vain: 8 MB.
FILTER_BITS = 26
#: Rows of a partition, about, of tables that cut_small() made, and between rounds of components().
PART_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set before as checkpoint folder. Without
    either, a temporary folder in local mode; on a cluster, where executors
    couldn't read it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the shared folder; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> DataFrame:
    """cut(), then read in no more partitions than its rows need: each partition that a small table
    has costs all shuffles from it several files."""
    df = cut(df)
    return df.coalesce(df.count() // PART_ROWS + 1)


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again; for wide tables of
    which later steps read a few columns."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose value of column, a long, isn't in wanted: by a bitmap of
    2^FILTER_BITS hashed values, 8 MB whatever the input. What it lets through costs time only."""
    slot = f"pmod({column}, {1 << FILTER_BITS}) + 1"
    number, position = F.expr(f"bitmap_bucket_number({slot})"), F.expr(f"bitmap_bit_position({slot})")
    bits = wanted.groupBy(number.alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_bucket", number).join(F.broadcast(bits), "_bucket")
    return held.where(F.getbit(byte, (position % 8).cast("int")) == 1).drop("_bucket", "_bits")


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph with edges (a, b).

    Alternates large-star and small-star steps until the edges are stars around each
    component's smallest node. A hub's edges are never gathered: each step is a minimum by
    node, which Spark combines before its shuffle, joined back to the edges.
    Returns (node, component), one row for each node of an edge; self-loops and nulls are
    ignored. Raises if `rounds` don't suffice (each round at least halves long paths).
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # Else each round reads, and shuffles from, as many partitions as there may ever be.
        now = now.coalesce(state[0] // PART_ROWS + 1)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
