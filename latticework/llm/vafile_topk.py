"""Exact top-k inner products by a vector-approximation file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import cut

SCALE = 1024
CELL_BITS = 8
BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 4096
#: Stripes that the file is dealt over at most; each meets all blocks of queries.
MOST_STRIPES = 64


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(1024 * x) of each component, an integer that a double holds
    exactly; vectors that are null or hold null, NaN or infinite components are left out, as are
    rows with a null id. A component is infinite that is so after its multiplication."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * SCALE)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(F.when(F.abs(c) < 2.0**53, c)).cast("double")).otherwise(c))
    return df.select(F.col(id_col).alias("vec_id"), F.when(finite, v).alias("v")).where("v is not null and vec_id is not null")


def packed(vectors: DataFrame, shift: int, cells: bool, rows: int) -> DataFrame:
    """Vectors of one length packed by `rows` into a row (dim, ids, data): data has the cells,
    floor(v / 2^shift), as int16, or v / 2^shift as float64."""

    def pack(parts):
        for part in parts:
            sizes = part.v.map(len)
            for dim, group in part.groupby(sizes, sort=True):
                for at in range(0, len(group), rows):
                    some = group.iloc[at : at + rows]
                    m = np.ldexp(np.array(some.v.tolist(), np.float64).reshape(len(some), dim), -shift)
                    data = np.floor(m).astype(np.int16) if cells else m
                    yield pd.DataFrame({"dim": [int(dim)], "ids": [some["row"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    return vectors.mapInPandas(pack, "dim int, ids binary, data binary")


def scan(pairs: DataFrame, k: int) -> DataFrame:
    """(q, c, low, high), numbers of rows, for each query and block of the file: bounds of the score,
    in units of both scales, of those vectors whose upper bound reaches the block's k-th largest
    lower bound.

    A cell c holds what lies from c to c + 1, so a query q's score lies between q . c + (sum of
    q's negative parts) and the same with the positive parts. Bounds are moved outwards by more
    than what rounding can have done."""

    def bounds(parts):
        for part in parts:
            for r in part.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                base = np.frombuffer(r.data, np.int16).reshape(len(ids), r.dim).astype(np.float64)
                queries = np.frombuffer(r.q_data, np.float64).reshape(len(q_ids), r.dim)
                slack = (r.dim + 8) * 2.0**-52 * (np.abs(base).max(initial=0) + 1)
                for at in range(0, len(q_ids), 256):
                    q, own = queries[at : at + 256], q_ids[at : at + 256]
                    product, off = q @ base.T, (slack * np.abs(q).sum(1) + 2.0**-900)[:, None]
                    low = product + np.minimum(q, 0).sum(1)[:, None] - off
                    high = product + np.maximum(q, 0).sum(1)[:, None] + off
                    low[own[:, None] == ids[None, :]] = -np.inf  # a query isn't its own candidate
                    high[own[:, None] == ids[None, :]] = -np.inf
                    least = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
                    i, j = np.nonzero((high >= least[:, None]) & np.isfinite(high))
                    yield pd.DataFrame({"q": own[i], "c": ids[j], "low": low[i, j], "high": high[i, j]})

    return pairs.mapInPandas(bounds, "q long, c long, low double, high double")


#: Figures of the largest score: two doubles' product, summed over any vector.
FIGURES = 660
MOST_LONG = (1 << 63) - 1


def scored(rows: DataFrame, scale: int) -> DataFrame:
    """(q, query_id, vec_id, score, over, rest, scaled) of rows (q, query_id, vec_id, qv, v). A score
    that a long can't hold is told as the nearest long, with over 1 or -1, and rest, a text that
    orders such scores. scaled: the exact score over 2^scale, rounded down."""

    def each(parts):
        for part in parts:
            out = []
            for a, b in zip(part.qv, part.v):
                with np.errstate(over="ignore"):
                    sure = np.abs(a) @ np.abs(b) < 2.0**53
                exact = int(a @ b) if sure else sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
                over = (exact > MOST_LONG) - (exact < -MOST_LONG)
                figures = str(abs(exact)).zfill(FIGURES) if over else ""
                rest = figures if over >= 0 else figures.translate(str.maketrans("0123456789", "9876543210"))
                near = exact / (1 << scale)
                out.append((over * MOST_LONG if over else exact, over, rest, near - abs(near) * 2.0**-50 - 2.0**-1000))
            made = pd.DataFrame(out, columns=["score", "over", "rest", "scaled"])
            yield pd.concat([part[["q", "query_id", "vec_id"]].reset_index(drop=True), made], axis=1)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("q", "query_id", "vec_id", "qv", "v").mapInPandas(each, f"q long, query_id {kind}, vec_id {kind}, score long, over int, rest string, scaled double")


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, first: int | None = None) -> DataFrame:
    """The k highest scores of each query among all other rows, ties to the smaller vec_id:
    (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by `every`. Every row but the query's own is
    a candidate, another of the same vec_id too; rows that repeat a vec_id are queries, and
    candidates, each. A query with fewer candidates has fewer rows; only vectors of its length
    are candidates; empty ones score 0 with one another. Components may be of any size that a
    double has; ranks go by exact scores, and one that a long can't hold is told as the nearest
    long. Empty tables give an empty result; extra columns are ignored.

    Of equal vectors only the k + 1 of the smallest vec_id can be in a result, so only these are
    in the file; a common vector is cut down to them before its shuffle. The file of 8-bit cells
    is scanned in blocks of vectors by blocks of queries, dealt out as a grid. It yields bounds; the
    k-th largest lower bound of a query prunes. Exact vectors are then read in order of their
    bounds: the best `first` (2k) of each query, and after them only those whose bound still
    reaches the k-th exact score found, which makes the result certain.
    """
    spark = embeddings.sparkSession
    vectors = cut(integer_vectors(embeddings).withColumn("row", F.monotonically_increasing_id()))
    most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    shift = max(0, int(most).bit_length() + 1 - CELL_BITS)
    queries = vectors.where(F.col("vec_id") % every == 0)
    among_equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    file = vectors.withColumn("n", among_equal).where(F.col("n") <= k + 1).drop("n")
    grid = min(MOST_STRIPES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = packed(file, shift, True, BLOCK_ROWS).withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(grid)))
    blocks = packed(queries, shift, False, QUERY_BLOCK_ROWS).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1)).cast("array<long>")).alias("stripe"))
    found = cut(scan(cells.join(blocks, ["dim", "stripe"]), k))

    by_low = Window.partitionBy("q").orderBy(F.desc("low"), "c")
    by_high = Window.partitionBy("q").orderBy(F.desc("high"), "c")
    least = found.withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k).groupBy("q").agg(F.when(F.count("*") >= k, F.min("low")).alias("least"))
    left = found.join(least, "q").where("least is null or high >= least")
    left = cut(left.select("q", "c", "high", F.row_number().over(by_high).alias("n")))

    def exactly(rows: DataFrame) -> DataFrame:
        q = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
        c = vectors.select(F.col("row").alias("c"), "vec_id", "v")
        return scored(rows.select("q", "c").join(q, "q").join(c, "c"), 2 * shift)

    first = first or 2 * k
    early = cut(exactly(left.where(F.col("n") <= first)))
    by_score = Window.partitionBy("q").orderBy(F.desc("over"), F.desc("score"), F.desc("rest"), "vec_id")
    sure = early.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("q", F.col("scaled").alias("sure"))
    late = exactly(left.where(F.col("n") > first).join(sure, "q", "left").where("sure is null or high >= sure"))
    return early.unionByName(late).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
