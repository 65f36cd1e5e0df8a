"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are dealt to blocks that keep a list per component, sorted by value. For a query the lists are read in turn
from the end that favours it, some entries further a round; what was read gives every candidate a lower and an upper
bound on its score. Reading stops when those never read cannot reach the k-th best score any more and few of those read
can; their final scores are then taken exactly. A block is met by blocks of queries, and the best of each meeting merge
by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import materialize, prepare, read
from tessel.llm.embeddings import finite

CANDIDATES = 1 << 14  # rows of a block, as a mean
LIST = 1 << 10  # rows whose lists are read together; the k-th score of one part is the bar of the next
FIRST = 512  # rows of the first part, which has no bar yet
QUERIES = 128
STEPS = 8  # rounds in which a list is read to its end
FEW = 4  # reading goes on while more than one in so many rows can still be among the best
MEETINGS = 1000  # blocks are copied for groups of queries until there are so many tasks; from so many blocks on none is


class Lists:
    """Sorted lists of a block's rows: for each component the row numbers from either end, and the values so ordered.

    values[1] is negated, so that with the sizes of a query's components both ends read in descending order.
    """

    def __init__(self, rows: np.ndarray):
        order = np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32)
        values = np.take_along_axis(rows.T, order, axis=1).astype(np.float64)
        self.order = np.stack([order, order[:, ::-1]])
        self.values = np.stack([values, -values[:, ::-1]])

    def __len__(self) -> int:
        return self.order.shape[2]


def nra(q: np.ndarray, lists: Lists, k: int, least: float = -np.inf, skip: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The rows that may be among the k best with a score of at least `least`, and the share of the lists that was read.

    Every list is read from the end that favours the query, all to the same depth. What was read of a row counts in both
    bounds; for its other components the upper bound takes the value where reading stands, the lower bound the list's
    worst. The bar is the greater of least and the k-th lower bound. Reading stops once rows that no list has shown
    cannot reach the bar and no more than a few rows can, or at the end of the lists. Rows in skip are out.
    """
    n, size, way, each = len(lists), np.abs(q), (q < 0).astype(np.int64), np.arange(len(q))
    bottom, known = size * lists.values[way, each, n - 1], bool(np.isfinite(least))
    few, step = max(4 * k, n // FEW), max(1, n // STEPS)
    low, depth = 1, step
    if known:
        high = n
        while low < high:  # no bound can stop the reading before this depth, so it goes there at once
            half = (low + high) // 2
            low, high = (low, half) if size @ lists.values[way, each, half - 1] < least else (half + 1, high)
        depth = low
    while True:
        at, got = lists.order[way, each, :depth].ravel(), lists.values[way, each, :depth]
        front, bar = got[:, -1] * size, least
        upper = np.bincount(at, weights=(size[:, None] * (got - got[:, -1:])).ravel(), minlength=n) + front.sum()
        if skip is not None:
            upper[skip] = -np.inf
        if not known and n >= k:
            lower = np.bincount(at, weights=(size[:, None] * got - bottom[:, None]).ravel(), minlength=n) + bottom.sum()
            if skip is not None:
                lower[skip] = -np.inf
            bar = np.partition(lower, n - k)[n - k]
        open_ = np.flatnonzero(upper >= bar - 1e-6 * max(1.0, abs(bar))) if np.isfinite(bar) else np.flatnonzero(upper > -np.inf)
        if depth == n or (front.sum() < bar and len(open_) <= few):
            return open_, depth / n
        depth = min(n, depth + step)


def _best(q: np.ndarray, qid: int, parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of all parts; the k-th score of those met is the bar of the next."""
    score, vec = np.empty(0, np.int64), np.empty(0, np.int64)
    for rows, ids, lists in parts:
        at, _ = nra(q.astype(np.float64), lists, k, float(score[-1]) if len(score) == k else -np.inf, ids == qid)
        score, vec = np.concatenate([score, rows[at] @ q]), np.concatenate([vec, ids[at]])
        top = np.lexsort((vec, -score))[:k]
        score, vec = score[top], vec[top]
    return score, vec


def _meet(k: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                block, bids, raw, kind, dim, qids, qraw, qkind = (batch.column(c)[i].as_py() for c in ("cb", "ids", "rows", "kind", "dim", "qids", "qrows", "qkind"))
                if (dim, block) != last:
                    last, ids = (dim, block), np.frombuffer(bids, np.int64)
                    rows = np.frombuffer(raw, kind).astype(np.int64).reshape(-1, dim)
                    cuts = [0, *range(FIRST, len(ids), LIST), len(ids)] if len(ids) > FIRST else [0, len(ids)]
                    parts = [(rows[a:b], ids[a:b], Lists(rows[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                out = []
                for qid, q in zip(np.frombuffer(qids, np.int64).tolist(), np.frombuffer(qraw, qkind).astype(np.int64).reshape(-1, dim), strict=True):
                    score, vec = _best(q, qid, parts, k)
                    out.append((np.full(len(vec), qid), vec, score))
                q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return meet


def _block(name: str):
    def block(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().astype(np.int64)
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
        ids = table["id"].to_numpy().astype(np.int64).tobytes()
        return pa.table({"dim": pa.array([int(table["dim"][0].as_py())], pa.int32()), name: pa.array([table[name][0].as_py()], pa.int64()), "ids": pa.array([ids], pa.binary()), "rows": pa.array([x.astype(kind).tobytes()], pa.binary()), "kind": pa.array([kind])})

    return block


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of each query, all of them if there are fewer.

    Components become floor(scale * x); the score is their inner product in 64-bit integers. Queries are the vectors
    whose id is divisible by every, candidates all with another id and the same length; ties go to the smaller id.
    Vectors that are null, empty or hold null or non-finite components, and those with a null id, take no part. Repeated
    rows are rows of their own: each is a candidate, and the best of all rows with a query's id are ranked together.
    Ids are whole numbers. Other columns are not read. No rows give no rows. Scores beyond 64 bits overflow.

    Every block of candidates meets every query, which the task asks for; a block moves once, or a bounded number of
    times where blocks are few, and the queries are copied to the blocks.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(finite("vec") & F.col("id").isNotNull())
    rows = rows.select("id", F.size("vec").alias("dim"), F.transform("vec", lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "integers")  # equal rows are dealt apart
    queries = rows.where(F.col("id") % every == 0)
    blocks, asked = 1 + rows.count() // CANDIDATES, 1 + queries.count() // QUERIES
    groups = max(1, min(asked, MEETINGS // blocks))
    deal = lambda n: F.pmod(F.xxhash64("n"), F.lit(n).cast("long"))
    schema = lambda name: f"dim int, {name} long, ids binary, rows binary, kind string"
    left = rows.withColumn("cb", deal(blocks)).groupBy("dim", "cb").applyInArrow(_block("cb"), schema("cb"))
    right = queries.withColumn("qb", deal(asked)).groupBy("dim", "qb").applyInArrow(_block("qb"), schema("qb"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = materialize(left, "candidates").withColumn("qg", each(groups))
    right = materialize(right, "queries").withColumn("qg", F.col("qb") % groups).withColumn("cb", each(blocks))
    right = right.select("dim", "qg", "cb", F.col("ids").alias("qids"), F.col("rows").alias("qrows"), F.col("kind").alias("qkind"))
    tasks, key = min(blocks * groups, 100_000), ["dim", "cb", "qg"]
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the five best of all rows of embeddings for every fiftieth id."""
    return top_k(read(spark, sf_dir, "embeddings"))
