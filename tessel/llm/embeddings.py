"""Embedding near-duplicates by an inverted multi-index.

The two halves of the unit vectors have codebooks of their own, fitted on a bounded sample; their product is a grid of
cells, and every vector lies in one. A vector visits cells by the multi-sequence order of its bounds on the distance
to them and stops at a calibrated bound; what it meets there is verified by cosine in double precision. Cells are cut to
blocks, so that no task gets more than two blocks of rows, and hand on link counts and a spanning forest of the links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import materialize, prepare, read
from tessel.llm.shingles import forest
from tessel.operators.graph import components

WORDS, MOST_WORDS = 8, 256  # of each codebook: so many that a cell holds about a block, from 64 up to 65536 cells
SAMPLE = 4096  # vectors that fit the codebooks and calibrate the bound
BLOCK = 1024
RECALL = 0.999  # of pairs at the threshold, in the calibration
PART = 64  # rows whose walls are held at a time: 64 x 256 x 256 numbers at most
SMALL = 1 << 18  # rows of the table of cell sizes (8 MB) up to which it is broadcast


def finite(vec: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.expr(f"size(`{vec}`) > 0 AND forall(`{vec}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"), F.lit(False))


def codebook(rows: np.ndarray, k: int = WORDS, rounds: int = 12) -> np.ndarray:
    """k-means centres; seeded by farthest points, so that the result depends on the rows only."""
    centres = [rows[0]]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(rows))):
        centres.append(rows[int(far.argmax())])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = distances(rows, c).argmin(axis=1)
        c = np.array([rows[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)


def bounds(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The squared distance of each row to each centre's Voronoi cell, from below: that to the farthest of its walls."""
    d = distances(rows, centres)
    apart = np.sqrt(np.maximum(distances(centres, centres), 0))
    out = np.empty_like(d)
    for i in range(0, len(rows), PART):
        part = d[i : i + PART]
        wall = np.where(apart > 1e-9, (part[:, :, None] - part[:, None, :]) / (2 * np.maximum(apart, 1e-9)), 0)
        out[i : i + PART] = np.maximum(wall.max(axis=2), 0) ** 2
    return out


def words_for(rows: int) -> int:
    """The words of each codebook for so many vectors: the grid grows with them."""
    return min(MOST_WORDS, max(WORDS, int(np.ceil(np.sqrt(rows / BLOCK)))))


def multi_sequence(a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of a[i] + b[j], as long as that is at most stop (Babenko and Lempitsky, 2012)."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > stop:
            return
        yield int(ia[i]), int(ib[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(ia) and y < len(ib) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[ia[x]] + b[ib[y]], x, y))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, threshold: float, recall: float, words: int = WORDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebooks of the halves, and the bound within which a partner at the threshold lies with the recall asked for.

    Partners are drawn in random directions at exactly the threshold; the bound is the quantile of what they need. With
    a recall of 1 it is the squared distance at the threshold, beyond which no partner can lie.
    """
    half = sample.shape[1] // 2
    books = codebook(sample[:, :half], words), codebook(sample[:, half:], words)
    most = 2 - 2 * threshold
    if recall >= 1:
        return *books, most * (1 + 1e-9)
    rng = np.random.default_rng(seed)
    need = []
    for n in (rng.normal(size=sample.shape) for _ in range(8)):
        side = n - (n * sample).sum(axis=1, keepdims=True) * sample
        size = np.sqrt((side * side).sum(axis=1, keepdims=True))
        other = threshold * sample + (1 - threshold**2) ** 0.5 * side / np.maximum(size, 1e-12)
        u, v = (distances(h, c).argmin(axis=1) for h, c in zip((other[:, :half], other[:, half:]), books, strict=True))
        rows = np.arange(len(sample))
        need.append(bounds(sample[:, :half], books[0])[rows, u] + bounds(sample[:, half:], books[1])[rows, v])
    return *books, min(most * (1 + 1e-9), float(np.quantile(np.concatenate(need), recall)) + 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _assign(index: dict, words: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, visits = [0] * batch.num_rows, [[0]] * batch.num_rows
            dims = np.array(batch.column(1).value_lengths())
            for dim, (a, b, stop) in index.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    u = unit(_matrix(batch.column(1).take(pa.array(at))))
                    half = dim // 2
                    la, lb = bounds(u[:, :half], a), bounds(u[:, half:], b)
                    own = distances(u[:, :half], a).argmin(axis=1) * words + distances(u[:, half:], b).argmin(axis=1)
                    for i, cell, x, y in zip(at.tolist(), own.tolist(), la, lb, strict=True):
                        cells[i] = cell
                        visits[i] = sorted({cell, *(p * words + q for p, q in multi_sequence(x, y, stop))})
            yield pa.record_batch({"rep": batch.column(0), "cell": pa.array(cells, pa.int32()), "visits": pa.array(visits, pa.list_(pa.int32()))})

    return assign


def _visited(visits: pa.ListArray, cells: np.ndarray) -> np.ndarray:
    """Whether each cell is in each list of cells, a row per cell."""
    own, at = np.unique(cells, return_inverse=True)
    flat, row = visits.flatten().to_numpy(), np.repeat(np.arange(len(visits)), np.asarray(visits.value_lengths()))
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    there = np.zeros((len(own), len(visits)), bool)
    hit = own[place] == flat
    there[place[hit], row[hit]] = True
    return there[at]


def _tile(threshold: float):
    def tile(table: pa.Table) -> pa.Table:
        """Counts (rep, null, links) and links (u, v, null) of one pair of blocks."""
        table = table.combine_chunks()
        member = table["member"].to_numpy(zero_copy_only=False).astype(bool)
        rep, weight, cell = (table[c].to_numpy() for c in ("rep", "weight", "own"))
        at, by = np.flatnonzero(member), np.flatnonzero(~member)
        counts, us, vs = np.zeros(len(rep), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(at) and len(by):
            u = unit(_matrix(table["vec"].combine_chunks()))
            near = u[by] @ u[at].T >= threshold
            near &= rep[by][:, None] != rep[at][None, :]
            counts[by] = near @ weight[at]
            back = _visited(table["visits"].combine_chunks().take(pa.array(at)), cell[by])  # does the member come to the visitor's cell?
            counts[at] += (near & ~back).T @ weight[by]
            us, vs = forest(*np.nonzero(near), rep[by], rep[at])
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full), pa.int64()), pa.nulls(len(us), pa.int64())
        return pa.table({"u": pa.concat_arrays([pa.array(rep[full], pa.int64()), pa.array(us, pa.int64())]), "v": pa.concat_arrays([none[0], pa.array(vs, pa.int64())]), "n": pa.concat_arrays([pa.array(counts[full], pa.int64()), none[1]])})

    return tile


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = RECALL, words: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept (id is its component's smallest), a row per input row.

    Vectors of the same length and label link at a cosine of at least threshold in double precision, each pair found
    with the recall of the calibration (see fit; 1 finds all). n_links counts the other rows linked directly, equal
    vectors included; component_id is the smallest id reachable. Vectors that are null, empty, zero or hold null or
    non-finite components, and those with a null label, link with nothing. A null id links with nothing and has neither
    component nor kept. Ids are whole numbers. Other columns are not read. No rows give no rows. words of each codebook
    follow from the number of vectors (see words_for) unless they are given.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.col(f"`{label_col}`").alias("label"))
    good = finite("vec") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("good", good), "vectors")
    valid = rows.where("good").drop("good")
    distinct = materialize(valid.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "distinct")
    total = distinct.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("rep")).select("vec").limit(2 * SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for (v,) in drawn:
        by_dim.setdefault(len(v), []).append(v)
    words = words or words_for(total)
    index = {dim: fit(unit(np.array(v)), threshold, recall, words) for dim, v in by_dim.items() if dim > 1}
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    found = distinct.select("rep", "vec").mapInArrow(_assign(index, words), schema)
    placed = distinct.join(found, "rep").withColumn("dim", F.size("vec")).withColumnRenamed("cell", "own")
    placed = materialize(placed, "placed")
    key = ["label", "dim", "cell"]
    visits = placed.withColumn("cell", F.explode("visits")).withColumn("visits", F.array().cast("array<int>"))  # only members' are asked
    sizes = placed.withColumn("cell", F.col("own")).groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("mbs"))
    sizes = materialize(sizes.join(visits.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("vbs")), key), "sizes")
    if sizes.count() <= SMALL:
        sizes = F.broadcast(sizes)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    cols = [*key, "mb", "vb", "member", "rep", "weight", "own", "visits", "vec"]
    members = placed.withColumn("cell", F.col("own")).join(sizes, key).withColumns({"member": F.lit(True), "mb": dealt("mbs"), "vb": spread("vbs")})
    visitors = visits.join(sizes, key).withColumns({"member": F.lit(False), "vb": dealt("vbs"), "mb": spread("mbs")})
    tiles = members.select(cols).unionByName(visitors.select(cols)).groupBy(*key, "mb", "vb").applyInArrow(_tile(threshold), "u long, v long, n long")
    tiles = materialize(tiles, "tiles")
    comps = components(tiles.where("v IS NOT NULL").select("u", "v"), "u", "v")
    counts = tiles.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    of = distinct.select("label", "vec", "rep", "weight").join(comps, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("u"), "left")
    of = materialize(of.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")), "of")
    linked = valid.join(of, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op8: links and components of all rows of embeddings."""
    return embedding_groups(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
