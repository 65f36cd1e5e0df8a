"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that are equal collapse to one. The rest go to buckets by the population counts of their two 32-bit halves
and, within a bucket, to blocks. Two fingerprints within the radius have halves whose population counts differ by no
more than it in sum, so only tiles (pairs of blocks) of such buckets are compared: exclusive-or and bit counts in
numpy. A tile hands on a spanning forest of its links, so a dense group of near copies costs its size in links.

Near copies by a similarity of word shingles come by the same tiles, over longer fingerprints and buckets by the number
of shingles, and are confirmed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize, prepare, read
from tessel.llm.shingles import SEED, confirmed, forest, set_id, shingle_hashes, shingle_set
from tessel.operators.graph import components

BLOCK = 2048  # fingerprints of a block, as a mean
TILES = 256  # tiles of a task, as a mean
MOST_TASKS = 100_000
HALF, WHOLE = 46, 72  # bits of the first 128 and of all 256 in which near copies differ at most

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, 4, np.uint64) << np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, 2, np.uint64) << np.uint64(1) | np.uint64(1)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; zero without hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    for i in range(0, n, 255):
        counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _prints(words: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], names=["doc", "fp"])

    return prints


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                fa, ra, fb, rb = (np.asarray(batch.column(c)[i].values) for c in ("a_fp", "a_rep", "b_fp", "b_rep"))
                fa, fb, rows, cols = fa.view(np.uint64), fb.view(np.uint64), [], []
                for k in range(0, len(fa), 64):
                    x, y = np.nonzero(np.bitwise_count(fa[k : k + 64, None] ^ fb[None, :]) <= radius)
                    rows.append(x + k)
                    cols.append(y)
                u, v = forest(np.concatenate(rows), np.concatenate(cols), ra, rb)
                us.append(u)
                vs.append(v)
            yield pa.record_batch({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return compare


def _tiles(rows: DataFrame, keys: list[str], steps: list[tuple[int, ...]], cols: list[str], block: int) -> DataFrame:
    """A row per tile: the arrays a_<col> and b_<col> of two blocks whose buckets differ by one of steps, itself included.

    A bucket is cut to blocks by its size, by a hash of the first column, which tells rows apart. Tiles are dealt by
    their right block and counted, so that no bucket is hot and no task gets many. Buckets are few and broadcast.
    """
    sizes = materialize(rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("parts")), "sizes")
    dealt = rows.join(F.broadcast(sizes), keys).withColumn("part", F.pmod(F.xxhash64(cols[0]), F.col("parts")))
    blocks = dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    blocks = materialize(blocks.select(*keys, "part", *[F.col(f"rows.{c}").alias(c) for c in cols]), "blocks")
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, s, strict=True)]) for s in steps])).alias("s")
    own = F.lit(True)
    for k in keys:
        own = own & (F.col(f"s.{k}") == 0)
    left = blocks.select(step, *keys, F.col("part").alias("pa"), *[F.col(c).alias(f"a_{c}") for c in cols])
    left = left.select(own.alias("own"), *[(F.col(k) + F.col(f"s.{k}")).alias(k) for k in keys], "pa", *[f"a_{c}" for c in cols])
    left = left.join(F.broadcast(sizes), keys).withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.where(~F.col("own") | (F.col("pa") <= F.col("pb")))
    right = blocks.select(*keys, F.col("part").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    tasks = min(MOST_TASKS, 1 + (sizes.agg(F.sum("parts")).first()[0] or 0) * len(steps) // TILES)
    met = left.repartition(tasks, *keys, "pb").join(right.repartition(tasks, *keys, "pb"), [*keys, "pb"])
    return met.select(*[f"{side}_{c}" for side in "ab" for c in cols])


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """u, v: links that join all rows (fp, rep) whose fp differ in at most radius bits; both columns unique."""
    half = F.lit((1 << 32) - 1)
    keyed = prints.select("fp", "rep", F.bit_count(F.col("fp").bitwiseAND(half)).alias("lo"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"))
    steps = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) >= (0, 0)]
    return _tiles(keyed, ["lo", "hi"], steps, ["fp", "rep"], BLOCK).mapInArrow(_compare(radius), "u long, v long").distinct()


def wide_print(own: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: those that are set in over half of the hashes of a set, each mixed four times."""
    x = (own[:, None] ^ _XOR) * _ODD[0]
    x = (x ^ x >> np.uint64(29)) * _ODD[1]
    bits = np.unpackbits((x ^ x >> np.uint64(32)).astype(">u8").view(np.uint8).reshape(len(own), 32), axis=1)
    counts = np.zeros(256, np.int64)
    for i in range(0, len(own), 255):
        counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(own)).view(">u8").astype(np.uint64)


def _sketches(words: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            wide = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, 4).view(np.int64)
            cols = {"doc": batch.column(0), "node": pa.array([set_id(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())}
            yield pa.record_batch(cols | {f"f{i}": pa.array(wide[:, i], pa.int64()) for i in range(4)})

    return sketches


def _compare_wide(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                a, b = ([np.asarray(batch.column(f"{s}_{c}")[i].values) for c in ("node", "n", "f0", "f1", "f2", "f3")] for s in "ab")
                fa, fb = ([f.view(np.uint64) for f in x[2:]] for x in (a, b))
                rows, cols = [], []
                for k in range(0, len(a[0]), 64):
                    bits = np.bitwise_count(fa[0][k : k + 64, None] ^ fb[0]) + np.bitwise_count(fa[1][k : k + 64, None] ^ fb[1])
                    x, y = np.nonzero(bits <= HALF)
                    whole = bits[x, y] + np.bitwise_count(fa[2][x + k] ^ fb[2][y]) + np.bitwise_count(fa[3][x + k] ^ fb[3][y])
                    sizes = np.minimum(a[1][x + k], b[1][y]) >= least * np.maximum(a[1][x + k], b[1][y]) - 1e-9
                    near = (whole <= WHOLE) & sizes
                    rows.append(x[near] + k)
                    cols.append(y[near])
                u, v = forest(np.concatenate(rows), np.concatenate(cols), a[0], b[0])
                us.append(u)
                vs.append(v)
            yield pa.record_batch({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return compare


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """id and component_id (the smallest id reachable by links, itself included), a row per row of docs that has an id.

    Texts link whose sets of word shingles have a Jaccard similarity of at least least; a text with fewer words than a
    shingle has its whole sequence as the only one. Equal sets collapse to one. Fingerprints of 256 bits are compared tile
    by tile to find candidates: sets whose sizes allow the similarity and whose fingerprints differ in at most WHOLE bits,
    and HALF of the first 128. Two sets at 0.8 differ in 39 bits and rarely in more than 62 (small sets: 48 and 72), so
    the chance to miss such a pair is below 1e-4, for sets of 20 shingles or more below 1e-7; unrelated sets differ in
    128, and hardly ever in 72. The exact similarity then decides within the candidates' groups.

    Texts without words, null ones included, are copies of each other. Rows with the same id stay apart as rows and link
    by their own texts. Rows with a null id are left out and link nothing. Ids are whole numbers. No rows give no rows.
    least is 0.8 or more. Comparisons grow with the square of the distinct sets of similar sizes.
    """
    prepare(docs.sparkSession)
    if least < 0.8:
        raise ValueError("the fingerprints find similarities of 0.8 or more")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc IS NOT NULL")
    prints = ["f0", "f1", "f2", "f3"]
    sketches = materialize(docs.mapInArrow(_sketches(words), "doc long, node long, n long, f0 long, f1 long, f2 long, f3 long"), "sketches")
    distinct = materialize(sketches.groupBy("node", "n", *prints).agg(F.min("doc").alias("rep")), "distinct")
    keyed = distinct.where("n > 0").withColumn("class", F.floor(-F.log(F.col("n").cast("double")) / float(np.log(least)) + 1e-9))
    loose = _tiles(keyed, ["class"], [(0,), (1,)], ["node", "n", *prints], 2 * BLOCK).mapInArrow(_compare_wide(least), "u long, v long").distinct()
    held = components(loose, "u", "v").join(distinct, "node").select(F.col("rep").alias("doc"), "node", "n", "comp")
    links = confirmed(docs, materialize(held, "candidates"), words, least)
    of = distinct.select("node", "rep").join(components(links, "u", "v"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = materialize(of.join(lowest, "comp").select("node", "component_id"), "groups")
    return sketches.select("doc", "node").join(of, "node").select(F.col("doc").alias("id"), "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """id, fp (64 bits as a long) and component_id (the smallest id reachable by links, itself included), a row per input row.

    Fingerprints link at radius or fewer differing bits. Texts without words, null ones included, have fingerprint zero
    and link like any other. Rows with the same id stay apart as rows and link by their own fingerprints. A row with a
    null id links nothing; its component is that of its fingerprint, null if no other row has it. Ids are whole numbers.
    No rows give no rows. Comparisons grow with the square of the distinct fingerprints, about an eighth of all pairs.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(docs.mapInArrow(_prints(words), "doc long, fp long"), "prints")
    distinct = materialize(prints.where("doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("rep")), "distinct")
    found = components(near_links(distinct, radius), "u", "v")
    of = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("comp", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select(F.col("doc").alias("id"), "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: fingerprint and component of every whole text of documents."""
    found = simhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
