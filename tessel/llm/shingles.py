"""Word shingles of texts, links as forests, and the exact similarity of shingle sets within candidate groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize

SEED = 42
BLOCK = 1024  # sets of a block, as a mean
VOLUME = 1 << 21  # shingles of a block, as a mean
BROADCAST = 1 << 20  # rows of candidates (40 MB) up to which they are sent to all tasks instead of shuffling all texts


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; of the whole sequence where it has fewer words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in own))
    starts = [0, *ends]
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)), np.uint64, len(own) - words + 1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_id(own: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    found = xxhash.xxh3_64_intdigest(own.tobytes(), SEED)
    return found - (1 << 64) * (found >> 63)


def forest(rows: np.ndarray, cols: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smallest node of its group) that join what the pairs a[rows], b[cols] join."""
    nodes, at = np.unique(np.concatenate([a[rows], b[cols]]), return_inverse=True)
    x, y = at[: len(rows)], at[len(rows) :]
    group = np.arange(len(nodes))
    while True:
        low, was = np.minimum(group[x], group[y]), group.copy()
        np.minimum.at(group, x, low)
        np.minimum.at(group, y, low)
        group = group[group]
        if (group == was).all():
            break
    moved = np.flatnonzero(group != np.arange(len(nodes)))
    return nodes[moved], nodes[group[moved]]


def near_pairs(a: list[np.ndarray], b: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of non-empty sets (one of a, one of b) with a Jaccard similarity of at least least."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    left, right = at[: na.sum()], at[na.sum() :]
    starts, ends, rows, cols = np.concatenate([[0], np.cumsum(nb)[:-1]]), np.cumsum(na), [], []
    held = np.zeros(len(values), np.int32)
    for i in range(len(a)):
        mine = left[ends[i] - na[i] : ends[i]]
        held[mine] = 1
        both = np.add.reduceat(held[right], starts)
        held[mine] = 0
        near = np.flatnonzero(both >= least * (na[i] + nb - both) - 1e-9)
        rows.append(np.full(len(near), i))
        cols.append(near)
    return np.concatenate(rows), np.concatenate(cols)


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # an id can have the same text many times
        for batch in batches:
            rows = []
            for node, comp, part, parts, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node not in done and set_id(own := shingle_set(text, words)) == node:  # an id can have other texts
                    done.add(node)
                    rows.append((comp, part, parts, node, own.tobytes()))
            yield pa.record_batch({k: pa.array([r[i] for r in rows], pa.binary() if k == "own" else pa.int64()) for i, k in enumerate(("comp", "part", "parts", "node", "own"))})

    return sets


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block of rows that come in its order, each node once."""
    key, held = None, {}

    def block() -> pa.RecordBatch:
        return pa.record_batch({"comp": pa.array([key[0]], pa.int64()), "part": pa.array([key[1]], pa.int64()), "parts": pa.array([key[2]], pa.int64()), "n": pa.array([list(held)], pa.list_(pa.int64())), "s": pa.array([list(held.values())], pa.list_(pa.binary()))})

    for batch in batches:
        for comp, part, parts, node, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != (comp, part, parts):
                if key:
                    yield block()
                key, held = (comp, part, parts), {}
            held.setdefault(node, own)
    if key:
        yield block()


def _confirm(least: float):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (na, sa), (nb, sb) = ((np.asarray(batch.column(n)[i].values), [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(s)[i].values]) for n, s in (("na", "sa"), ("nb", "sb")))
                rows, cols = near_pairs(sa, sb, least)
                u, v = forest(rows, cols, na, nb)
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return confirm


def confirmed(docs: DataFrame, held: DataFrame, words: int, least: float) -> DataFrame:
    """u, v: links that join all sets of a candidate group with a Jaccard similarity of at least least.

    docs: doc and text; held: doc, node (its set), n (the set's size) and comp (the set's group). Within a group every
    pair of sets is compared, block by block, so that no task holds more than two blocks of a large group. Sets move once.
    """
    sizes = held.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / VOLUME)).alias("parts"))
    held = held.join(sizes, "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    held = materialize(held.select("doc", "node", "comp", "part", "parts"), "held")
    small = F.broadcast if held.count() <= BROADCAST else lambda x: x  # beyond it the texts shuffle
    mine = docs.join(small(held), "doc").select("node", "comp", "part", "parts", "text")
    sets = mine.mapInArrow(_sets(words), "comp long, part long, parts long, node long, own binary")
    sets = sets.repartition("comp", "part").sortWithinPartitions("comp", "part")
    blocks = materialize(sets.mapInArrow(_blocks, "comp long, part long, parts long, n array<long>, s array<binary>"), "blocks")
    alone = blocks.select(F.col("n").alias("na"), F.col("s").alias("sa"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    left = blocks.where("part + 1 < parts").select("comp", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = blocks.where("parts > 1").select("comp", "part", F.col("n").alias("nb"), F.col("s").alias("sb"))
    tiles = alone.unionByName(left.join(right, ["comp", "part"]).select("na", "sa", "nb", "sb"))  # a row per pair of blocks
    return tiles.mapInArrow(_confirm(least), "u long, v long").distinct()
