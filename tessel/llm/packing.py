"""Packing of documents into fixed windows by non-negative least squares over the histogram of lengths.

Documents are tokenized and cut into full windows and a remainder. Shallow combinations of up to three remainder lengths
that fill a window exactly are enumerated; accelerated projected gradient solves for their non-negative repeat counts
against the histogram of all remainders. Each task then rounds its share of the solution to whole repeats, takes its own
remainders for them, and packs what is left greedily: pairs that fill a window first, then end to end, cut at the window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.bpe import PATTERN, byte_chars, tokenizer_path
from tessel.llm.common import materialize, prepare, read

WINDOW = 1024
END = 0
HELD = 1 << 24  # tokens that a task packs at a time (64 MB); each such part ends with one window that may not be full
LONG = 1 << 20  # characters from which a text goes to the slower library, whose time and stack stay bounded


@lru_cache(maxsize=2)
def _fast(path: str):
    """The vocabulary of a byte-level file as ranks; every token of it but the added ones, which are matched first, encodes to itself, so both libraries agree."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_chars()
    ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> list[int]:
    if len(text or "") >= LONG:
        return _library(path).encode(text, add_special_tokens=False).ids
    return _fast(path).encode(text or "", allowed_special="all")


def _tokenize(path: str, end: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array([*token_ids(t, path), end], "<u4") for t in batch.column(1).to_pylist()]
            kind = "<u2" if all(not len(x) or x.max() < 1 << 16 for x in ids) else "<u4"
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "ids", "doc_tokens"]
            )

    return tokenize


def strategies(lengths: np.ndarray, window: int) -> np.ndarray:
    """All combinations of two or three of the lengths that sum to window, a row each, the missing third as 0."""
    there = np.zeros(window + 1, bool)
    there[lengths[(lengths > 0) & (lengths < window)]] = True
    a, b = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= 0) & (c >= b) & (a >= c) & (c > 0) & there[a] & there[np.clip(c, 0, window)] & (there[b] | (b == 0))
    return np.stack([a[ok], c[ok], b[ok]], axis=1)


def solve(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimizes |A x - histogram|, where column j of A counts the lengths in rows[j] (length 0 is free)."""
    size = len(histogram)
    flat = rows.ravel()
    weight = (flat > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, 3) * weight, minlength=size)

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[flat] * weight).reshape(-1, 3).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 1 / (1.01 * norm or 1)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * backward(forward(y) - histogram))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def repeats(x: np.ndarray, share: float, rows: np.ndarray, count: np.ndarray, phase: float) -> np.ndarray:
    """Whole repeats of each strategy: x * share in systematic rounding, at most what count still has of its lengths."""
    ends = np.floor(np.cumsum(x * share) + phase)
    wanted = np.diff(ends, prepend=np.floor(phase)).astype(np.int64)
    out = np.zeros(len(rows), np.int64)
    for j in np.flatnonzero(wanted):
        own = [n for n in rows[j].tolist() if n]
        n = min(int(wanted[j]), *(int(count[i]) // own.count(i) for i in set(own)))
        if n:
            out[j] = n
            for i in own:
                count[i] -= n
    return out


def place(remainders: np.ndarray, rows: np.ndarray, x: np.ndarray, total: int, window: int, phase: float) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """For each remainder its pieces (from, length, window number, offset), and the number of windows.

    remainders: lengths, 0 for none. total: the number of remainders that x was solved for.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in remainders]
    queue: dict[int, list[int]] = {}
    for i in np.flatnonzero(remainders).tolist():
        queue.setdefault(int(remainders[i]), []).append(i)
    count = np.bincount(remainders, minlength=window + 1)
    count[0] = 0
    used = 0
    if len(rows) and total:
        own = repeats(x, count.sum() / total, rows, count, phase)
        for j in np.flatnonzero(own):
            lengths = [n for n in rows[j].tolist() if n]
            for _ in range(int(own[j])):
                at = 0
                for n in lengths:
                    out[queue[n].pop()].append((0, n, used, at))
                    at += n
                used += 1
    for n in range(window - 1, (window - 1) // 2, -1):  # greedy: pairs that fill a window
        a, b = queue.get(n, []), queue.get(window - n, [])
        while a and b and (a is not b or len(a) > 1):
            out[a.pop()].append((0, n, used, 0))
            out[b.pop()].append((0, window - n, used, n))
            used += 1
    at = 0
    for n in sorted(queue, reverse=True):  # greedy: end to end, cut at the window
        for i in queue[n]:
            done = 0
            while done < n:
                take = min(n - done, window - at)
                out[i].append((done, take, used, at))
                done, at = done + take, at + take
                if at == window:
                    used, at = used + 1, 0
    return out, used + (at > 0)


def _pack(rows: np.ndarray, x: np.ndarray, total: int, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = part = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, part
            part += 1
            n = np.array([d[2] for d in held])
            tails, used = place(n % window, rows, x, total, window, (part * 0.61803 + (base >> 36) * 0.41421) % 1)
            docs, start, length, ids, tokens, sequence, offset = [], [], [], [], [], [], []
            for (doc, raw, count), tail in zip(held, tails, strict=True):
                own = np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4").tobytes()
                full = count - count % window
                cuts = [(i, window, used + i // window, 0) for i in range(0, full, window)] + [(full + a, k, s, o) for a, k, s, o in tail]
                used += full // window
                for a, k, s, o in cuts:
                    docs.append(doc)
                    start.append(a)
                    length.append(k)
                    ids.append(own[4 * a : 4 * (a + k)])
                    tokens.append(count)
                    sequence.append(base + s)
                    offset.append(o)
            base += used
            longs = [pa.array(c, pa.int64()) for c in (start, length, tokens, sequence, offset)]
            whole = pa.RecordBatch.from_arrays([pa.array(docs, id_type), *longs, pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            held.clear()
            for i in range(0, whole.num_rows, 5000):
                yield whole.slice(i, 5000)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += row[2]
                if size >= HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit, binary), a row per piece.

    A document is its text's ids and then end; null and empty texts are end alone. Every id lies in exactly one piece,
    and a sequence's pieces lie in it from 0 without gaps. All sequences hold window ids but one at most for each task
    or HELD ids. Sequence ids are unique and have gaps between tasks. Rows with the same or a null id are documents of
    their own. Other columns are not read. No rows give no rows. The driver sees the histogram of remainders (at most
    window rows) and the tasks the solution (at most one number for each combination), whatever the size of the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_path()
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])
    tokens = materialize(docs.mapInArrow(_tokenize(path, end), schema), "tokens")
    histogram = np.zeros(window + 1)
    for n, count in tokens.groupBy((F.col("doc_tokens") % window).alias("n")).count().collect():
        histogram[n] = count
    histogram[0] = 0
    rows = strategies(np.flatnonzero(histogram), window)
    x = solve(rows, histogram) if len(rows) else np.zeros(0)
    rows, x = rows[x > 1e-9], x[x > 1e-9]
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("ids", T.BinaryType())])
    return tokens.mapInArrow(_pack(rows, x, int(histogram.sum()), window), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of 1024 ids."""
    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
