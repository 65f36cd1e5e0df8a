"""Removal of lines that many documents share.

Two Bloom filters hold the hashes of keys seen once and seen twice. Tasks build a pair over their own documents; pairs
merge block by block (a hash is seen twice if either side has it twice or both have it once), so only filter blocks
move. A second pass probes the twice-seen filter, and only suspected repeats shuffle: with their whole keys, which
confirms them exactly and chooses the document that keeps the line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessel.llm.common import REST, materialize, prepare, read, rest

BLANK = b" \t\n\x0b\x0c\r"
BLOCK = 1024  # bytes of a filter block
HASHES = 4


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased (bytes.lower() changes those only)."""
    return line.strip(BLANK).lower()


def _keys(text: str | None, least: int) -> set[bytes]:
    """The distinct keys of a text that have at least so many code points."""
    found = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if len(line) >= least:
            key = line_key(line)
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least):
                found.add(key)
    return found


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)])


def _put(filter_: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(filter_, (flat >> np.uint64(3)).astype(np.int64), np.left_shift(1, (flat & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _has(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    got = filter_[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)
    return (got & 1).all(axis=0)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)


def _build(bits: int, least: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            own = [k for text in batch.column(0).to_pylist() for k in _keys(text, least)]
            if own:
                hashes, times = np.unique(_hashes(own), return_counts=True)
                places = _places(hashes, bits)
                _put(twice, places[:, (times > 1) | _has(once, places)])
                _put(once, places)
        full = np.flatnonzero(once.reshape(-1, BLOCK).any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 4096)):
            if len(part):
                yield pa.record_batch(
                    {
                        "block": pa.array(part, pa.int64()),
                        "once": pa.array([zlib.compress(once[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in part], pa.binary()),
                        "twice": pa.array([zlib.compress(twice[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in part], pa.binary()),
                    }
                )

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the blocks of all tasks; memory holds the blocks dealt to this partition, whatever the number of tasks."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in pair)
            if block in held:
                a, b = held[block]
                held[block] = [a | once, b | twice | (a & once)]
            else:
                held[block] = [once, twice]
    found = [(k, b.tobytes()) for k, (_, b) in held.items() if b.any()]
    if found:
        yield pa.record_batch({"block": pa.array([k for k, _ in found], pa.int64()), "twice": pa.array([b for _, b in found], pa.binary())})


def seen_twice(docs: DataFrame, text: str, least: int, max_bits: int) -> tuple[int, np.ndarray]:
    """The merged twice-seen filter and its size in bits; a key of two documents is always in it."""
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1)).first()[0] or 1
    bits = 1 << 16
    while bits < min(10 * lines, max_bits):
        bits *= 2
    pairs = docs.select(text).mapInArrow(_build(bits, least), "block long, once binary, twice binary")
    merged = pairs.repartition("block").mapInArrow(_merge, "block long, twice binary").toArrow()
    twice = np.zeros(bits // 8, np.uint8)
    for block, value in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        twice[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(value, np.uint8)
    return bits, twice


def _suspects(filter_, bits: int, least: int, id_type: pa.DataType):
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = filter_.value
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(_keys(text, least))
                keys += own
                ids += [doc] * len(own)
            if keys:
                kept = np.flatnonzero(_has(twice, _places(_hashes(keys), bits)))
                yield pa.record_batch({"key": pa.array([keys[i] for i in kept], pa.binary()), "doc": pa.array([ids[i] for i in kept], id_type)})

    return suspects


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines_, dropped = [], [], []
        for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            gone = set(keys or ())
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            lines_.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), batch.column(3)],
            names=["id", "kept_text", "n_lines", "n_dropped", REST],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, max_filter_bits: int = 1 << 30) -> DataFrame:
    """id, kept_text, n_lines, n_dropped and the other columns as the struct _rest, one row per input row.

    A line whose key (see line_key) has at least min_chars code points and is found in at least min_docs documents goes,
    but for all its lines in the largest id holding it. The filters get ten bits a line up to max_filter_bits (128 MB
    each at the default, which bounds the broadcast); beyond it more lines are suspected and shuffle, and the result is
    the same. Null and empty texts are one empty line. Rows with the same id are one document. Rows with a null id are
    counted nowhere and kept whole. Ids may have any type that has an order. No rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), rest(docs, id_col, text_col))
    named = docs.where(F.col("id").isNotNull())
    bits, twice = seen_twice(named, "text", min_chars, max_filter_bits)
    id_type = docs.schema["id"].dataType
    filter_ = spark.sparkContext.broadcast(twice)
    arrow = to_arrow_type(id_type)
    out = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc", id_type)])
    suspected = named.select("id", "text").mapInArrow(_suspects(filter_, bits, min_chars, arrow), out).dropDuplicates(["key", "doc"])
    suspected = materialize(suspected, "suspected")
    repeated = suspected.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    repeated = materialize(repeated, "repeated")  # so that the next join is between two exchanges, which splits a hot key
    losing = suspected.join(repeated, "key").where("doc != keeper").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    joined = docs.join(losing, docs["id"] == losing["doc"], "left").select("id", "text", "keys", REST)
    schema = T.StructType([docs.schema["id"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), docs.schema[REST]])
    return joined.mapInArrow(_apply, schema)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone
  FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op4: shared lines dropped from every whole text of documents."""
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
