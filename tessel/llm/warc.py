"""WARC archives: writing, and reading by boundary-chain verification.

Archives are uncompressed WARC/1.1 files. To read them in parallel, each task scans a byte range for the magic that
begins a record, parses what follows it as a header and emits the candidate with its successor: the offset at which the
next record begins if this one is real. Only what the chain from the start of a file reaches is a record; magic inside a
payload is never reached. Pointer jumping follows the chain: within a range in the task, between ranges by doubling
joins, so a file of n ranges takes log2(n) rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import materialize, prepare, read, work_path

# The WARC/1.1 format.
MAGIC = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"

LEAST = 100  # bytes of a payload from which equal ones are revisits
RANGE = 8 << 20
FILE = 128 << 20
LOOK = 64 << 10  # bytes read behind a range at first for the header that begins in it; more until the header ends
BROADCAST = 1 << 20  # rows of revisits (48 MB) up to which they are sent to all tasks instead of shuffling payloads
TASKS = 100_000  # the most partitions of a step; a task then takes several ranges one by one


def header(fields: list[tuple[str, str]]) -> bytes:
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n"


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files of this attempt have names of their own; only those of attempts that end well get into the manifest."""
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, done, size, records = None, [], 0, 0
        for batch in batches:
            for page, url, payload, digest, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc"
                    out, size, records = fs.open_output_stream(f"{root}/{name}"), 0, 0
                payload, revisit = payload or b"", leader is not None
                block = b"" if revisit else payload
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                fields += [("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{leader}>")]
                record = header([*fields, ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]) + block + GAP
                out.write(record)
                size, records = size + len(record), records + 1
                if size >= FILE:
                    out.close()
                    done.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, records))
        if done:
            yield pa.record_batch({"file": pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()), "size": pa.array([s for _, s, _ in done], pa.int64()), "records": pa.array([r for _, _, r in done], pa.int64())})

    return write


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write one record per row below folder; file, size and records of each archive, by tasks that ended.

    The payload is the column in UTF-8, null as empty. Ids of any type are written as text. Of rows with equal payloads of at least least bytes that with the
    smallest id is a response, all others revisit it and hold no payload; smaller ones are all responses. Rows with a null id are
    responses with the id "None" and lead nothing. Of rows with the same id and payload each is a response. No rows write
    no archive. Line breaks in a url are escaped.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("payload", F.lit(b"")), 256))
    large = materialize(rows.where((F.length("payload") >= least) & F.col("page").isNotNull()).select("page", "digest"), "digests")
    first = materialize(large.groupBy("digest").agg(F.min("page").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "leaders")
    revisits = materialize(large.join(first, "digest").where("page != leader").select("page", "digest", "leader").distinct(), "revisits")
    hint = F.broadcast if revisits.count() <= BROADCAST else lambda x: x
    found = rows.join(hint(revisits), ["page", "digest"], "left").select("page", "url", "payload", "digest", "leader")
    return materialize(found.mapInArrow(_write(folder), "file string, size long, records long"), "archives")


def parse_header(data: bytes, at: int = 0) -> tuple[int, dict[str, str]] | None:
    """The length of the header that begins at an offset, and its fields; None if there is no whole header."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(GAP, at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return (end + len(GAP) - at, fields) if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


def _until_gap(f, data: bytes) -> bytes:
    """data and what follows in the file, up to the first GAP or the end of the file."""
    parts, tail = [data], data[-len(GAP) + 1 :]
    while more := f.read(LOOK):
        parts.append(more)
        if GAP in tail + more:
            break
        tail = (tail + more)[-len(GAP) + 1 :]
    return b"".join(parts)


def _candidates(step: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                end = min(size, begin + step)
                with fs.open_input_file(path) as f:
                    f.seek(begin)
                    data = f.read(end - begin + LOOK)
                    last = data.rfind(MAGIC, 0, end - begin + len(MAGIC) - 1)
                    if last >= 0 and data.find(GAP, last) < 0:  # only behind the range's last magic an end can be missing
                        data = _until_gap(f, data)
                offsets, nexts, heads = [], [], []
                at = data.find(MAGIC)
                while 0 <= at < end - begin:
                    if head := parse_header(data, at):
                        offsets.append(begin + at)
                        heads.append(head[0])
                        nexts.append(begin + at + head[0] + int(head[1]["content-length"]) + len(GAP))
                    at = data.find(MAGIC, at + 1)
                own = {o: i for i, o in enumerate(offsets)}
                exits = [0] * len(offsets)
                for i in range(len(offsets) - 1, -1, -1):  # a successor lies behind, so its exit is known
                    j = own.get(nexts[i])
                    exits[i] = nexts[i] if j is None else exits[j]
                yield pa.record_batch(
                    {"file": pa.array([file] * len(offsets), pa.string()), "begin": pa.array([begin] * len(offsets), pa.int64()), "offset": pa.array(offsets, pa.int64()), "head": pa.array(heads, pa.int64()), "next": pa.array(nexts, pa.int64()), "exit": pa.array(exits, pa.int64())}
                )

    return candidates


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's candidates (lists, a row per range) those that its entry reaches."""
    for batch in batches:
        out: list[tuple] = []
        for file, entry, offsets, heads, nexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = {o: (h, n) for o, h, n in zip(offsets, heads, nexts, strict=True)}
            while entry in own:
                out.append((file, entry, *own[entry]))
                entry = own[entry][1]
        yield pa.record_batch({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate((("file", pa.string()), ("offset", pa.int64()), ("head", pa.int64()), ("next", pa.int64())))})


def record_offsets(archives: DataFrame, step: int = RANGE) -> DataFrame:
    """file, offset, head, next of every record that the chain from the start of its file reaches.

    archives: file and size. A range of step bytes is a task's unit and bounds its memory. A file that doesn't begin with
    a record has none; one that is cut off or damaged ends with the last header that the chain reaches (see broken).
    """
    prepare(archives.sparkSession)
    ranges = archives.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(step).cast("long"))).alias("begin"))
    ranges = ranges.repartition(max(1, min(ranges.count(), TASKS)))
    found = materialize(ranges.mapInArrow(_candidates(step), "file string, begin long, offset long, head long, next long, exit long"), "candidates")
    jump = found.select("file", F.col("offset").alias("at"), F.col("exit").alias("to"))
    reached = found.where("offset = 0").select("file", F.lit(0).cast("long").alias("at"))
    most = found.agg(F.max(F.floor(F.col("begin") / step))).first()[0] or 0
    for i in range(int(most).bit_length()):
        landed = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.unionByName(landed).distinct(), "reached")
        if i + 1 < int(most).bit_length():
            far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
            jump = materialize(jump.join(far, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "jump")
    entries = reached.select("file", F.col("at").alias("entry"), (F.floor(F.col("at") / step) * step).alias("begin"))
    lists = found.groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("offset", "head", "next"))).alias("c"))
    whole = lists.join(entries, ["file", "begin"]).select("file", "entry", "c.offset", "c.head", "c.next")
    return whole.mapInArrow(_follow, "file string, offset long, head long, next long")


def broken(archives: DataFrame, found: DataFrame) -> DataFrame:
    """file, size, reached and, where archives have it, records with n: the archives that found (see record_offsets) does
    not hold whole, as their chain ends before the end of the file or behind it, or another number of records is there."""
    ends = found.groupBy("file").agg(F.max("next").alias("reached"), F.count("*").alias("n"))
    all_ = archives.join(ends, "file", "left").withColumns({"reached": F.coalesce("reached", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    return all_.where("reached != size OR n != records" if "records" in archives.columns else "reached != size")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size, last, f = [], 0, None, None
        for file, offset, head, end in rows:
            if file != last:
                fs, path = pafs.FileSystem.from_uri(file)
                f, last = fs.open_input_file(path), file
            f.seek(offset)
            data = f.read(end - offset - len(GAP))
            fields = parse_header(data)[1]
            out.append((file, offset, fields, data[head:]))
            size += len(data)
            if size >= 16 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "file": pa.array([r[0] for r in rows], pa.string()), "offset": pa.array([r[1] for r in rows], pa.int64()),
            "fields": pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.string())), "payload": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def read_warc(archives: DataFrame, step: int = RANGE, strict: bool = True) -> DataFrame:
    """file, offset, fields (names in lower case) and payload of every record of the archives (file, size).

    It fails if a file's chain of records doesn't end where the file ends, be it cut off or damaged, or if archives also
    have records (the manifest of write_warc) and another number is found. With strict False such files give the records
    that the chain reaches and that lie in the file whole.
    """
    found = materialize(record_offsets(archives, step), "offsets")
    if strict:
        if wrong := broken(archives, found).first():
            if wrong["reached"] != wrong["size"]:
                raise ValueError(f"{wrong['file']} has {wrong['size']} bytes, its records end at {wrong['reached']}")
            raise ValueError(f"{wrong['file']} has {wrong['records']} records by its manifest, {wrong['n']} were found")
    else:
        found = found.join(archives.select("file", "size"), "file").where("next <= size").drop("size")
    tasks = min(TASKS, 1 + (archives.agg(F.sum("size")).first()[0] or 0) // (4 * step))  # by what they will read, not by these small rows
    dealt = found.repartition(tasks, "file", F.floor(F.col("offset") / step))
    return dealt.mapInArrow(_records, "file string, offset long, fields map<string,string>, payload binary")


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The archives table of files named by URI."""
    rows = []
    for p in paths:
        fs, path = pafs.FileSystem.from_uri(p)
        rows.append((p, fs.get_file_info(path).size))
    return spark.createDataFrame(rows, "file string, size long")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
l AS (SELECT payload_digest, min(page_id) AS leader FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM d LEFT JOIN l USING (payload_digest)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op10: pages written as archives and read back."""
    archives = write_warc(read(spark, sf_dir, "pages"), work_path(spark, "warc"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    f = F.col("fields")
    revisit = f["warc-type"] == "revisit"
    return read_warc(archives).select(
        page(f["warc-record-id"]).alias("page_id"),
        F.when(revisit, f["x-payload-length"].cast("long")).otherwise(F.length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(f["warc-payload-digest"], "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        f["warc-type"].alias("record_type"),
        F.when(revisit, page(f["warc-refers-to"])).alias("refers_to"),
    )
