"""Archives with headers of any length, and manifests that don't fit."""

import pytest
from pyspark.sql import functions as F

from tessel.llm import warc
from tessel.llm.common import work_path


def test_long_urls(spark):
    rows = [(1, "u" * 70_000, "first"), (2, "u", "p" * 150), (3, "v" * 300_000, "third"), (4, "u", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_warc(pages, work_path(spark, "warc"))
    for step in (5000, 1 << 20):
        out = warc.read_warc(archives.select("file", "size"), step).collect()
        assert {(r["fields"]["warc-target-uri"], bytes(r["payload"]).decode()) for r in out} == {(u, t) for _, u, t in rows} and len(out) == 4


def test_manifest_is_compared(spark):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_warc(pages, work_path(spark, "warc"))
    assert warc.read_warc(archives).count() == 2
    with pytest.raises(ValueError, match="3 records by its manifest, 2 were found"):
        warc.read_warc(archives.withColumn("records", F.col("records") + 1))
