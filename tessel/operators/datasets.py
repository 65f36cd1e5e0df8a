"""Label sets: ingest, validation, conversion, splits and statistics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The category ids of the 91-class list that its 80-class form leaves out, and the 18 aerial classes.
UNUSED = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)
AERIAL = (
    "plane", "ship", "storage-tank", "baseball-diamond", "tennis-court", "basketball-court", "ground-track-field", "harbor", "bridge",
    "large-vehicle", "small-vehicle", "helicopter", "roundabout", "soccer-ball-field", "swimming-pool", "container-crane", "airport", "helipad",
)


def class_91_to_80(category: Column) -> Column:
    """The id less the unused ones up to it and one; null for those."""
    below = sum((category > u).cast("int") for u in UNUSED)
    return F.when(category.isin(*UNUSED) | (category < 1) | (category > 91), None).otherwise(category - 1 - below)


def class_80_to_91(cls: Column) -> Column:
    """S28."""
    pairs = [(i - 1 - sum(u < i for u in UNUSED), i) for i in range(1, 92) if i not in UNUSED]
    return F.create_map(*map(F.lit, chain(*pairs)))[cls]


def zero_based(category: Column, shifted: bool | Column) -> Column:
    """One less where ids begin at one."""
    return F.when(F.lit(shifted) & (category > 0), category - 1).otherwise(category)


def label_path(path: Column) -> Column:
    """images/ to labels/ at its last place, any extension to .txt."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def clean_name(s: Column) -> Column:
    """P28."""
    return F.regexp_replace(s, r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def file_hash(files: DataFrame) -> DataFrame:
    """A hash of a set of files that doesn't depend on their order: sha256 over the total size, the number of paths
    and the sum of the first 60 bits of their hashes. Sums are partial sums, so no task holds the list of paths."""
    own = F.conv(F.substring(F.sha2("path", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    parts = files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("string").alias("total"), F.count("*").cast("string").alias("n"), F.coalesce(F.sum(own), F.lit(0)).cast("decimal(38,0)").cast("string").alias("s"))
    return parts.select(F.sha2(F.concat_ws("|", "total", "n", "s"), 256).alias("hash"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """K1: the vectors with their direction as unit, which an exact inner-product search reads."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / norm))


def verify_counts(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Source, found, expected and ok: the labels of each source against the number it should have."""
    found = labels.groupBy("source").agg(F.count("*").alias("found"))
    both = found.join(expected, "source", "full_outer").select("source", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("ok", F.col("found") == F.col("expected"))


def verify_labels(lines: DataFrame, classes: int) -> DataFrame:
    """image_id, status, boxes and duplicates of label files given as rows (image_id, text), null text a missing one.

    A file is corrupt if any line has not five numbers, a coordinate beyond 1.01, a value below -0.01 or a class that is
    not there; a line with more than six numbers is an outline, which counts by the box around it. Equal lines count once.
    """
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda t: t.try_cast("double"))
    rows = lines.select("image_id", "text", F.explode_outer(F.split("text", "\n")).alias("line")).withColumn("v", F.when(F.trim("line") != "", numbers))
    xy = F.slice("v", 2, 1000000)
    outline = F.size("v") > 6
    bad = ~F.when(outline, F.size("v") % 2 == 1).otherwise(F.size("v") == 5) | F.exists("v", lambda x: x.isNull()) | F.exists(xy, lambda x: x > 1.01) | F.exists("v", lambda x: x < -0.01) | (F.get("v", F.lit(0)) >= classes)
    agg = rows.groupBy("image_id").agg(
        F.max(F.col("text").isNotNull().cast("int")).alias("there"), F.count("v").alias("n"), F.countDistinct("v").alias("d"), F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("bad")
    )
    status = F.when(F.col("there") == 0, "missing").when(F.col("n") == 0, "empty").when(F.col("bad") == 1, "corrupt").otherwise("found")
    ok = status == "found"
    return agg.select("image_id", status.alias("status"), F.when(ok, F.col("d")).otherwise(0).alias("boxes"), F.when(ok, F.col("n") - F.col("d")).otherwise(0).alias("duplicates"))


def convert_coco(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, cls and normalized centre box of each annotation (image_id, category_id, bbox corner form, iscrowd).

    Crowds, boxes without width or height and exact repeats go; so do categories that the 80 classes leave out.
    """
    a = annotations.where(~F.coalesce(F.col("iscrowd"), F.lit(False))).join(images.select("image_id", "width", "height"), "image_id")
    a = a.select("image_id", class_91_to_80(F.col("category_id")).alias("cls"), ((F.col("bx") + F.col("bw") / 2) / F.col("width")).alias("cx"), ((F.col("by") + F.col("bh") / 2) / F.col("height")).alias("cy"), (F.col("bw") / F.col("width")).alias("w"), (F.col("bh") / F.col("height")).alias("h"))
    return a.where("w > 0 AND h > 0 AND cls IS NOT NULL").distinct()


def convert_dota(lines: DataFrame, w: float, h: float) -> DataFrame:
    """image_id, cls and the normalized corners at six significant digits as text, of aerial label lines.

    Lines with fewer than nine words or another class name go.
    """
    words = F.split(F.trim("line"), r"\s+")
    names = F.create_map(*map(F.lit, chain(*((n, i) for i, n in enumerate(AERIAL)))))
    rows = lines.select("image_id", words.alias("t")).where("size(t) >= 9").select("image_id", names[F.col("t")[8]].alias("cls"), "t").where("cls IS NOT NULL")
    coords = F.transform(F.slice("t", 1, 8), lambda x, i: x.cast("double") / F.when(i % 2 == 0, w).otherwise(h))
    return rows.select("image_id", "cls", F.array_join(F.transform(coords, significant), " ").alias("coords"))


def significant(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros, as %g writes those between 1e-4 and 1e6."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))))
    shown = F.format_string("%.10f", F.bround(x * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places))
    return F.regexp_replace(F.regexp_replace(shown, r"0+$", ""), r"\.$", "")


def stratified_split(df: DataFrame, key: str, cls: str, ratio: float, seed: int = 42) -> DataFrame:
    """U6, U4 without a class: split "train" for the first int(n * ratio) rows of each class in the order of a hash.

    Exact cuts by hash buckets: counts of 1024 buckets a class place the cut, and only the bucket it falls in is ranked.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("long")
    d = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 38))
    sizes = d.groupBy(cls, "__b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(cls).orderBy("__b")
    sizes = sizes.select(cls, "__b", (F.sum("c").over(w) - F.col("c")).alias("__first"), F.floor(F.sum("c").over(Window.partitionBy(cls)) * ratio).alias("__cut"))
    d = d.join(sizes, [cls, "__b"]).withColumn("__r", F.row_number().over(Window.partitionBy(cls, "__b").orderBy("__h", key)))
    return d.withColumn("split", F.when(F.col("__first") + F.col("__r") <= F.col("__cut"), "train").otherwise("val")).drop("__h", "__b", "__first", "__cut", "__r")


def hash_split(df: DataFrame, key: str, weights: tuple[float, ...] = (0.9, 0.1, 0.0), seed: int = 0) -> DataFrame:
    """Each row to train, val or test by its own hash, so that new rows move no old one."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("split", F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test"))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Split, cls, instances and images, with cls null for a split's totals, by one rollup.

    rows: split, image_id, cls (null for an image without labels); the null class of such images is left out.
    """
    r = rows.select("split", "image_id", F.coalesce("cls", F.lit(-1)).alias("cls"), F.col("cls").isNotNull().cast("int").alias("one"))
    out = r.groupingSets([["split", "cls"], ["split"]], "split", "cls").agg(F.sum("one").alias("instances"), F.countDistinct("image_id").alias("images"), F.countDistinct(F.when(F.col("one") == 0, F.col("image_id"))).alias("unlabelled"))
    return out.where("cls IS NULL OR cls >= 0")


def name_counts(df: DataFrame, names: Column) -> DataFrame:
    """How often each /-separated, trimmed name occurs."""
    return df.select(F.explode(F.split(names, "/")).alias("name")).select(F.trim("name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def frequent_names(counts: DataFrame, most: int = 100) -> DataFrame:
    """Names at least as frequent as the most frequent one, or as most."""
    bar = counts.agg(F.least(F.max("n"), F.lit(most)).alias("__bar"))
    return counts.join(F.broadcast(bar)).where("n >= __bar").select("name")


def sigma_clipped(df: DataFrame, value: str, sigma: float = 2.0, rounds: int = 3) -> DataFrame:
    """The values left after rounds of keeping those strictly within sigma deviations of the mean."""
    for _ in range(rounds):
        m = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
        df = df.join(F.broadcast(m)).where((F.col(value) > F.col("__m") - sigma * F.col("__s")) & (F.col(value) < F.col("__m") + sigma * F.col("__s"))).drop("__m", "__s")
    return df


def stretch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values to 0..255 between the exact 2nd and 98th percentile of their group, truncated."""
    p = df.groupBy(*keys).agg(F.percentile(value, [0.02, 0.98]).alias("__p"))
    out = F.least(F.greatest((F.col(value) - F.col("__p")[0]) / (F.col("__p")[1] - F.col("__p")[0] + 1e-7) * 255, F.lit(0.0)), F.lit(255.0))
    return df.join(p, keys).withColumn("u8", out.cast("int")).drop("__p")


def min_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values to 0..255 between the group's least and greatest number, NaN as 0; a constant group is 0."""
    v = F.when(~F.isnan(value), F.col(value))
    p = df.groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    out = F.when(F.col("__hi") > F.col("__lo"), (F.nanvl(F.col(value), F.col("__lo")) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 255).otherwise(0.0)
    return df.join(p, keys).withColumn("u8", out.cast("int")).drop("__lo", "__hi")


def search(vectors: DataFrame, query: list[float], k: int = 30, least: float = 0.1) -> DataFrame:
    """K1, K2: the k vectors of largest cosine with a query, at least `least`; one scan and a bounded top-k."""
    q = F.array(*map(F.lit, query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(v * v for v in query) ** 0.5
    return vectors.select("vec_id", (dot / (norm * size)).alias("cosine")).where(F.col("cosine") >= least).orderBy(F.desc("cosine"), "vec_id").limit(k)
