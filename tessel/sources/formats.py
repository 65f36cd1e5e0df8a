"""Readers and writers of label and result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import boxes as B

NDJSON = "type string, task string, name string, class_names map<string,string>, file string, width int, height int, split string, annotations map<string,array<array<double>>>"
FEATURE = "type: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: struct<class_id: int, image_size: array<int>, image_ref: string>"
GEOJSON = f"type string, features array<struct<{FEATURE}>>"
COCO = "images array<struct<id: long, width: int, height: int, file_name: string, caption: string>>, annotations array<struct<image_id: long, category_id: int, bbox: array<double>, iscrowd: boolean, tokens_positive: array<array<int>>>>"


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """File, split, kind, cls and numbers, a row per object of the first kind of annotation an image has."""
    rows = spark.read.schema(NDJSON).json(path).where("type = 'image'")
    kind = F.get(F.map_keys("annotations"), F.lit(0))
    rows = rows.select("file", "split", "width", "height", kind.alias("kind"), F.explode(F.get(F.map_values("annotations"), F.lit(0))).alias("v"))
    return rows.select("file", "split", "width", "height", "kind", F.col("v")[0].cast("int").alias("cls"), F.slice("v", 2, 1_000_000).alias("numbers"))


def ndjson_splits(spark: SparkSession, path: str) -> DataFrame:
    """S26, its check: the images of each split; a set needs train and val."""
    return spark.read.schema(NDJSON).json(path).where("type = 'image'").groupBy("split").agg(F.count("*").alias("images"))


def read_geojson(spark: SparkSession, path: str, shifted: bool = False) -> DataFrame:
    """image_ref, cls and line (class and normalized outer ring) of each polygon of label files.

    An image's size is that of the file's first feature, 512 by 512 where it has none; other shapes have a null line.
    """
    rows = spark.read.schema(GEOJSON).option("multiLine", True).json(path).where("type = 'FeatureCollection'")
    size = F.coalesce(F.get("features", F.lit(0))["properties"]["image_size"], F.array(F.lit(512), F.lit(512)))
    return _label_lines(rows.select(size.alias("size"), F.explode("features").alias("f")).select("size", "f.geometry", "f.properties"), shifted)


def read_geojson_parts(spark: SparkSession, path: str, shifted: bool = False) -> DataFrame:
    """read_geojson of one document as write_geojson_parts leaves it: in part files, a feature a line, which tasks share."""
    lines = spark.read.text(path)
    feature = lambda d: d.select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), f"struct<{FEATURE}>").alias("f"))
    first = spark.read.text(sorted(lines.inputFiles())[:2]).where(F.col("value").startswith('{"type":"Feature"'))
    first = feature(first).select("f.properties.image_size").first()
    size = F.array(*map(F.lit, (first and first[0]) or (512, 512)))
    rows = feature(lines.where(F.ltrim(F.col("value"), F.lit(",")).startswith('{"type":"Feature"')))
    return _label_lines(rows.select(size.alias("size"), "f.geometry", "f.properties"), shifted)


def _label_lines(rows: DataFrame, shifted: bool) -> DataFrame:
    c = F.col("properties.class_id")
    cls = F.when(F.lit(shifted) & (c > 0), c - 1).otherwise(c)
    ring = F.get("geometry.coordinates", F.lit(0))
    text = F.array_join(F.flatten(F.transform(ring, lambda p: F.array(F.format_string("%.6f", p[0] / F.col("size")[0]), F.format_string("%.6f", p[1] / F.col("size")[1])))), " ")
    return rows.select("properties.image_ref", cls.alias("cls"), F.when(F.col("geometry.type") == "Polygon", F.concat_ws(" ", cls.cast("string"), text)).alias("line"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The images and the annotations (box as bx, by, bw, bh) of a COCO file."""
    rows = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = rows.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height", "i.file_name", "i.caption")
    a = rows.select(F.explode("annotations").alias("a")).select("a.*")
    return images, a.select("image_id", "category_id", "iscrowd", "tokens_positive", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("bx", "by", "bw", "bh"))])


def grounding(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, phrase and centre box of grounded annotations: the phrase is cut from the caption by spans.

    Crowds, boxes without width or height, empty phrases and repeats go.
    """
    a = annotations.where(~F.coalesce("iscrowd", F.lit(False))).join(images, "image_id")
    phrase = F.trim(F.lower(F.array_join(F.transform("tokens_positive", lambda t: F.substring(F.col("caption"), t[0] + 1, t[1] - t[0])), " ")))
    box = ((F.col("bx") + F.col("bw") / 2) / F.col("width"), (F.col("by") + F.col("bh") / 2) / F.col("height"), F.col("bw") / F.col("width"), F.col("bh") / F.col("height"))
    return a.select("image_id", phrase.alias("phrase"), *[c.alias(n) for c, n in zip(box, ("cx", "cy", "w", "h"), strict=True)]).where("w > 0 AND h > 0 AND phrase != ''").distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the file's name) and text of label files."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("image_id"), F.col("value").alias("text"))


def class_name(cls: Column, names: list[str]) -> Column:
    """O2: the name of a class, class_n beyond the list."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), cls), F.concat(F.lit("class_"), cls.cast("string"))) if names else F.concat(F.lit("class_"), cls.cast("string"))


def features(det: DataFrame, names: list[str], g: tuple[float, ...]) -> DataFrame:
    """O1, O2: det_id and the GeoJSON feature of each box, in geographic coordinates as a closed ring."""
    pts = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1")]
    ring = F.array(*[F.array(*(F.round(c, 6) for c in B.pixel_to_geo(F.col(x), F.col(y), g))) for x, y in pts])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    props = F.struct(F.col("det_id").alias("id"), F.col("cls").alias("class_id"), class_name(F.col("cls"), names).alias("class_name"), F.col("conf").alias("confidence"), F.array("x1", "y1", "x2", "y2").alias("bbox_pixel"))
    return det.select("det_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_geojson(det: DataFrame, path: str, names: list[str], g: tuple[float, ...], crs: str) -> None:
    """O1: one FeatureCollection file. Its one task gets finished lines only; for large results there is write_geojson_parts."""
    n = det.count()
    head = F.lit('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "' + crs + '"}}, "features": [')
    if not n:
        det.sparkSession.range(1).select(F.concat(head, F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    # In one partition the id that grows is the row's number; the sort before it has many.
    r = features(det, names, g).orderBy("det_id").coalesce(1).select("feature", F.monotonically_increasing_id().alias("r"))
    text = F.concat(F.when(F.col("r") == 0, F.concat(head, F.lit("\n"))).otherwise(F.lit("")), "feature", F.when(F.col("r") == n - 1, F.lit("\n]}")).otherwise(F.lit(",")))
    r.select(text.alias("value")).write.mode("overwrite").text(path)


def write_geojson_parts(det: DataFrame, path: str, names: list[str], g: tuple[float, ...], crs: str) -> None:
    """O1: one FeatureCollection, with a feature a line in the order of det_id, as gzip part files.

    Their texts in the order of their names are the document; concatenated, they are one gzip file of it. Only corners move.
    """
    one = lambda text: det.sparkSession.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    head = '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "' + crs + '"}}, "features": ['
    r = features(det.orderBy("det_id"), names, g).select("feature", F.monotonically_increasing_id().alias("r"))
    # The first partition of a sort has rows, if there are any: only the first row of all has number 0.
    text = r.select(F.concat(F.when(F.col("r") == 0, "").otherwise(","), "feature").alias("value"))
    one(head).unionByName(text).unionByName(one("]}")).write.mode("overwrite").option("compression", "gzip").text(path)


def coco_results(det: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (top left and size, three digits) and score (five), rounded half to even."""
    b = B.xyxy_to_ltwh(B.col_box())
    return det.select("image_id", F.col("cls").alias("category_id"), F.array(*[F.bround(c, 3) for c in b]).alias("bbox"), F.bround("conf", 5).alias("score"))


def result_lines(det: DataFrame, w: float, h: float, with_conf: bool = True) -> DataFrame:
    """image_id and the text line of each box: class, normalized centre box and score with %g."""
    from tessel.operators.datasets import significant

    parts = [F.col("cls").cast("string"), *map(significant, B.xyxy_to_xywhn(B.col_box(), w, h))]
    return det.select("image_id", "det_id", F.concat_ws(" ", *parts, *([significant(F.col("conf"))] if with_conf else [])).alias("line"))


def summary(det: DataFrame, names: list[str]) -> DataFrame:
    """Name, class, confidence and box of each detection, five digits."""
    return det.select("det_id", class_name(F.col("cls"), names).alias("name"), F.col("cls").alias("class"), F.bround("conf", 5).alias("confidence"), F.struct(*[F.bround(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))


def tile_results(det: DataFrame, size: int) -> DataFrame:
    """image_id and one JSON text per tile: its place, count and predictions, which a tile's area bounds."""
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    p = F.struct("det_id", "cls", "conf", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    t = det.groupBy("image_id", cell("y1").alias("tile_row"), cell("x1").alias("tile_col")).agg(F.count("*").alias("num_instances"), F.array_sort(F.collect_list(p)).alias("predictions"))
    return t.select("image_id", "tile_row", "tile_col", "num_instances", F.to_json(F.struct("tile_row", "tile_col", "num_instances", "predictions")).alias("tile"))
