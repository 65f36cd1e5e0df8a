"""Queries over rings, label sets, splits, statistics and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.functions import rings as R
from tessel.operators import datasets as D
from tessel.plans.registry import register
from tessel.sources.derived import DET_SQL, RING_SQL, detections, rings, table

_RING = f"WITH r AS ({RING_SQL})"


def _ring(name: str, sql: str, cols) -> None:
    register(name, f"{_RING} SELECT det_id, {sql} FROM r")(lambda spark, sf_dir: rings(detections(spark, sf_dir)).select("det_id", *cols(F.col("ring"))))


def _xy(ring, i: int = 0):
    return [F.round(ring[i]["x"], 6).alias("x"), F.round(ring[i]["y"], 6).alias("y")]


_ring("p2_normalize_coordinates", "round(x2 / 400, 6) AS x, round(y2 / 400, 6) AS y", lambda r: _xy(R.scale(r, 1 / 400, 1 / 400), 2))
_ring("p3_segment_convert_feature", "printf('%d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', cls, x1/510, y1/510, x2/510, y1/510, x2/510, y2/510, x1/510, y2/510) AS line", lambda r: [F.concat_ws(" ", F.col("cls").cast("string"), R.text(R.move(r, lambda x, y: (x / 510, y / 510)))).alias("line")])
_ring("p4_detect_convert_feature", "printf('%d %.6f %.6f %.6f %.6f', cls, (x1+x2)/2/510, (y1+y2)/2/510, (x2-x1)/510, (y2-y1)/510) AS line", lambda r: [F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls"), *B.xyxy_to_xywhn(R.bounds(r), 510, 510)).alias("line")])
_ring("p5_calculate_aabb", "round((x1+x2)/800, 6) AS cx, round((y1+y2)/800, 6) AS cy, round((x2-x1)/400, 6) AS w, round((y2-y1)/400, 6) AS h", lambda r: [F.round(c, 6).alias(n) for c, n in zip(B.xyxy_to_xywhn(R.bounds(r), 400, 400), ("cx", "cy", "w", "h"), strict=True)])
_ring("p7_obb_convert_feature", "8 AS n, round(x2/400, 6) AS x", lambda r: [F.when(F.size(r) == 4, F.size(r) * 2).alias("n"), F.round(R.scale(r, 1 / 400, 1 / 400)[1]["x"], 6).alias("x")])
_ring("p20_segment2box", "CASE WHEN x1 = 0 AND x2 > 380 THEN 0 WHEN y1 > 380 OR x1 > 380 THEN 0 WHEN x2 <= 380 THEN x2 ELSE x1 END AS right", lambda r: [R.bounds_inside(r, 380.0, 380.0).c.alias("right")])
_ring("p21_segments2boxes", "(x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h", lambda r: [c.alias(n) for c, n in zip(B.xyxy_to_xywh(R.bounds(r)), ("cx", "cy", "w", "h"), strict=True)])
_ring("p22_resample_segments", "round(x1 + (x2-x1)*0.5, 6) AS x, round(y1, 6) AS y", lambda r: _xy(R.resample(r, 9), 1))
_ring("p24_scale_coords", "round(least(320, x2/1.25), 6) AS x, round(least(240, greatest(0, (y2-50)/1.25)), 6) AS y", lambda r: _xy(R.unletterbox(r, 1.25, 0, 50, 320.0, 240.0), 2))
_ring("p26_clip_coords", "least(x2, 300) AS x, least(y2, 300) AS y", lambda r: [R.clip(r, 300.0, 300.0)[2]["x"].alias("x"), R.clip(r, 300.0, 300.0)[2]["y"].alias("y")])
_ring("p38_instances_clip", "least(x2, 350) AS x, least(x1, 350) AS bx", lambda r: [R.clip(r, 350.0, 350.0)[2]["x"].alias("x"), B.clip_box(B.col_box(), 350.0, 350.0).a.alias("bx")])
_ring("p47_apply_segments", "round((0.5*x2 - 0.25*y1 + 10) / (0.001*x2 + 1), 6) AS x, round((0.125*x2 + 0.75*y1 + 4) / (0.001*x2 + 1), 6) AS y", lambda r: _xy(R.project(r, [[0.5, -0.25, 10], [0.125, 0.75, 4], [0.001, 0, 1]]), 1))
_ring("p48_apply_keypoints", "round(0.5*x2 + 10, 6) AS x, CASE WHEN 0.5*x2 + 10 > 200 OR y2 > 400 THEN 0 ELSE 2 END AS visible", lambda r: [F.round(R.project(r, [[0.5, 0, 10], [0, 1, 0], [0, 0, 1]])[2]["x"], 6).alias("x"), F.when((F.col("x2") * 0.5 + 10 > 200) | (F.col("y2") > 400), 0).otherwise(2).alias("visible")])
_ring("p52_filter_boundary_polygons", "(x1+x2)/2 < 400 AND (y1+y2)/2 < 400 AS keep", lambda r: [R.centre_inside(r, 400.0, 400.0).alias("keep")])
_ring("o3_export_polygons", "5 AS n, (x2-x1)*(y2-y1) AS area", lambda r: [F.size(R.close(r)).alias("n"), R.area(r).alias("area")])
register("p6_try_extract_bbox", f"WITH d AS ({DET_SQL}) SELECT det_id, CASE cls WHEN 0 THEN 0.01 WHEN 1 THEN round((x2-x1)/400, 6) END AS w FROM d")(
    lambda spark, sf_dir: detections(spark, sf_dir).select("det_id", F.when(F.col("cls") == 0, 0.01).when(F.col("cls") == 1, F.round((F.col("x2") - F.col("x1")) / 400, 6)).alias("w"))
)
register("p1_get_class_id", "SELECT l_linenumber AS id, CASE WHEN l_linenumber > 0 THEN l_linenumber - 1 ELSE l_linenumber END AS cls, count(*) AS n FROM lineitem GROUP BY ALL")(
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("id"), D.zero_based(F.col("l_linenumber"), True).alias("cls")).agg(F.count("*").alias("n"))
)
register("p28_clean_str", "SELECT page_id, regexp_replace(url, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS name FROM pages")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", D.clean_name(F.col("url")).alias("name")))
_UNUSED = ", ".join(map(str, D.UNUSED))
register("s27_coco91_to_coco80_class", f"SELECT CAST(i AS INT) AS category, CASE WHEN i NOT IN ({_UNUSED}) THEN CAST(i - 1 - len(list_filter([{_UNUSED}], lambda u: u < i)) AS INT) END AS cls FROM range(1, 92) t(i)")(
    lambda spark, sf_dir: spark.range(1, 92).select(F.col("id").cast("int").alias("category")).select("category", D.class_91_to_80(F.col("category")).cast("int").alias("cls"))
)
register("s28_coco80_to_coco91_class", f"SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS cls, CAST(i AS INT) AS category FROM range(1, 92) t(i) WHERE i NOT IN ({_UNUSED})")(
    lambda spark, sf_dir: spark.range(80).select(F.col("id").cast("int").alias("cls")).select("cls", D.class_80_to_91(F.col("cls")).cast("int").alias("category"))
)
_PATH = "concat('/data/', CASE WHEN p_partkey % 2 = 0 THEN 'images/' ELSE '' END, 'set', p_size, '/images/im', p_partkey, '.v1.jpg')"
register("s16_img2label_paths", f"SELECT p_partkey AS id, regexp_replace(regexp_replace({_PATH}, '^(.*)/images/', '\\1/labels/'), '\\.[^./]*$', '.txt') AS path FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), D.label_path(F.expr(_PATH)).alias("path"))
)
register("s15_get_img_files", f"SELECT {_PATH} AS path FROM part ORDER BY 1 LIMIT 37")(lambda spark, sf_dir: table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path")).orderBy("path").limit(37))
_HASHES = f"SELECT sum(p_size) AS total, count(*) AS n, sum(('0x' || substr(sha256({_PATH}), 1, 15))::BIGINT) AS s FROM part"
register("s21_get_hash", f"SELECT sha256(concat(total::BIGINT, '|', n, '|', s)) AS hash FROM ({_HASHES})")(
    lambda spark, sf_dir: D.file_hash(table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path"), F.col("p_size").alias("size")))
)
_LINE = "printf('%d %.4f %.4f %.4f %.4f', cls, x1/400, y1/400, (x2-x1)/400, (y2-y1)/400)"
_FILES = f"SELECT image_id, CASE image_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE string_agg({_LINE}, chr(10)) END AS text FROM ({DET_SQL}) WHERE image_id % 5 < 2 OR (x1 <= CASE WHEN image_id % 5 = 2 THEN 400 ELSE 380 END AND cls < CASE WHEN image_id % 5 = 3 THEN 3 ELSE 2 END) GROUP BY image_id"


def label_files(spark, sf_dir: str):
    """image_id and text of made-up label files: some missing, some empty, some with classes beyond the second."""
    d = detections(spark, sf_dir).withColumn("k", F.col("image_id") % 5)
    d = d.where("k < 2 OR (x1 <= CASE WHEN k = 2 THEN 400 ELSE 380 END AND cls < CASE WHEN k = 3 THEN 3 ELSE 2 END)")
    line = F.format_string("%d %.4f %.4f %.4f %.4f", "cls", F.col("x1") / 400, F.col("y1") / 400, (F.col("x2") - F.col("x1")) / 400, (F.col("y2") - F.col("y1")) / 400)
    files = d.groupBy("image_id", "k").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    return files.select("image_id", F.expr("CASE k WHEN 0 THEN NULL WHEN 1 THEN '' ELSE t END AS text"))


_VERIFY = f"WITH f AS ({_FILES}), s AS (SELECT image_id, text, unnest(string_split(text, chr(10))) AS line FROM f WHERE text <> ''), g AS (SELECT image_id, count(*) AS n, count(DISTINCT line) AS d, bool_or(CAST(string_split(line, ' ')[1] AS INT) >= 2) AS bad FROM s GROUP BY image_id), v AS (SELECT f.image_id, CASE WHEN f.text IS NULL THEN 'missing' WHEN f.text = '' THEN 'empty' WHEN bad THEN 'corrupt' ELSE 'found' END AS status, n, d FROM f LEFT JOIN g USING (image_id))"
register("s17_verify_image_label", f"{_VERIFY} SELECT image_id, status, CASE WHEN status = 'found' THEN d ELSE 0 END AS boxes, CASE WHEN status = 'found' THEN n - d ELSE 0 END AS duplicates FROM v")(lambda spark, sf_dir: D.verify_labels(label_files(spark, sf_dir), 2))
register("s19_cache_labels", f"{_VERIFY} SELECT status, count(*) AS images FROM v GROUP BY status")(lambda spark, sf_dir: D.verify_labels(label_files(spark, sf_dir), 2).groupBy("status").agg(F.count("*").alias("images")))
_NO91 = "(" + " + ".join(f"CAST(category_id > {u} AS INT)" for u in D.UNUSED) + ")"
register(
    "s23_convert_coco",
    f"WITH a AS (SELECT image_id, CAST(det_id % 95 AS INT) AS category_id, x1 AS bx, y1 AS by0, x2 - x1 - 30 AS bw, y2 - y1 AS bh FROM ({DET_SQL}) WHERE det_id % 11 <> 0) SELECT DISTINCT image_id, CAST(category_id - 1 - {_NO91} AS INT) AS cls, round((bx + bw / 2) / 500, 6) AS cx, round((by0 + bh / 2) / 450, 6) AS cy, round(bw / 500, 6) AS w, round(bh / 450, 6) AS h FROM a WHERE bw > 0 AND bh > 0 AND category_id BETWEEN 1 AND 91 AND category_id NOT IN ({_UNUSED})",
)(lambda spark, sf_dir: coco(spark, sf_dir))


def coco(spark, sf_dir: str):
    d = detections(spark, sf_dir)
    ann = d.selectExpr("image_id", "CAST(det_id % 95 AS INT) AS category_id", "x1 AS bx", "y1 AS by", "x2 - x1 - 30 AS bw", "y2 - y1 AS bh", "det_id % 11 = 0 AS iscrowd")
    im = d.select("image_id").distinct().withColumns({"width": F.lit(500), "height": F.lit(450)})
    out = D.convert_coco(im, ann)
    return out.select("image_id", F.col("cls").cast("int").alias("cls"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


_AERIAL = "[" + ", ".join(f"'{n}'" for n in D.AERIAL) + "]"
register("s25_convert_dota", f"WITH d AS ({DET_SQL}) SELECT det_id AS image_id, CAST(det_id % 20 AS INT) AS cls, x1 || ' ' || y1 AS start FROM d WHERE det_id % 20 < 18 AND det_id % 3 <> 0")(
    lambda spark, sf_dir: dota(spark, sf_dir)
)


def dota(spark, sf_dir: str):
    names = F.array(*map(F.lit, (*D.AERIAL, "tree", "car")))
    d = detections(spark, sf_dir).withColumn("line", F.concat_ws(" ", "x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2", F.when(F.col("det_id") % 3 != 0, names[(F.col("det_id") % 20).cast("int")])))
    out = D.convert_dota(d.select(F.col("det_id").alias("image_id"), "line"), 1.0, 1.0)
    return out.select("image_id", "cls", F.concat_ws(" ", F.split("coords", " ")[0].cast("double").cast("string"), F.split("coords", " ")[1].cast("double").cast("string")).alias("start"))


register("u6_split_classify_dataset", "WITH h AS (SELECT p_partkey, p_brand, substr(sha256(concat('42|', p_partkey)), 1, 12) AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM h) SELECT p_partkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM r")(
    lambda spark, sf_dir: D.stratified_split(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 0.8).select("p_partkey", "split")
)
register("u4_split_files", "WITH h AS (SELECT p_partkey, substr(sha256(concat('42|', p_partkey)), 1, 12) AS h FROM part), r AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS r, count(*) OVER () AS n FROM h) SELECT p_partkey, CASE WHEN r <= floor(n * 0.7) THEN 'train' ELSE 'val' END AS split FROM r")(
    lambda spark, sf_dir: D.stratified_split(table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("one")), "p_partkey", "one", 0.7).select("p_partkey", "split")
)
register("u5_autosplit", "SELECT p_partkey, CASE WHEN ('0x' || substr(sha256(concat('0|', p_partkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9 THEN 'train' ELSE 'val' END AS split FROM part")(
    lambda spark, sf_dir: D.hash_split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", "split")
)
register("u7_concat_datasets", "SELECT split, count(*) AS n FROM (SELECT 'a' AS split FROM part UNION ALL SELECT 'b' FROM supplier) GROUP BY split")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select(F.lit("a").alias("split")).unionByName(table(spark, sf_dir, "supplier").select(F.lit("b").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))
)
register("u8_contiguous_sampler", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(floor((i // 16) / ceil(ceil(n / 16.0) / 4)) AS BIGINT) AS rank FROM r")(
    lambda spark, sf_dir: sampler(spark, sf_dir)
)


def sampler(spark, sf_dir: str, batch: int = 16, ranks: int = 4):
    """U8: rows in order in chunks of whole batches, one chunk a rank."""
    from tessel.plans.detection import batches

    b = batches(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", batch)
    n = b.agg((F.max("batch") + 1).alias("n"))
    return b.join(F.broadcast(n)).select("p_partkey", F.floor(F.col("batch") / F.ceil(F.col("n") / ranks)).alias("rank"))


register("a38_category_freq", "SELECT trim(n) AS name, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', ' / '), '/')) AS n FROM part) GROUP BY 1")(
    lambda spark, sf_dir: D.name_counts(table(spark, sf_dir, "part"), F.replace("p_name", F.lit(" "), F.lit(" / ")))
)
register("a41_grounding_category_freq", "SELECT lang AS name, count(*) AS n FROM documents GROUP BY lang")(lambda spark, sf_dir: D.name_counts(table(spark, sf_dir, "documents"), F.col("lang")))
register("a39_get_neg_texts", "WITH c AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY source) SELECT name FROM c WHERE n >= (SELECT least(max(n), 40) FROM c)")(
    lambda spark, sf_dir: D.frequent_names(D.name_counts(table(spark, sf_dir, "documents"), F.col("source")), 40)
)
register("a40_category_names", "SELECT DISTINCT trim(source) AS name FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select(F.trim("source").alias("name")).distinct())
_STAT = "SELECT CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, doc_id // 3 AS image_id, CASE WHEN doc_id % 9 <> 0 THEN lang END AS cls FROM documents"
register("a43_dataset_stats", f"WITH s AS ({_STAT}) SELECT split, cls, count(cls) AS instances, count(DISTINCT image_id) AS images FROM s WHERE cls IS NOT NULL GROUP BY split, cls UNION ALL SELECT split, NULL, count(cls), count(DISTINCT image_id) FROM s GROUP BY split")(
    lambda spark, sf_dir: stats(spark, sf_dir)
)


def stats(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split", "doc_id DIV 3 AS image_id", "CASE WHEN doc_id % 9 <> 0 THEN lang END AS lang")
    langs = ("de", "en", "es", "fr")
    code = F.create_map(*[F.lit(x) for i, n in enumerate(langs) for x in (n, i)])
    name = F.create_map(*[F.lit(x) for i, n in enumerate(langs) for x in (i, n)])
    return D.dataset_stats(docs.select("split", "image_id", code[F.col("lang")].alias("cls"))).select("split", name[F.col("cls")].alias("cls"), "instances", "images")


register("a42_verify_label_counts", "SELECT event_type AS source, count(*) AS found, count(DISTINCT event_id) AS expected, count(*) = count(DISTINCT event_id) AS ok FROM events GROUP BY 1")(
    lambda spark, sf_dir: D.verify_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("source")), table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.countDistinct("event_id").alias("expected")))
)
register("a44_results_verbose", f"SELECT image_id, cls, count(*) AS n FROM ({DET_SQL}) GROUP BY ALL")(lambda spark, sf_dir: detections(spark, sf_dir).groupBy("image_id", "cls").agg(F.count("*").alias("n")))
_CLIP = "SELECT value FROM {s} WHERE value > (SELECT avg(value) - 2 * stddev_pop(value) FROM {s}) AND value < (SELECT avg(value) + 2 * stddev_pop(value) FROM {s})"
register("a45_iterative_sigma_clipping", f"WITH a AS ({_CLIP.format(s='events')}), b AS ({_CLIP.format(s='a')}), c AS ({_CLIP.format(s='b')}) SELECT count(*) AS n, round(avg(value), 5) AS mean FROM c")(
    lambda spark, sf_dir: D.sigma_clipped(table(spark, sf_dir, "events").select("value"), "value").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))
)
register("a47_autobatch", "SELECT round(regr_slope(ln(p_retailprice), p_size), 6) AS slope, round(regr_intercept(ln(p_retailprice), p_size), 6) AS intercept FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").agg(F.round(F.regr_slope(F.log("p_retailprice"), "p_size"), 6).alias("slope"), F.round(F.regr_intercept(F.log("p_retailprice"), "p_size"), 6).alias("intercept"))
)
register("a48_get_visual_pe", "WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM u GROUP BY ALL) SELECT label, i - 1 AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS v FROM m")(
    lambda spark, sf_dir: prototypes(table(spark, sf_dir, "embeddings"))
)


def prototypes(vectors):
    """The unit mean vector of each class, component by component."""
    m = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.select("label", F.col("i").cast("long").alias("i"), F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), 5).alias("v"))


register("s4_normalize_integer_image", "WITH p AS (SELECT user_id, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events GROUP BY user_id) SELECT event_id, CAST(trunc(least(255, greatest(0, (value - a) / (b - a + 1e-7) * 255))) AS INT) AS u8 FROM events JOIN p USING (user_id)")(
    lambda spark, sf_dir: D.stretch(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value").select("event_id", "u8")
)
register("s5_normalize_to_uint8", "WITH p AS (SELECT user_id, min(value) AS a, max(value) AS b FROM events GROUP BY user_id) SELECT event_id, CAST(trunc(CASE WHEN b > a THEN (value - a) / (b - a) * 255 ELSE 0 END) AS INT) AS u8 FROM events JOIN p USING (user_id)")(
    lambda spark, sf_dir: D.min_max(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value").select("event_id", "u8")
)
_Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
register("k2_search", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS cosine FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) >= 0.1 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) DESC, vec_id LIMIT 30")(
    lambda spark, sf_dir: D.search(table(spark, sf_dir, "embeddings"), _Q).select("vec_id", F.round("cosine", 6).alias("cosine"))
)
register("k1_build_index", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, unnest(range(0, len(e))) AS i, round(unnest(e) / n, 6) + 0.0 AS x FROM v")(
    lambda spark, sf_dir: D.unit_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", F.posexplode("unit").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))
)
register("k7_top_results", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(9))
register("k9_get_latest_run", "SELECT user_id, arg_max(event_id, ts) AS latest FROM events GROUP BY user_id")(lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest")))
register("k6_get_topk_index", f"WITH d AS ({DET_SQL}), b AS (SELECT image_id, det_id // 100000 AS l, max(conf) AS m FROM d GROUP BY image_id, det_id // 100000), a AS (SELECT image_id, l FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, l) AS r FROM b) WHERE r <= 8) SELECT image_id, det_id FROM (SELECT d.image_id, det_id, row_number() OVER (PARTITION BY d.image_id ORDER BY conf DESC, det_id) AS r FROM d JOIN a ON a.image_id = d.image_id AND a.l = d.det_id // 100000) WHERE r <= 8")(
    lambda spark, sf_dir: two_level(detections(spark, sf_dir), 8)
)


def two_level(det, k: int):
    """K6: the k anchors of largest best score, then the k best of all their scores."""
    d = det.withColumn("l", F.expr("det_id DIV 100000"))
    best = d.groupBy("image_id", "l").agg(F.max("conf").alias("m"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("image_id").orderBy(*o))
    anchors = best.withColumn("r", rank(F.desc("m"), "l")).where(F.col("r") <= k).select("image_id", "l")
    return d.join(anchors, ["image_id", "l"]).withColumn("r", rank(F.desc("conf"), "det_id")).where(F.col("r") <= k).select("image_id", "det_id")


register("w13_get_logs", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 25) ORDER BY ts, event_id")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").where("ts > TIMESTAMP_NTZ '2024-01-05 00:00:00'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).orderBy("ts", "event_id")
)
register("r28_update_metrics", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY ALL")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
)
register("r27_epoch_progress", "SELECT event_id, CAST(least(100, (event_id % 50 + 1) * 100 // 40) AS INT) AS progress FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.least(F.floor((F.col("event_id") % 50 + 1) * 100 / 40), F.lit(100)).cast("int").alias("progress"))
)
register("r29_set_progress", "SELECT event_id, least(100, greatest(0, CAST(trunc(value) AS INT) - 20)) AS progress FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.col("value").cast("int") - 20, F.lit(0)), F.lit(100)).alias("progress"))
)
register("r30_console_logger", "WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id FROM s WHERE before IS NULL OR before <> event_type")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("before IS NULL OR before != event_type").select("event_id")
)
