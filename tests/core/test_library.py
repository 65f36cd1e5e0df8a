"""Goldens, properties and round trips of the detection library, and every query against its statement."""

import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.functions import polygons as P
from tessel.functions import rings as R
from tessel.operators import evaluation as E
from tessel.operators import masks, nms
from tessel.operators.graph import components
from tessel.plans import registry
from tessel.plans.geometry import GEO
from tessel.sources import formats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(tuple(map(_shown, r)) for r in it)
    assert rows(got.select(*[f"`{c}`" for c in cols]).collect()) == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def _pair(spark, a, b, f):
    row = spark.createDataFrame([(*a, *b)], "x1 double, y1 double, x2 double, y2 double, ox1 double, oy1 double, ox2 double, oy2 double")
    return row.select(f(B.col_box(), nms.other_box()).alias("v")).first()[0]


def test_box_goldens(spark):
    a, b = (0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0)
    assert math.isclose(_pair(spark, a, b, B.iou), 25 / 175, abs_tol=1e-6)
    assert math.isclose(_pair(spark, a, b, lambda x, y: B.iou_family(x, y, "giou")), 25 / 175 - 50 / 225, abs_tol=1e-6)
    assert math.isclose(_pair(spark, a, b, B.coverage), 0.25)
    assert math.isclose(_pair(spark, a, a, lambda x, y: B.iou_family(x, y, "ciou")), 1, abs_tol=1e-5)


def _greedy(rows, threshold, strict):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        def over(k):
            i = max(0, min(r[4], k[4]) - max(r[2], k[2])) * max(0, min(r[5], k[5]) - max(r[3], k[3]))
            u = (r[4] - r[2]) * (r[5] - r[3]) + (k[4] - k[2]) * (k[5] - k[3]) - i
            return i / u >= threshold if strict else i / u > threshold
        if not any(over(k) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_suppression_properties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.integers(0, 20)) / 20, *map(float, (x, y, x + w, y + h))) for i in range(300) for x, y, w, h in [rng.integers([0, 0, 20, 20], [200, 200, 80, 80])]]
    det = spark.createDataFrame([(1, 0, *r) for r in rows], "image_id long, cls int, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    for strict in (False, True):
        kept = nms.greedy_nms(det, 0.4, strict=strict)
        ids = {r["det_id"] for r in kept.collect()}
        assert ids == _greedy(rows, 0.4, strict)
        assert {r["det_id"] for r in nms.greedy_nms(kept, 0.4, strict=strict).collect()} == ids
        assert {r["det_id"] for r in nms.greedy_nms(det, 0.4, strict=strict, most=1).collect()} == ids
    assert {r["det_id"] for r in nms.fast_nms(det, 0.4).collect()} <= _greedy(rows, 0.4, True)
    assert nms.fast_nms(det.limit(0), 0.4).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (200, 200), (300, None), (7, 3), (7, 3)]
    out = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {i: 1 for i in range(1, 41)} | {98: 98, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_perfect_detector_has_the_known_ap(spark):
    rows = [(1, i, 0, 1 - i / 10, 50.0 * i, 0.0, 50.0 * i + 40, 40.0) for i in range(5)]
    det = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    truth = det.withColumnRenamed("det_id", "gt_id").drop("conf")
    ap = E.average_precision(E.precision_recall(det, truth, E.match_predictions(det, truth))).collect()
    assert len(ap) == 10 and all(math.isclose(r["ap"], 0.995, abs_tol=1e-9) for r in ap)
    assert {tuple(r) for r in E.confusion(det, truth).collect()} == {(0, 0, 5)}


def test_running_sums_equal_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 50)) / 50, int(rng.integers(0, 2))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, s double, v int")
    got = {r["id"]: (r["r_v"], r["r_n"]) for r in E.running(df, ["k"], "s", "id", ["v"], 16).collect()}
    for k in range(3):
        total = 0
        for n, (i, _, _, v) in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0])), 1):
            total += v
            assert got[i] == (total, n)


point = st.tuples(st.integers(0, 60), st.integers(0, 60))


@settings(max_examples=60, deadline=None)
@given(st.lists(point, min_size=3, max_size=9, unique=True))
def test_least_rectangle_holds_the_points(pts):
    p = np.array(pts, float)
    x, y, w, h, t = P.min_area_rect(p)
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    q = (p - [x, y]) @ turn.T
    assert (np.abs(q[:, 0]) <= w / 2 + 1e-6).all() and (np.abs(q[:, 1]) <= h / 2 + 1e-6).all() and w >= h - 1e-9
    assert w * h <= np.ptp(p[:, 0]) * np.ptp(p[:, 1]) + 1e-6


def test_polygons():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])
    assert P.convex_iou(square, square + 5) == 25 / 175 and P.iof(square, (5, -5, 50, 50)) == 0.5
    assert len(P.simplify(np.array([[0, 0], [5, 0.1], [10, 0], [10, 10], [0, 10.0]]), 0.5)) == 4
    assert P.rasterize(square, 12, 12).sum() == 100
    joined = P.join_rings([square, square + [20, 0]])
    assert len(joined) == 10 and P.area(joined) == 200


def test_runs_of_polygons(spark):
    rng = np.random.default_rng(3)
    shapes = [rng.integers(-20, 60, (n, 2)).astype(float) + rng.choice([0, 0.5, 0.25]) for n in (3, 4, 5, 7, 9) for _ in range(12)]
    shapes += [np.array([[0, 0], [50, 0], [50, 50], [0, 50.0]]), np.array([[60, 60], [70, 60], [70, 70.0]]), np.array([[5, 5], [9, 5], [9, 5.0]]), np.zeros((2, 2)), np.zeros((0, 2))]
    df = spark.createDataFrame([(i, [tuple(p) for p in s.tolist()]) for i, s in enumerate(shapes)] + [(-1, None)], "i int, ring array<struct<x: double, y: double>>")
    for row in df.select("i", R.runs(F.col("ring"), 40, 30).alias("runs")).collect():
        got = np.zeros((40, 30), bool)
        if row["i"] < 0:
            assert row["runs"] is None
            continue
        for r in row["runs"]:
            assert not got[r["row"], r["start"] : r["stop"]].any()
            got[r["row"], r["start"] : r["stop"]] = True
        s = shapes[row["i"]]
        assert (got == (P.rasterize(s, 40, 30) if len(s) > 2 else False)).all()


def test_regions(spark):
    rng = np.random.default_rng(4)
    grids = {d: rng.random((14, 17)) < share for d, share in enumerate((0.1, 0.3, 0.4, 0.6, 1.0))}
    cells = [(d, int(r), int(c)) for d, g in grids.items() for r, c in zip(*np.nonzero(g), strict=True)]
    px = spark.createDataFrame(cells + cells[:20], "det_id long, row int, col int")
    for least in (1, 4):
        want = set()
        for d, g in grids.items():
            left = {(int(r), int(c)) for r, c in zip(*np.nonzero(g), strict=True)}
            while left:
                open_, found = [left.pop()], set()
                while open_:
                    r, c = open_.pop()
                    found.add((r, c))
                    near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                    left -= near
                    open_ += near
                if len(found) >= least:
                    want.add((d, frozenset(found)))
        got = {}
        for r in masks.regions(px, least).collect():
            assert (r["row"], r["col"]) not in got.setdefault((r["det_id"], r["region"]), set())
            got[r["det_id"], r["region"]].add((r["row"], r["col"]))
        assert {(d, frozenset(c)) for (d, _), c in got.items()} == want


def test_rle_string():
    assert masks.rle_string([0]) == "0" and masks.rle_string([5, 40, 100]) == "5X1T3"


def test_formats(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [100, 0], [100, 50], [0, 0]]]}, "properties": {"class_id": 1, "image_size": [200, 100], "image_ref": "a.png"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[20, 10], [40, 10], [40, 30]]]}, "properties": {"class_id": 0, "image_ref": "a.png"}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    lines = [r["line"] for r in formats.read_geojson(spark, str(tmp_path / "g.json"), True).orderBy("line").collect()]
    assert lines == ["0 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000 0.000000 0.000000", "0 0.100000 0.100000 0.200000 0.100000 0.200000 0.300000"]
    nd = [{"type": "dataset", "task": "detect"}, {"type": "image", "file": "x.jpg", "width": 4, "height": 3, "split": "train", "annotations": {"boxes": [[1, 0.5, 0.5, 0.1, 0.2], [0, 0.1, 0.1, 0.1, 0.1]], "segments": [[2, 0, 0]]}}]
    (tmp_path / "n.ndjson").write_text("\n".join(map(json.dumps, nd)))
    assert [(r["kind"], r["cls"], r["numbers"]) for r in formats.read_ndjson(spark, str(tmp_path / "n.ndjson")).collect()] == [("boxes", 1, [0.5, 0.5, 0.1, 0.2]), ("boxes", 0, [0.1, 0.1, 0.1, 0.1])]
    coco = {"images": [{"id": 1, "width": 100, "height": 50, "file_name": "a", "caption": "A Red ship here"}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 10], "iscrowd": False, "tokens_positive": [[2, 5], [6, 10]]}, {"image_id": 1, "category_id": 3, "bbox": [10, 10, 0, 10], "iscrowd": False, "tokens_positive": [[0, 1]]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    out = formats.grounding(*formats.read_coco(spark, str(tmp_path / "c.json"))).collect()
    assert [tuple(r) for r in out] == [(1, "red ship", 0.2, 0.3, 0.2, 0.2)]
    det = spark.createDataFrame([(1, 7, 0, 0.5, 1.0, 2.0, 3.0, 4.0), (1, 8, 5, 0.25, 1.0, 2.0, 3.0, 4.0)], "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    formats.write_geojson(det, str(tmp_path / "out"), ["ship"], GEO, "EPSG:4326")
    made = json.loads(next((tmp_path / "out").glob("*.txt")).read_text())
    assert [f["properties"]["class_name"] for f in made["features"]] == ["ship", "class_5"] and made["crs"]["properties"]["name"] == "EPSG:4326"
    ring = made["features"][0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 5
    formats.write_geojson(det.limit(0), str(tmp_path / "none"), [], GEO, "EPSG:4326")
    assert json.loads(next((tmp_path / "none").glob("*.txt")).read_text())["features"] == []


def test_shares_of_tiles_cover_the_image(spark):
    from tessel.operators.tiles import edge_weight, mosaic, tile_grid

    tiles = tile_grid(spark.createDataFrame([(1, 50, 70)], "image_id long, height int, width int"), 32, 0.25)
    px = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("j"))
    px = px.select("image_id", (F.col("row_off") + F.col("i")).alias("row"), (F.col("col_off") + F.col("j")).alias("col"), "i", "j", "h", "w", F.lit(5.0).alias("v"))
    weight = F.least(edge_weight(F.col("i"), F.col("h"), 4), edge_weight(F.col("j"), F.col("w"), 4))
    for out in (mosaic(px), mosaic(px, weight)):
        got = out.collect()
        assert len(got) == 3500 and all(math.isclose(r["v"], 5, rel_tol=1e-6) for r in got)


def test_neighbours_follow_from_the_place_without_a_join(spark):
    from tessel.operators.tiles import neighbours, overlap_strips, tile_grid

    im = spark.createDataFrame([(1, 50, 70), (2, 0, 9), (3, 5, 5), (4, 24, 200), (None, 90, 90)], "image_id long, height int, width int")
    grid = [tuple(r) for r in tile_grid(im.where("image_id IS NOT NULL"), 32, 0.25).select("image_id", "tile_id", "grid_row", "grid_col", "row_off", "col_off", "h", "w").collect()]
    want, strips = set(), set()
    for a in grid:
        for b in grid:
            if a[0] == b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 1 and abs(a[3] - b[3]) <= 1:
                want.add((*a[:2], b[1], *a[4:], *b[4:]))
                s = (max(a[4], b[4]), max(a[5], b[5]), min(a[4] + a[6], b[4] + b[6]), min(a[5] + a[7], b[5] + b[7]))
                strips |= {(*a[:2], b[1], *s)} if s[0] < s[2] and s[1] < s[3] else set()
    got = neighbours(im, 32, 0.25)
    assert sorted(map(tuple, got.collect())) == sorted(want) and sorted(map(tuple, overlap_strips(im, 32, 0.25).collect())) == sorted(strips)
    for name in ("t4_adjacency_map", "t5_overlap_regions", "j21_mask_bbox_iou_of_tiles"):  # a join sent all tiles to the driver
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_resample_copies_no_ring_for_each_point(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0)],)], "ring array<struct<x: double, y: double>>").select(R.resample(F.col("ring"), 7).alias("r"))
    assert "concat" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(p) for p in df.first()["r"]] == [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 1.0), (4.0, 2.0), (2.0, 1.0), (0.0, 0.0)]
