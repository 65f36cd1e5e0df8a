"""Unions of polygons against pixel counts, merged masks, tracks and their events, and hashes and windows of whole tables."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.functions import polygons as P
from tessel.operators import datasets as D
from tessel.operators import masks as M
from tessel.plans import registry
from tessel.plans.geometry import GEO
from tessel.sources import formats
from tessel.streaming import tracker as T

SF = "/root/testdata/sf0.001"
L = np.array([[0, 0], [6, 0], [6, 2], [2, 2], [2, 6], [0, 6]], float)


def test_union_of_shapes_with_holes_and_pieces():
    bar, far = np.array([[4, 1], [8, 1], [8, 5], [4, 5]], float), np.array([[20, 0], [22, 0], [22, 3]], float)
    assert np.isclose(P.area_of(P.union([L])), 20) and np.isclose(P.area_of(P.union([L, L])), 20)
    assert np.isclose(P.area_of(P.union([L, bar])), 20 + 16 - 2) and np.isclose(P.area_of(P.union([L, far])), 23)
    frame = [np.array(r, float) for r in ([[0, 0], [9, 0], [9, 2], [0, 2]], [[0, 7], [9, 7], [9, 9], [0, 9]], [[0, 0], [2, 0], [2, 9], [0, 9]], [[7, 0], [9, 0], [9, 9], [7, 9]])]
    assert np.isclose(P.area_of(P.union(frame)), 81 - 25)  # a hole stays open
    assert P.union([]) == [] and P.union([L[:2]]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=5, unique=True), min_size=1, max_size=4))
def test_union_area_is_that_of_its_points(rings):
    """Against the share of a fine lattice of points that an odd number of a ring's edges lies left of."""
    y, x = (np.mgrid[0:30:0.1, 0:30:0.1] + 0.0373).reshape(2, -1)
    inside = np.zeros(len(x), bool)
    for r in rings:
        own = np.zeros(len(x), bool)
        for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True):
            if b != d:
                own ^= ((b > y) != (d > y)) & (x < a + (y - b) * (c - a) / (d - b))
        inside |= own
    assert abs(P.area_of(P.union([np.array(r, float) for r in rings])) - inside.mean() * 900) < 8


def test_merged_shapes_against_cells(spark):
    out = registry.queries()["a9_merge_polygons_vector"](spark, SF).toPandas()
    big = out[out.members > 1]
    assert len(big) and (big.area > 0).all()
    for r in big.head(30).itertuples():
        cells = set()
        for p in r.parts:
            p = np.array([list(q) for q in p])
            cells |= {(i, j) for i in range(int(p[:, 0].min()), int(p[:, 0].max())) for j in range(int(p[:, 1].min()), int(p[:, 1].max()))}
        assert np.isclose(len(cells), r.area)


def test_compact_map_has_no_gaps(spark):
    px = spark.createDataFrame([(1, i, r, c, 0.5, 0) for i, (a, b) in enumerate([(0, 3), (0, 3), (2, 5)]) for r in range(a, b) for c in range(3)], "image_id long, det_id long, row int, col int, conf double, cls int")
    assert {r["instance"] for r in M.instance_map(px).collect()} == {2, 3}  # the first is painted over
    assert {r["instance"] for r in M.compact_map(px).collect()} == {1, 2}


def _run(rows, **config):
    state, out = T.State(), []
    pdf = pd.DataFrame(rows, columns=["frame", "det_id", "conf", "x1"]).assign(cls="a", y1=0.0, x2=lambda d: d.x1 + 40, y2=60.0)
    return T.run_frames(state, pdf, 0, T.Config(**config)).values.tolist(), state


def test_events_of_a_track():
    rows = [(f, f, 0.2 if f == 5 else 0.9, 10.0 + 2 * f) for f in range(1, 16) if f not in (8, 9)] + [(f, 100 + f, 0.9, 300.0) for f in range(3, 16)]
    out, _ = _run(rows)
    one = {r[1]: (r[3], r[5]) for r in out if r[2] < 100}
    two = {r[1]: (r[3], r[5]) for r in out if r[2] > 100}
    assert one[1] == (1, "activate") and one[2] == (1, "update") and one[5] == (1, "update")  # the low score is held by the second stage
    assert one[10] == (1, "re_activate") and one[11] == (1, "update") and set(one) == {*range(1, 8), *range(10, 16)}
    assert 3 not in two and two[4] == (2, "confirm")  # seen twice before it counts
    gone, state = _run([(1, 1, 0.9, 0.0), (60, 2, 0.9, 0.0)], buffer=5)
    assert [r[3] for r in gone] == [1] and [t.track_id for t in state.tracks] == [2]


def test_new_tracks_are_not_predicted():
    state = T.State()
    T.step(state, np.array([[0.0, 0, 40, 60]]), np.array([0.9]), ["a"])
    T.step(state, np.array([[0.0, 0, 40, 60], [300, 0, 340, 60]]), np.array([0.9, 0.9]), ["a", "a"])
    before = state.tracks[1].cov
    T.step(state, np.array([[0.0, 0, 40, 60], [300, 0, 340, 60]]), np.array([0.9, 0.9]), ["a", "a"])
    mean, cov = T.correct(*T.initiate(T.to_xyah(np.array([300.0, 0, 340, 60]))), T.to_xyah(np.array([300.0, 0, 340, 60])))
    assert np.allclose(state.tracks[1].cov, cov) and not np.allclose(before, cov)


def test_videos_begin_anew(spark):
    rows = [(7, v, f, f, 0.9, "a", 10.0, 0.0, 50.0, 60.0) for v, f in ((0, 1), (0, 2), (1, 3), (1, 4))]
    det = spark.createDataFrame(rows, "stream_id long, video int, frame long, det_id long, conf double, cls string, x1 double, y1 double, x2 double, y2 double")
    anew = T.track_videos(det).orderBy("frame").collect()
    assert [(r["video"], r["frame"], r["track_id"], r["event"]) for r in anew] == [(0, 1, 1, "activate"), (0, 2, 1, "update"), (1, 3, 1, "activate"), (1, 4, 1, "update")]
    kept = T.track_videos(det, persist=True).orderBy("frame").collect()
    assert [(r["track_id"], r["event"]) for r in kept] == [(1, "activate"), (1, "update"), (1, "update"), (1, "update")]


def test_width_height_filter():
    z = np.array([5.0, 6.0, 40.0, 10.0])
    mean, cov = T.predict_wh(*T.initiate_wh(z))
    assert np.allclose(mean[:4], z) and np.isclose(cov[0, 0], (4**2) + 2.5**2 + 2**2) and np.isclose(cov[1, 1], 1 + 0.625**2 + 0.5**2)


def test_gated_assignment_equals_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(40):
        cost = rng.random((rng.integers(1, 7), rng.integers(1, 7)))
        value = lambda pairs: sum(cost[i, j] - 0.3 for i, j in pairs)  # noqa: B023, E731
        assert np.isclose(value(T.assign(cost, 0.3)), value(T._assign(cost, 0.3)))


def test_hash_of_files_does_not_depend_on_order(spark):
    rows = [(f"p{i}", i) for i in range(50)]
    frame = lambda r: spark.createDataFrame(r, "path string, size long")
    a, b, c = (D.file_hash(frame(r)).first()[0] for r in (rows, rows[::-1], rows[1:]))
    assert a == b != c and len(D.file_hash(frame([])).first()[0]) == 64


def test_piece_pairs_over_tiles(spark):
    """Masks of any form, in one tile or in several, against their pixels; pixels of a mask that come twice count once."""
    rng, masks = np.random.default_rng(4), {}
    for i in range(14):
        r, c, h, w = *rng.integers(-20, 120, 2), *rng.integers(1, 90 if i % 2 else 12, 2)
        masks[i] = {(int(r + y), int(c + x)) for y in range(h) for x in range(w) if i % 3 or (x + y) % 5 == 0}
    rows = [(1, i, r, c, i % 2, 0.5) for i, m in masks.items() for r, c in m]
    px = spark.createDataFrame(rows + rows[:9], "image_id long, det_id long, row int, col int, cls int, conf double").repartition(4)
    box = lambda m: (min(r for r, _ in m), min(c for _, c in m), max(r for r, _ in m), max(c for _, c in m))
    want = {}
    for a in masks:
        for b in range(a + 1, 14):
            if masks[a] & masks[b]:
                p, q = box(masks[a]), box(masks[b])
                lies = lambda s: max(p[0], q[0]) <= s[0] <= min(p[2], q[2]) and max(p[1], q[1]) <= s[1] <= min(p[3], q[3])  # noqa: B023, E731
                want[a, b] = (len(masks[a] & masks[b]), sum(map(lies, masks[a])) + sum(map(lies, masks[b])), len(masks[a]), len(masks[b]))
    p = M.pieces(px, "cls", "conf")
    assert {r.one for r in p.collect()} == {True, False}
    got = {(r.a, r.b): (r.inter, r.both, r.a_n, r.b_n) for r in M.piece_pairs(p, p, window=True).collect()}
    assert got == want and len({k for k in want if k[0] % 2 and k[1] % 2}) > 1
    groups = {i: {i} for i in masks}
    for a, b in want:
        new = groups[a] | groups[b]
        groups |= {i: new for i in new}
    out = {r.group_id: (r.members, r.size) for r in M.merge_pieces(p, "true", True).collect()}
    assert out == {min(g): (len(g), len(set().union(*[masks[i] for i in g]))) for g in groups.values()}


@pytest.mark.parametrize("name", ["j23_has_pixel_overlap"])
def test_masks_meet_without_their_pixels(spark, name):
    det = spark.createDataFrame([(1, 1, 0, 0.5, 0.0, 0.0, 4e3, 4e3), (1, 2, 0, 0.5, 8.0, 8.0, 8.0, 8.0)], "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert M.box_pieces(det).count() == 65 and M.box_pixels(det).count() == 501 * 501 + 1  # what moves is tiles
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "hashpartitioning" in plan or "RepartitionByExpression" in plan


BOX = "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def _boxes(n: int = 60, seed: int = 5) -> list[tuple]:
    """Boxes of two images, small ones and some over several tiles; the first comes twice."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        x, y, w, h = *rng.integers(0, 900, 2), *rng.integers(1, 900 if i % 9 == 0 else 90, 2)
        out.append((i % 2, i, int(rng.integers(0, 3)), round(float(rng.random()), 4), float(x), float(y), float(x + w), float(y + h)))
    return [*out, out[0]]


def test_box_pieces_meet_as_their_pixels_do(spark):
    det = spark.createDataFrame(_boxes(), BOX)
    for window in (False, True):
        told = lambda p: sorted((r.image_id, r.a, r.b, r.inter, r.both, r.a_n, r.b_n) for r in M.piece_pairs(p, p, window=window).collect())  # noqa: B023, E731
        got = told(M.box_pieces(det))
        assert got == told(M.pieces(M.box_pixels(det).distinct())) and len(got) > 20


def test_corners_in_a_tile_move_as_one_number(spark, monkeypatch):
    moved, packed = [], M._packed
    monkeypatch.setattr(M, "_packed", lambda d, *also: moved.append(packed(d, *also)) or moved[-1])
    det = spark.createDataFrame([*_boxes(), (0, 99, 0, 0.5, -70.0, -600.0, -5.0, -515.0), (0, 98, 0, 0.5, -9.0, -9.0, 9.0, 9.0)], BOX)
    got = {(r.det_id, r.ty, r.tx): tuple(r[c] for c in M._BOX) + (r.one, r.n) for r in M.box_pieces(det).collect()}
    want = {}
    for r in det.collect():
        a, b, c, d = (int(np.floor(r[x] / 8)) for x in M._BOX)
        tiles = [(y, x) for y in range(b >> 6, (d >> 6) + 1) for x in range(a >> 6, (c >> 6) + 1)]
        want |= {(r.det_id, *t): (a, b, c, d, len(tiles) == 1, (c - a + 1) * (d - b + 1)) for t in tiles}
    assert got == want and {v[4] for v in got.values()} == {True, False} and (99, -2, -1) in got
    assert all((r.at is None) == (r.x1 is not None) for r in moved[0].collect())


@pytest.mark.parametrize("name", ["j23_has_pixel_overlap", "j25_mask_iou_batch", "a13_merge_overlapping_masks_only", "a15_merge_masks_with_iou_optimized"])
def test_masks_in_a_tile_move_without_corners(spark, monkeypatch, name):
    moved, written, packed, write = [], [], M._packed, M.materialize
    monkeypatch.setattr(M, "_packed", lambda d, *also: moved.append(packed(d, *also)) or moved[-1])
    monkeypatch.setattr(M, "materialize", lambda d, n: written.append((n, write(d, n))) or written[-1][1])
    registry.queries()[name](spark, SF)
    assert moved and moved[0].where("at IS NULL OR x1 IS NOT NULL OR y2 IS NOT NULL").count() == 0 < moved[0].count()
    assert {r.conf for n, d in written if n == "pieces" for r in d.where("closed").select("conf").distinct().collect()} <= {0.0}  # no means, which no one asks for


@pytest.mark.parametrize("name", ["j24_mask_iou_window", "j23_has_pixel_overlap", "j25_mask_iou_batch"])
def test_boxes_meet_by_their_corners(spark, name):
    """Each side moves once, to its tile, and neither its blocks nor its pairs after that."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "bit_count" not in plan and "bitwise" not in plan
    assert registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_box_pieces_merge_as_their_pixels_do(spark, monkeypatch):
    det = spark.createDataFrame(_boxes(90, 6), BOX)
    told = lambda p: sorted((r.group_id, r.members, r.cls, round(r.conf, 6), r.size) for r in M.merge_pieces(p, test, True).collect())
    for test in (lambda a, b, iou: iou > 0.5, lambda a, b, iou: (iou > 0.5) & (a("cls") == b("cls"))):
        for chunk in (1 << 17, 4):  # tiles that come in several batches
            monkeypatch.setattr(M, "_CHUNK", chunk)
            got = told(M.box_pieces(det, "cls", "conf"))
            assert got == told(M.pieces(M.box_pixels(det).distinct(), "cls", "conf")) and {r[1] for r in got} >= {1, 2}


def test_groups_in_one_tile_need_no_rounds(spark, monkeypatch):
    links = []
    monkeypatch.setattr(M, "components", lambda d, a, b: links.append(d.count()) or M_components(d, a, b))
    det = spark.createDataFrame([(0, i, 0, 0.5, float(3 * i), 0.0, 3.0 * i + 20, 20.0) for i in range(50)], BOX)
    assert [tuple(r) for r in M.merge_pieces(M.box_pieces(det, "cls", "conf"), lambda a, b, iou: iou > 0.5, True).collect()] == [(0, 50, 0, 0.5, 3 * 21)] and links == [0]


M_components = M.components


def test_instances_of_pieces_are_those_of_pixels(spark):
    det = spark.createDataFrame(_boxes(70, 7), BOX)
    want = M.compact_map(M.box_pixels(det)).toPandas().groupby(["image_id", "instance"]).agg(n=("row", "size"), top=("row", "min"), right_=("col", "max")).reset_index()
    for p in (M.box_pieces(det), M.pieces(M.box_pixels(det).distinct())):
        assert sorted(map(tuple, M.compact_instances(p).collect())) == sorted(map(tuple, want.values.tolist()))


def test_regions_of_rectangles_are_those_of_pixels(spark):
    rects = [(1, 0, 0, 9, 9), (1, 0, 0, 9, 9), (2, 0, 0, 3, 3), (2, 4, 4, 6, 9), (2, 20, 0, 22, 2), (3, 0, 0, 1, 1), (4, 0, 0, 5, 5), (4, 3, 3, 8, 8)]
    r = spark.createDataFrame(rects, "det_id long, x1 int, y1 int, x2 int, y2 int")
    px = spark.createDataFrame([(d, y, x) for d, a, b, c, e in rects for y in range(b, e + 1) for x in range(a, c + 1)], "det_id long, row int, col int")
    want = M.regions(px, 5).groupBy("det_id", "region").count().collect()
    got = sorted((x.det_id, x["size"]) for x in M.rectangle_regions(r, 5).collect())
    assert got == sorted((x.det_id, x["count"]) for x in want) == [(1, 100), (2, 9), (2, 34), (4, 63)]


def test_share_of_a_window_against_clipping():
    rng = np.random.default_rng(3)
    p, at = rng.integers(0, 12, (200, 3, 2)).astype(float), rng.integers(0, 8, (200, 2)).astype(float)
    got = P.window_areas([(p[:, i, 0], p[:, i, 1]) for i in range(3)], (at[:, 0], at[:, 1], at[:, 0] + 5, at[:, 1] + 4))
    want = [P.area(P.clip_convex(t, np.array([[x, y], [x + 5, y], [x + 5, y + 4], [x, y + 4]]))) for t, (x, y) in zip(p, at, strict=True)]
    assert np.allclose(got, want) and max(want) > 5


def test_unions_of_many_at_once():
    rng = np.random.default_rng(8)
    rings = [rng.integers(0, 12, (300, k, 2)).astype(float) for k in (3, 4, 5)]
    assert np.allclose(P.union_areas(rings), [P.area_of(P.union([r[i] for r in rings])) for i in range(300)])


def test_geojson_in_parts_is_one_document(spark, tmp_path):
    import gzip
    import json

    det = spark.createDataFrame(_boxes(40, 9)[:-1], BOX)
    for n, d in ((40, det.repartition(5)), (0, det.limit(0))):
        path = str(tmp_path / str(n))
        formats.write_geojson_parts(d, path, ["ship"], GEO, "EPSG:4326")
        parts = sorted(p for p in (tmp_path / str(n)).glob("part-*.gz"))
        made = json.loads(gzip.decompress(b"".join(p.read_bytes() for p in parts)))
        assert [f["properties"]["id"] for f in made["features"]] == list(range(n)) and made["crs"]["properties"]["name"] == "EPSG:4326"
        (tmp_path / f"{n}.json").write_text(json.dumps(made))
        whole = sorted(map(tuple, formats.read_geojson(spark, str(tmp_path / f"{n}.json")).collect()), key=str)
        assert sorted(map(tuple, formats.read_geojson_parts(spark, path).collect()), key=str) == whole and len(whole) == n
        assert len(parts) >= 3 or not n


@pytest.mark.parametrize("opened", [1 << 19, 7])
def test_packed_boxes_meet_and_merge_as_their_pixels_do(spark, monkeypatch, opened):
    """Also if a task opens few rows at a time; repeats count once, boxes of one det_id that differ in conf do not."""
    monkeypatch.setattr(M, "_OPENED", opened)
    rows = [*_boxes(), (0, 99, 0, 0.5, -70.0, -600.0, -5.0, -515.0), (0, 98, 0, 0.5, -60.0, -590.0, 9.0, 9.0)]
    det = spark.createDataFrame([*rows, *rows[::7]], BOX).repartition(3)
    told = lambda p: sorted((r.image_id, r.a, r.b, r.inter, r.both, r.a_n, r.b_n) for r in M.piece_pairs(p, p, window=True).collect())
    got = told(M.packed_pieces(det))
    assert got == told(M.pieces(M.box_pixels(det).distinct())) and len(got) > 20
    some, cls = det.where("det_id % 3 = 0"), ("cls",)
    two = lambda f: sorted((r.image_id, r.cls, r.a, r.b, r.inter, r.a_n, r.b_n, r.a_conf) for r in M.piece_pairs(f(det, "cls", "conf"), f(some, "cls"), cls, False).collect())
    assert two(M.packed_pieces) == two(M.box_pieces) != []
    twice = det.unionByName(det.where("det_id = 5").selectExpr("image_id", "det_id", "cls", "conf / 2 AS conf", *M._BOX))
    merged = lambda p: sorted((r.group_id, r.members, r.cls, round(r.conf, 6), r.size) for r in M.merge_pieces(p, lambda a, b, iou: a("cls") == b("cls"), True).collect())
    assert merged(M.packed_pieces(twice, "cls", "conf")) == merged(M.box_pieces(twice, "cls", "conf"))
    assert sum(r[1] for r in merged(M.packed_pieces(twice, "cls", "conf"))) == len(set(rows)) + 1


@pytest.mark.parametrize("name", ["a15_merge_masks_with_iou_optimized", "j23_has_pixel_overlap", "j25_mask_iou_batch"])
def test_masks_move_in_packs(spark, monkeypatch, name):
    written, write = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda d, n: written.append(d) or write(d, n))
    out = registry.queries()[name](spark, SF)
    assert "Exchange hashpartitioning(bucket" in [*written, out][0]._jdf.queryExecution().executedPlan().toString()  # what moves first
