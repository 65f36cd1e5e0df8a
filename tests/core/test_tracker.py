from itertools import permutations

import numpy as np
import pandas as pd

from tessel.streaming import tracker as T


def scene(frames=40, objects=4, streams=2, seed=1):
    rng, rows, det = np.random.default_rng(seed), [], 0
    for s in range(streams):
        at, move = rng.uniform(0, 400, (objects, 2)), rng.uniform(-3, 3, (objects, 2))
        for f in range(1, frames + 1):
            for o in range(objects):
                if o == 1 and 15 <= f < 20:
                    continue  # hidden for a while
                x, y = at[o] + move[o] * f + rng.normal(0, 0.3, 2)
                rows.append((s, f, det, 0.9 if f % 5 else 0.2, "a", x, y, x + 40, y + 60, o))
                det += 1
    return pd.DataFrame(rows, columns=["stream_id", "frame", "det_id", "conf", "cls", "x1", "y1", "x2", "y2", "object"])


def test_assign_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 5, 2))
        cost, limit = rng.random((n, m)), 0.7
        got = T.assign(cost, limit)
        value = lambda pairs: sum(cost[i, j] - limit for i, j in pairs)
        least = min(value([(i, p[i]) for i in range(n) if p[i] < m and cost[i, p[i]] <= limit]) for p in permutations(range(n + m), n))
        assert abs(value(got) - least) < 1e-9


def test_tracks_keep_their_objects(spark):
    pdf = scene()
    out = T.track_batch(spark.createDataFrame(pdf.drop(columns="object"))).toPandas().merge(pdf, on=["stream_id", "det_id", "frame"])
    ids = out.groupby(["stream_id", "object"])["track_id"].nunique()
    assert (ids == 1).all() and len(out) > 0.95 * len(pdf)
    assert (out.groupby(["stream_id", "track_id"])["object"].nunique() == 1).all()


def test_stream_equals_batch(spark, tmp_path):
    pdf = scene(frames=30)
    want = T.track_batch(spark.createDataFrame(pdf.drop(columns="object"))).toPandas()
    for i, (a, b) in enumerate(((1, 10), (11, 22), (23, 30))):
        part = spark.createDataFrame(pdf[(pdf.frame >= a) & (pdf.frame <= b)].drop(columns="object")).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    schema = spark.read.parquet(str(tmp_path / "in/b=0")).schema
    import shutil

    (tmp_path / "live").mkdir()
    q = T.track_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "live"))).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(3):
            for f in (tmp_path / f"in/b={i}").glob("*.parquet"):
                shutil.copy(f, tmp_path / "live" / f"{i}-{f.name}")
            q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("tracked").toPandas()
    key = ["stream_id", "frame", "det_id"]
    assert got.sort_values(key)[[*key, "track_id"]].reset_index(drop=True).equals(want.sort_values(key)[[*key, "track_id"]].reset_index(drop=True))


def test_state_round_trip():
    s = T.State()
    T.step(s, np.array([[0, 0, 10, 20.0]]), np.array([0.9]), ["a"])
    assert T.State.loads(s.dumps()) == s
