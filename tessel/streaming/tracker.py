"""Two-stage association tracking with constant-velocity Kalman filters, over one stream's frames.

High-scored boxes of a frame match tracks first, low-scored ones the tracks left over; unmatched tracks are kept as lost
for some frames, and unmatched high-scored boxes start new ones. State is plain numbers, so the same step serves a batch
(frames of a stream in order) and a streaming query (state between micro-batches).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessel.session import ship

POSITION, VELOCITY = 1 / 20, 1 / 160  # shares of the height that deviate in a frame


@dataclass
class Config:
    """Thresholds of the two bands, of new tracks and of matching; frames that a lost track lives."""

    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    match: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    buffer: int = 30
    fuse: bool = True


@dataclass
class Track:
    track_id: int
    mean: list[float]
    cov: list[list[float]]
    score: float
    cls: str
    start: int
    frame: int
    state: str = "tracked"  # or lost
    active: bool = False
    event: str = "start"  # what its last frame was: start, activate, confirm, update or re_activate


@dataclass
class State:
    """A stream's tracks, its frame counter and its own id counter."""

    frame: int = 0
    next_id: int = 1
    tracks: list[Track] = field(default_factory=list)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(s: str) -> State:
        d = json.loads(s)
        return State(d["frame"], d["next_id"], [Track(**t) for t in d["tracks"]])


def to_xyah(b: np.ndarray) -> np.ndarray:
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, w / h, h])


def to_box(mean: np.ndarray) -> np.ndarray:
    w, h = mean[2] * mean[3], mean[3]
    return np.array([mean[0] - w / 2, mean[1] - h / 2, mean[0] + w / 2, mean[1] + h / 2])


def _noise(h: float, aspect: float, scale: float) -> np.ndarray:
    return np.array([scale * POSITION * h, scale * POSITION * h, aspect, scale * POSITION * h])


def initiate(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A measurement at rest, with wide deviations."""
    h = z[3]
    std = np.concatenate([_noise(h, 1e-2, 2), [10 * VELOCITY * h, 10 * VELOCITY * h, 1e-5, 10 * VELOCITY * h]])
    return np.concatenate([z, np.zeros(4)]), np.diag(std**2)


_MOVE = np.eye(8) + np.eye(8, k=4)
_SEE = np.eye(4, 8)


def predict(mean: np.ndarray, cov: np.ndarray, tracked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One frame on; a track that isn't tracked keeps its height."""
    mean = mean.copy()
    if not tracked:
        mean[7] = 0
    h = mean[3]
    std = np.concatenate([_noise(h, 1e-2, 1), [VELOCITY * h, VELOCITY * h, 1e-5, VELOCITY * h]])
    return _MOVE @ mean, _MOVE @ cov @ _MOVE.T + np.diag(std**2)


def observe(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of what would be measured."""
    return _SEE @ mean, _SEE @ cov @ _SEE.T + np.diag(_noise(mean[3], 1e-1, 1) ** 2)


def correct(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after a measurement."""
    m, s = observe(mean, cov)
    gain = np.linalg.solve(s, (cov @ _SEE.T).T).T
    return mean + gain @ (z - m), cov - gain @ s @ gain.T


def to_xywh(b: np.ndarray) -> np.ndarray:
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])


def _noise_wh(mean: np.ndarray, scale: float, share: float) -> np.ndarray:
    """Deviations of the filter over width and height: of x and w by the width, of y and h by the height."""
    return scale * share * np.array([mean[2], mean[3], mean[2], mean[3]])


def initiate_wh(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R9 for a state of centre, width and height."""
    return np.concatenate([z, np.zeros(4)]), np.diag(np.concatenate([_noise_wh(z, 2, POSITION), _noise_wh(z, 10, VELOCITY)]) ** 2)


def predict_wh(mean: np.ndarray, cov: np.ndarray, tracked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One frame on; a track that isn't tracked keeps its width and height."""
    mean = mean.copy()
    if not tracked:
        mean[6:] = 0
    std = np.concatenate([_noise_wh(mean, 1, POSITION), _noise_wh(mean, 1, VELOCITY)])
    return _MOVE @ mean, _MOVE @ cov @ _MOVE.T + np.diag(std**2)


def warp(mean: np.ndarray, cov: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after the camera moved by a 2 by 3 matrix: its rotation on every pair of the state, then the shift."""
    turn = np.kron(np.eye(4), h[:, :2])
    mean = turn @ mean
    mean[:2] += h[:, 2]
    return mean, turn @ cov @ turn.T


def gating(mean: np.ndarray, cov: np.ndarray, zs: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of measurements."""
    m, s = observe(mean, cov)
    d = zs - m
    return np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T)


def iou_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """J31."""
    i = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0).prod(axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return 1 - i / (area(a)[:, None] + area(b)[None, :] - i + 1e-7)


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The pairs of a minimum-cost assignment in which a pair may cost at most limit, or be left out for it.

    Rows and columns that no pair within the limit connects are apart: each such group is a problem of its own, and a
    pair alone needs none.
    """
    rows, cols = np.nonzero(cost <= limit)
    n = cost.shape[0]
    of = np.arange(n + cost.shape[1])
    while len(rows):
        low, was = np.minimum(of[rows], of[n + cols]), of.copy()
        np.minimum.at(of, rows, low)
        np.minimum.at(of, n + cols, low)
        of = of[of]
        if (of == was).all():
            break
    out = []
    for g in np.unique(of[rows]):
        a, b = np.flatnonzero(of[:n] == g), np.flatnonzero(of[n:] == g)
        pairs = [(0, 0)] if len(a) == len(b) == 1 else _assign(cost[np.ix_(a, b)], limit)
        out += [(int(a[i]), int(b[j])) for i, j in pairs]
    return sorted(out, key=lambda p: p[1])


def _assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The whole problem: a square one with a stand-in row for each column and the reverse, at half the limit each, solved
    by shortest augmenting paths with potentials."""
    n, m = cost.shape
    full = np.full((n + m, n + m), limit / 2)
    full[:n, :m] = np.where(cost <= limit, cost, 1e6)
    full[n:, m:] = 0
    size = n + m
    u, v, of, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        of[0], j = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j] = True
            now = full[of[j] - 1] - u[of[j]] - v[1:]
            free = ~used[1:]
            better = free & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j
            step = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[step]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = step
            if of[j] == 0:
                break
        while j:
            of[j], j = of[way[j]], way[j]
    return [(int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j] <= n and cost[of[j] - 1, j - 1] <= limit]


def _match(tracks: list[Track], boxes: np.ndarray, scores: np.ndarray, limit: float, fuse: bool) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    if not tracks or not len(boxes):
        return [], list(range(len(tracks))), list(range(len(boxes)))
    cost = iou_cost(np.array([to_box(np.array(t.mean)) for t in tracks]), boxes)
    if fuse:
        cost = 1 - (1 - cost) * scores[None, :]
    pairs = assign(cost, limit)
    a, b = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(len(tracks)) if i not in a], [j for j in range(len(boxes)) if j not in b]


def step(state: State, boxes: np.ndarray, scores: np.ndarray, classes: list[str], config: Config = Config()) -> list[tuple[Track, int]]:
    """One frame; the active tracks matched in it and the row of each one's box."""
    state.frame += 1
    now: list[tuple[Track, int]] = []

    def take(track: Track, row: int) -> None:
        mean, cov = correct(np.array(track.mean), np.array(track.cov), to_xyah(boxes[row]))
        track.mean, track.cov, track.score, track.cls = mean.tolist(), cov.tolist(), float(scores[row]), classes[row]
        track.event = "confirm" if not track.active else "re_activate" if track.state == "lost" else "update"
        track.frame, track.state, track.active = state.frame, "tracked", True
        now.append((track, row))

    for t in state.tracks:
        if not t.active:
            continue  # a track of one frame is matched where it was seen
        mean, cov = predict(np.array(t.mean), np.array(t.cov), t.state == "tracked")
        t.mean, t.cov = mean.tolist(), cov.tolist()
    fresh = [t for t in state.tracks if not t.active]
    pool = [t for t in state.tracks if t.active]
    first, second = np.flatnonzero(scores >= config.high), np.flatnonzero((scores > config.low) & (scores < config.high))
    pairs, left, free = _match(pool, boxes[first], scores[first], config.match, config.fuse)
    for i, j in pairs:
        take(pool[i], int(first[j]))
    rest = [pool[i] for i in left if pool[i].state == "tracked"]
    pairs, left, _ = _match(rest, boxes[second], scores[second], config.second, False)
    for i, j in pairs:
        take(rest[i], int(second[j]))
    for i in left:
        rest[i].state = "lost"
    open_ = first[free]
    pairs, left, free = _match(fresh, boxes[open_], scores[open_], config.unconfirmed, config.fuse)
    for i, j in pairs:
        take(fresh[i], int(open_[j]))
    gone = {id(fresh[i]) for i in left}
    for j in free:
        row = int(open_[j])
        if scores[row] >= config.new:
            mean, cov = initiate(to_xyah(boxes[row]))
            track = Track(state.next_id, mean.tolist(), cov.tolist(), float(scores[row]), classes[row], state.frame, state.frame, active=state.frame == 1)
            state.next_id += 1
            state.tracks.append(track)
            if track.active:
                track.event = "activate"
                now.append((track, row))
    state.tracks = [t for t in state.tracks if id(t) not in gone and not (t.state == "lost" and state.frame - t.frame > config.buffer)]
    _drop_doubles(state)
    alive = {id(t) for t in state.tracks}
    return [(t, r) for t, r in now if id(t) in alive]


def _drop_doubles(state: State, near: float = 0.15) -> None:
    """Of a tracked and a lost track that overlap nearly wholly, the longer-lived stays, the lost one on a tie."""
    a, b = [t for t in state.tracks if t.state == "tracked"], [t for t in state.tracks if t.state == "lost"]
    if a and b:
        cost = iou_cost(np.array([to_box(np.array(t.mean)) for t in a]), np.array([to_box(np.array(t.mean)) for t in b]))
        gone = set()
        for i, j in zip(*np.nonzero(cost < near), strict=True):
            gone.add(id(b[j]) if a[i].frame - a[i].start > b[j].frame - b[j].start else id(a[i]))
        state.tracks = [t for t in state.tracks if id(t) not in gone]


OUTPUT = "stream_id long, frame long, det_id long, track_id long, score double, event string"


def _frames(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from pdf.sort_values(["frame", "det_id"]).groupby("frame", sort=True)


def run_frames(state: State, pdf: pd.DataFrame, stream_id: int, config: Config) -> pd.DataFrame:
    """All frames of a table in order; frames up to the state's counter have been seen and are left out."""
    rows = []
    for frame, g in _frames(pdf):
        if int(frame) <= state.frame:
            continue
        while state.frame < int(frame) - 1:  # frames without boxes
            step(state, np.empty((0, 4)), np.empty(0), [], config)
        boxes = g[["x1", "y1", "x2", "y2"]].to_numpy(float)
        for t, i in step(state, boxes, g["conf"].to_numpy(float), g["cls"].astype(str).tolist(), config):
            rows.append((stream_id, int(frame), int(g["det_id"].iloc[i]), t.track_id, float(t.score), t.event))
    return pd.DataFrame(rows, columns=["stream_id", "frame", "det_id", "track_id", "score", "event"])


def track_batch(det: DataFrame, config: Config = Config()) -> DataFrame:
    """R1 over a table (stream_id, frame, det_id, conf, cls, corners): a stream is one task's work, streams run side by side."""
    ship(det.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run_frames(State(), pdf, int(key[0]), config)

    return det.groupBy("stream_id").applyInPandas(run, OUTPUT)


def track_videos(det: DataFrame, config: Config = Config(), persist: bool = False) -> DataFrame:
    """R1 over a table that also has video. Unless persist is given a new video begins with new tracks, and ids from 1."""
    ship(det.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, parts = State(), []
        for video, own in pdf.groupby("video", sort=True):
            if not persist:
                state = State(frame=int(own["frame"].min()) - 1)
                own = own.assign(frame=own["frame"] - state.frame)
                shift, state.frame = state.frame, 0
            else:
                shift = 0
            found = run_frames(state, own, int(key[0]), config)
            parts.append(found.assign(video=int(video), frame=found["frame"] + shift))
        return pd.concat(parts)

    return det.groupBy("stream_id").applyInPandas(run, OUTPUT + ", video int")


def track_stream(det: DataFrame, config: Config = Config(), idle: int | None = None) -> DataFrame:
    """R1, R17 over a streaming table: the state of each stream lives in the state store and, where idle is given,
    ends after so many milliseconds without frames (such a query never runs out of batches to look for timeouts in)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(det.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = State.loads(held.get[0]) if held.exists else State()
        yield run_frames(state, pd.concat(list(frames)), int(key[0]), config)
        held.update((state.dumps(),))
        if idle is not None:
            held.setTimeoutDuration(idle)

    return det.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
