"""Language-model scoring with a hidden Markov model.

Words are counted over the whole corpus. The most frequent are symbols of a hidden Markov model, the others share a
symbol under which each has its smoothed share, and an end closes every text. A mixture over all windows of training texts
gives the first emissions. Baum-Welch trains the model: tasks run the scaled forward and backward recursions over windows of all training texts, their expected counts are summed across partitions
by symbol, and the driver re-estimates. Scoring runs the scaled forward recursion over whole texts, which gives their
exact probability. Counts of words beyond a bounded table come from a shuffle join, so every count is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import materialize, prepare, read

STATES = 8
SYMBOLS = 1 << 14  # frequent words that are symbols of their own
TABLE = 1 << 18  # words whose counts tasks hold (about 40 MB)
COUNTED = 1 << 18  # words that a task counts before it hands on what it has
WINDOW = 128  # tokens of a training window
ROUNDS = 3
HEATS = (0.02, 0.05, 0.1, 1.0, 1.0, 1.0)  # rounds of the mixture that gives the first emissions; soft at first, so that no window settles by chance
PRIOR = 50.0  # tokens' worth of the corpus distribution in each state's emissions
HELD = 1 << 22  # tokens that a task scores at a time
ADD = 0.1


def words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII white space separates, A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words(text))
        if len(seen) > COUNTED:
            yield out()
            seen.clear()
    yield out()


@dataclass
class Counts:
    """The corpus counts: all tokens, distinct tokens, training texts, the frequent words with theirs, and the rest's."""

    tokens: int
    distinct: int
    texts: int
    table: list[bytes]
    n: np.ndarray
    symbols: int

    def __post_init__(self):
        self.rare_tokens = self.tokens - self.texts - int(self.n[: self.symbols].sum())
        self.rare_distinct = self.distinct - (self.texts > 0) - min(self.symbols, len(self.table))

    def base(self, c) -> np.ndarray:
        return np.log10((np.asarray(c) + ADD) / (self.tokens + ADD * (self.distinct + 1)))

    def rare(self, c) -> np.ndarray:
        return np.log10((np.asarray(c) + ADD) / (self.rare_tokens + ADD * (self.rare_distinct + 1)))


def _tokens(held):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = held.value
        at = {w: i for i, w in enumerate(counts.table)}
        base, rare, k = counts.base(counts.n), counts.rare(counts.n), min(counts.symbols, len(counts.table))
        base, rare = np.append(base, 0.0), np.append(rare, 0.0)  # the last is for words beyond the table
        rare[:k] = 0.0
        end, row = float(counts.base(counts.texts)), TaskContext.get().partitionId() << 36
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("row", "n_tokens", "n_known", "base", "rare", "symbols", "beyond")}
            for text in batch.column(2).to_pylist():
                own = words(text)
                i = np.fromiter((at.get(w, -1) for w in own), np.int64, len(own))
                symbols = np.where((i >= 0) & (i < k), i, k)
                cols["row"].append(row)
                cols["n_tokens"].append(len(own) + 1)
                cols["n_known"].append(int((i >= 0).sum()) + (counts.texts > 0))
                cols["base"].append(float(base[i].sum()) + end)
                cols["rare"].append(float(rare[i].sum()))
                cols["symbols"].append(np.append(symbols, k + 1).astype("<u2").tobytes())
                cols["beyond"].append(list(Counter(own[j] for j in np.flatnonzero(i < 0).tolist()).items()))
                row += 1
            kinds = {"base": pa.float64(), "rare": pa.float64(), "symbols": pa.binary(), "beyond": pa.map_(pa.binary(), pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items())], names=["id", "held_out", *cols])

    return tokens


@dataclass
class Model:
    """Initial, transition and emission probabilities; emission has a row per symbol: words, rare, end."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _mix(held):
    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heat = held.value
        logs, weight, (size, s) = np.log(model.emit), np.log(model.start), model.emit.shape
        emitted, windows = np.zeros((size, s)), np.zeros(s)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            flat, n = np.frombuffer(b"".join(raw), "<u2"), np.fromiter((len(r) // 2 for r in raw), np.int64, len(raw))
            parts = -(-n // WINDOW)
            of = np.repeat(np.arange(len(n)), parts)
            begin = (np.cumsum(n) - n)[of] + (np.arange(len(of)) - (np.cumsum(parts) - parts)[of]) * WINDOW
            ends = np.append(begin[1:], len(flat))
            for i in range(0, len(begin), 1024):
                at = begin[i : i + 1024]
                x, sizes = flat[at[0] : ends[i + len(at) - 1]], ends[i : i + len(at)] - at
                p = heat * (np.add.reduceat(logs[x], at - at[0], axis=0) + weight)
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                windows += p.sum(axis=0)
                for j in range(s):
                    emitted[:, j] += np.bincount(x, weights=np.repeat(p[:, j], sizes), minlength=size)
        used = np.flatnonzero(emitted.any(axis=1))
        values = np.concatenate([emitted[used], windows[None]])
        yield pa.record_batch({"key": pa.array(np.append(used, -1), pa.int64()), **{f"s{j}": pa.array(values[:, j]) for j in range(s)}})

    return mix


def _summed(tokens: DataFrame, f, held, states: int) -> dict[int, np.ndarray]:
    """The sums by key of what f gives with held over all rows of tokens."""
    schema = "key long, " + ", ".join(f"s{j} double" for j in range(states))
    part = tokens.select("symbols").mapInArrow(f(tokens.sparkSession.sparkContext.broadcast(held)), schema)
    return {r[0]: np.array(r[1:]) for r in part.groupBy("key").agg(*[F.sum(f"s{j}") for j in range(states)]).collect()}


def _emissions(got: dict[int, np.ndarray], prior: np.ndarray, states: int) -> np.ndarray:
    emit = PRIOR * np.repeat(prior[:, None], states, axis=1)
    for k, v in got.items():
        if k >= 0:
            emit[k] += v
    return emit / emit.sum(axis=0)


def mixture(tokens: DataFrame, prior: np.ndarray, states: int, heats: tuple[float, ...], seed: int = 3) -> Model:
    """A first model: emissions of a mixture over the windows of all rows of tokens, states that mostly stay."""
    emit = prior[:, None] * np.exp(0.5 * np.random.default_rng(seed).normal(size=(len(prior), states)))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    for heat in heats:
        got = _summed(tokens, _mix, (model, heat), states)
        model = Model((got[-1] + 1) / (got[-1].sum() + states), move, _emissions(got, prior, states))
    return model


def cut(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[i : i + WINDOW] for i in range(0, len(symbols), WINDOW)]


def expected(model: Model, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of sequences, and their log-likelihood, by the scaled recursions."""
    rows = sorted(rows, key=len, reverse=True)
    s, size = len(model.start), len(model.emit)
    sizes = np.array([len(r) for r in rows])
    wide = int(sizes[0])
    x = np.zeros((wide, len(rows)), np.int64)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
    active = [int((sizes > t).sum()) for t in range(wide)]
    alpha, scale = np.zeros((wide, len(rows), s)), np.ones((wide, len(rows)))
    for t in range(wide):
        k = active[t]
        a = (model.start if t == 0 else alpha[t - 1, :k] @ model.move) * model.emit[x[t, :k]]
        scale[t, :k] = c = a.sum(axis=1)
        alpha[t, :k] = a / c[:, None]
    beta, moves = np.ones((len(rows), s)), np.zeros((s, s))
    for t in range(wide - 1, -1, -1):
        k = active[t]
        if t + 1 < wide:
            n = active[t + 1]
            ahead = model.emit[x[t + 1, :n]] * beta[:n] / scale[t + 1, :n, None]
            moves += alpha[t, :n].T @ ahead
            beta[:n] = ahead @ model.move.T
        alpha[t, :k] *= beta[:k]  # the posterior of the state
    there = (np.arange(wide)[:, None] < sizes[None, :]).ravel()
    flat, post = x.ravel()[there], alpha.reshape(-1, s)[there]
    emitted = np.stack([np.bincount(flat, weights=post[:, j], minlength=size) for j in range(s)], axis=1)
    return alpha[0].sum(axis=0), moves * model.move, emitted, float(np.log(scale).sum())


def _expect(held):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        s = len(model.start)
        start, moves, emitted, likelihood = np.zeros(s), np.zeros((s, s)), np.zeros(model.emit.shape), 0.0
        for batch in batches:
            rows = [w for raw in batch.column(0).to_pylist() for w in cut(np.frombuffer(raw, "<u2"))]
            for i in range(0, len(rows), 1024):
                a, b, c, d = expected(model, rows[i : i + 1024])
                start, moves, emitted, likelihood = start + a, moves + b, emitted + c, likelihood + d
        used = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([used, [-1], -2 - np.arange(s), [-2 - s]])
        values = np.concatenate([emitted[used], start[None], moves, np.full((1, s), likelihood / s)])
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), **{f"s{j}": pa.array(values[:, j]) for j in range(s)}})

    return expect


def train(tokens: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after rounds of Baum-Welch over all rows of tokens (symbols), and the log-likelihood before each."""
    some = bool(tokens.take(1))
    model, history = mixture(tokens, prior, states, HEATS if some else ()), []
    for _ in range(rounds if some else 0):
        got = _summed(tokens, _expect, model, states)
        move = np.array([got[-2 - i] for i in range(states)]) + 0.1
        start = got[-1] + 0.1
        history.append(float(got[-2 - states].sum()))
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), _emissions(got, prior, states))
    return model, history


def likelihood(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability: the scaled forward recursion over its whole length, all sequences together."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    sizes = np.array([len(rows[i]) for i in order])
    flat = np.concatenate([rows[i] for i in order]).astype(np.int64)
    begin, out = np.cumsum(sizes) - sizes, np.zeros(len(rows))
    alpha = np.tile(model.start, (len(rows), 1))
    left = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # rows that are longer than t
    for t in range(int(sizes[0])):
        k = int(left[t])
        a = (alpha[:k] if t == 0 else alpha[:k] @ model.move) * model.emit[flat[begin[:k] + t]]
        c = a.sum(axis=1)
        out[:k] += np.log10(c)
        alpha[:k] = a / c[:, None]
    result = np.empty(len(rows))
    result[order] = out
    return result


def _score(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"row": pa.array(ids, pa.int64()), "log10_p": pa.array(likelihood(held.value, rows))})

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(np.frombuffer(raw, "<u2"))
                size += len(rows[-1])
                if size >= HELD:
                    yield out()
                    ids, rows, size = [], [], 0
        if ids:
            yield out()

    return score


def corpus_counts(texts: DataFrame, symbols: int, table: int) -> tuple[Counts, DataFrame]:
    """The counts of a table of texts (text), and word, n of all words, written once."""
    counted = materialize(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    number = texts.count()
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 16)
    room, least = table, None  # whole levels of counts, from the top, as far as the table has room
    for at, n in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = at
    top = [] if least is None else counted.where(level >= least).collect()
    top = sorted(((r["n"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
    return Counts(total + number, distinct + (number > 0), number, [w for _, w in top], np.array([n for n, _ in top], np.int64), symbols), counted


def score_texts(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, symbols: int = SYMBOLS, table: int = TABLE, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row per input row.

    train_on: a boolean column; rows where it is true are learned from, all are scored over their whole texts. A text's
    tokens are its words and an end; null and empty texts are an end alone. base_score is the smoothed unigram log10
    probability, score the model's. Without training rows every token has base score 0 and the model is uniform. Rows
    with the same or a null id stay apart. Other columns are not read. No rows give no rows. At most symbols, at most
    65534, are symbols of the model, and at most table words are broadcast with their counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (~F.coalesce(train_on, F.lit(False))).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    counts, counted = corpus_counts(rows.where("NOT held_out").select("text"), symbols, table)
    fields = [T.StructField(c, T.LongType()) for c in ("row", "n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base", "rare")]
    schema = T.StructType([rows.schema["id"], rows.schema["held_out"], *fields, T.StructField("symbols", T.BinaryType()), T.StructField("beyond", T.MapType(T.BinaryType(), T.LongType()))])
    tokens = materialize(rows.mapInArrow(_tokens(spark.sparkContext.broadcast(counts)), schema), "tokens")
    k = min(symbols, len(counts.table))
    prior = np.concatenate([counts.n[:k], [max(counts.rare_tokens, 0), counts.texts]]) + ADD
    model, _ = train(tokens.where("NOT held_out").select("row", "symbols"), prior / prior.sum(), states, rounds)
    found = tokens.select("row", "symbols").mapInArrow(_score(spark.sparkContext.broadcast(model)), "row long, log10_p double")
    beyond = tokens.select("row", F.explode("beyond").alias("word", "times")).join(counted, "word", "left")
    n = F.coalesce("n", F.lit(0)) + ADD
    share = lambda total, distinct: F.col("times") * F.log10(n / F.lit(total + ADD * (distinct + 1)))
    beyond = beyond.groupBy("row").agg(
        F.sum(share(counts.tokens, counts.distinct)).alias("base_beyond"), F.sum(share(counts.rare_tokens, counts.rare_distinct)).alias("rare_beyond"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_beyond"),
    )
    out = tokens.drop("symbols", "beyond").join(found, "row").join(beyond, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + more("known_beyond")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("base_beyond")).alias("base_score"), (F.col("log10_p") + F.col("rare") + more("rare_beyond")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all whole texts of documents scored, nine tenths of them learned from."""
    docs = read(spark, sf_dir, "documents")
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return score_texts(docs, kept).withColumnRenamed("id", "doc_id")
