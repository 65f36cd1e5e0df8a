"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes, one from each side, and label every position; the mean of the
positions' probabilities is the document's. Texts are cut into windows of nearly equal length, where the state begins
at zero, so that documents of any length cost their bytes and no result depends on what else is in a batch. The network
is trained in numpy by backpropagation through time on windows of labelled texts, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import REST, prepare, read, rest

UNKNOWN = "und"
HIDDEN = 16
WINDOW = 128  # bytes
ROWS = 1024  # windows that a worker runs at a time, if the languages are few
CELLS = 1 << 24  # position scores that a worker holds at a time (64 MB): windows x bytes x languages
PER_LANG = 600  # labelled texts a language, about; the bound of the sample that trains
SAMPLE = 1 << 18  # labelled texts that train, about, whatever the number of languages (32 MB)
LANGS = 1 << 14  # more languages than that are refused, not forgotten
_LETTER = regex.compile(r"\p{L}")


class Network:
    """Weights: for each direction e_zr, e_n (by byte), u_zr, u_n (by state) and w (to the labels), then b."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng, n, h = np.random.default_rng(seed), len(langs), hidden
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0] if s[0] != 256 else h), s).astype(np.float32)
        self.langs, self.hidden = langs, h
        self.w: dict[str, np.ndarray] = {"b": np.zeros(n, np.float32)}
        for d in "fb":
            self.w |= {f"{d}e_zr": draw(256, 2 * h), f"{d}e_n": draw(256, h), f"{d}u_zr": draw(h, 2 * h), f"{d}u_n": draw(h, h), f"{d}w": draw(h, n)}

    def label(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed probabilities and position labels of each window, by language.

        x: bytes, a row per window, in descending order of sizes; what lies beyond a window's size is never read. A step
        writes into arrays that all steps share, and languages are rows there, so that no sum runs along a short axis.
        """
        rows, wide = x.shape
        active = np.array([int((sizes > t).sum()) for t in range(wide)])
        w, h, n, half = self.w, self.hidden, len(self.langs), np.float32(0.5)
        out = np.empty((wide, n, rows), np.float32)
        total, votes = np.zeros((n, rows)), np.zeros((n, rows), np.int64)
        x = np.ascontiguousarray(x.T).astype(np.intp)
        gates, more, fresh, held = (np.empty((rows, k * h), np.float32) for k in (2, 2, 1, 1))
        for d, order in (("f", range(wide)), ("b", range(wide - 1, -1, -1))):
            e_zr, e_n, u_zr, u_n, v = w[f"{d}e_zr"] / 2, w[f"{d}e_n"], w[f"{d}u_zr"] / 2, w[f"{d}u_n"] / 2, np.ascontiguousarray(w[f"{d}w"].T)
            state = np.zeros((rows, h), np.float32)
            for t in order:
                k = active[t]
                s, b, zr, new, un = state[:k], x[t, :k], gates[:k], fresh[:k], held[:k]
                np.take(e_zr, b, axis=0, out=zr, mode="clip")
                zr += np.matmul(s, u_zr, out=more[:k])
                np.tanh(zr, out=zr)  # the gates are (1 + zr) / 2
                np.take(e_n, b, axis=0, out=new, mode="clip")
                new += np.matmul(s, u_n, out=un)
                un *= zr[:, h:]
                new += un
                np.tanh(new, out=new)
                new -= s
                new *= half
                s += new
                new *= zr[:, :h]
                s -= new
                if d == "f":
                    np.matmul(v, s.T, out=out[t, :, :k])
                else:
                    p = v @ s.T
                    p += out[t, :, :k]
                    p += w["b"][:, None]
                    p -= p.max(axis=0)
                    votes[:, :k] += p == 0
                    np.exp(p, out=p)
                    p /= p.sum(axis=0)
                    total[:, :k] += p
        return total.T, votes.T

    def loss(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy of all positions and its gradients, by backpropagation through time."""
        w, h = self.w, self.hidden
        rows, wide = x.shape
        x = np.ascontiguousarray(x.T)
        there = (np.arange(wide)[:, None] < sizes[None, :]).astype(np.float32)
        kept: dict[str, list] = {"f": [None] * wide, "b": [None] * wide}
        logits = np.tile(w["b"], (wide, rows, 1))
        for d, order in (("f", range(wide)), ("b", range(wide - 1, -1, -1))):
            state = np.zeros((rows, h), np.float32)
            for t in order:
                zr = np.tanh((w[f"{d}e_zr"][x[t]] + state @ w[f"{d}u_zr"]) / 2) / 2 + np.float32(0.5)
                un = state @ w[f"{d}u_n"]
                new = np.tanh(w[f"{d}e_n"][x[t]] + zr[:, h:] * un)
                after = np.where(there[t][:, None] > 0, state + (new - state) * (1 - zr[:, :h]), state)
                kept[d][t] = (state, zr, un, new, after)
                logits[t] += after @ w[f"{d}w"]
                state = after
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        scale = there / max(there.sum(), 1)
        value = float(-(np.log(np.maximum(p[:, np.arange(rows), y], 1e-12)) * scale).sum())
        p[:, np.arange(rows), y] -= 1
        p *= scale[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["b"] = p.sum(axis=(0, 1))
        for d, order in (("f", range(wide - 1, -1, -1)), ("b", range(wide))):
            back = np.zeros((rows, h), np.float32)
            a_zr, a_n = np.empty((wide, rows, 2 * h), np.float32), np.empty((wide, rows, h), np.float32)
            for t in order:
                state, zr, un, new, after = kept[d][t]
                grad[f"{d}w"] += after.T @ p[t]
                on = there[t][:, None]
                g = back + p[t] @ w[f"{d}w"].T
                gn = g * (1 - zr[:, :h]) * (1 - new * new) * on
                gz = g * (state - new) * on
                gr = gn * un
                own = np.concatenate([gz, gr], axis=1) * zr * (1 - zr)
                gu = gn * zr[:, h:]
                grad[f"{d}u_zr"] += state.T @ own
                grad[f"{d}u_n"] += state.T @ gu
                a_zr[t], a_n[t] = own, gn
                back = g * np.where(on > 0, zr[:, :h], 1) + own @ w[f"{d}u_zr"].T + gu @ w[f"{d}u_n"].T
            flat = x.ravel()
            np.add.at(grad[f"{d}e_zr"], flat, a_zr.reshape(-1, 2 * h))
            np.add.at(grad[f"{d}e_n"], flat, a_n.reshape(-1, h))
        return value, grad

    def train(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 200, batch: int = 128, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam over shuffled batches, in about so many steps; the mean loss of each epoch."""
        rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        epochs = max(1, round(steps / max(1, len(x) // batch)))
        for epoch in range(epochs):
            own = []
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                value, grad = self.loss(x[at], sizes[at], y[at])
                own.append(value)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1, 1 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    now = rate * (1 - epoch / epochs)
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(own)))
        return losses


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, and each window's start, size and text; windows of a text differ by at most a byte in size."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(texts)), parts)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    n, k = sizes[doc], parts[doc]
    begin = n * i // np.maximum(k, 1)
    start = (np.cumsum(sizes) - sizes)[doc] + begin
    return np.frombuffer(b"".join(texts), np.uint8), start, n * (i + 1) // np.maximum(k, 1) - begin, doc


def label_texts(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The mean probabilities and the position labels of each text, by language."""
    flat, start, size, doc = windows(texts)
    order = np.argsort(-size, kind="stable")
    total, votes = np.zeros((len(texts), len(network.langs))), np.zeros((len(texts), len(network.langs)), np.int64)
    rows = max(1, min(ROWS, CELLS // (WINDOW * len(network.langs))))
    for a in range(0, len(order), rows):
        at = order[a : a + rows]
        wide = int(size[at[0]])
        x = flat[np.minimum(start[at][:, None] + np.arange(wide)[None, :], len(flat) - 1)]
        p, n = network.label(x, size[at])
        np.add.at(total, doc[at], p)
        np.add.at(votes, doc[at], n)
    return total / np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)[:, None], votes


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, hidden: int = HIDDEN) -> Network | None:
    """A network trained on windows of about per_lang texts of each language, chosen by a hash of the id; None without any.

    Where the languages are many, so few of each that they are about SAMPLE in all, and one at least. Every language with a labelled text is learned; a table with more than LANGS is refused. Labels count in the training
    and nothing else does.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text RLIKE '\\\\p{L}' AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(LANGS + 1).collect()
    if not counts:
        return None
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    shares = labelled.sparkSession.createDataFrame([(r["lang"], max(1, min(per_lang, SAMPLE // len(counts))) / r["count"]) for r in counts], "lang string, share double")
    at = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    found = sorted(drawn.select("lang", F.substring("text", at, F.lit(WINDOW)).alias("t")).collect())
    if not found:
        return None
    network = Network(sorted({r["lang"] for r in found}), hidden)
    raw = [r["t"].encode("utf-8", "surrogatepass")[:WINDOW] for r in found]
    x = np.array([np.frombuffer(t.ljust(WINDOW, b"\0"), np.uint8) for t in raw])
    batch = max(1, min(128, CELLS // (4 * WINDOW * len(network.langs))))
    network.train(x, np.array([len(t) for t in raw]), np.searchsorted(network.langs, [r["lang"] for r in found]), batch=batch)
    return network


def _identify(held):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lettered = [bool(t and _LETTER.search(t)) for t in texts]
            some = [i for i, x in enumerate(lettered) if x] if network else []
            langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if some:
                p, votes = label_texts(network, [texts[i].encode("utf-8", "surrogatepass") for i in some])
                best = p.argmax(axis=1)
                for i, k, row, n in zip(some, best.tolist(), p, votes, strict=True):
                    langs[i], scores[i], shares[i] = network.langs[k], min(1.0, float(row[k])), float(n[k] / max(n.sum(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores, pa.float64()), pa.array(shares, pa.float64()), pa.array(lettered, pa.bool_()), batch.column(2)], names=["id", "text", "lang_pred", "score", "position_share", "lettered", REST])

    return identify


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, lang_pred, score (its pooled probability), position_share (of positions labelled so), lettered (whether
    the text has a letter) and the other columns as the struct _rest, a row per input row.

    Only whole texts are read. A text that is null or has no letter is "und" with score 0, and so is every text without
    a network. Null and repeated ids pass through; equal texts get equal results; ties go to the first language in
    order. No rows give no rows. The weights are broadcast: about 40 kB, more by 32 numbers a language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), rest(docs, id_col, text_col))
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("position_share", T.DoubleType()), T.StructField("lettered", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields[:2], *extra, rows.schema[REST]])
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(network)), schema)


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of the id as text leaves 1 by 3, or there is no id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out("doc_id")), "doc_id", "text", "lang"))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "position_share")
