"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The most frequent words of the corpus are compiled with their ids into a minimal acyclic automaton whose arcs carry
numbers; their sum along a word is its entry in the table of ids, so equal suffixes are shared whatever they encode.
Workers memory-map the compiled file. Words outside it are merged exactly, pair by pair in the order of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import prepare, read

# The word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same words where all characters are ASCII (but for the separators 1C to 1F) or Latin letters; this engine is faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = " \\t\\n\\x0b\\x0c\\r"
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
_FULL = regex.compile(PATTERN)

_SEPARATORS = "\x1c\x1d\x1e\x1f"
_GAP = re.compile(r" (?!\S)")

LEXICON = 1 << 17  # words of the automaton
LONGEST = 64  # bytes of a word in it
_NONE = 1 << 40
HELD = 1 << 18  # words that a task counts or remembers at a time


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in a process."""
    return Vocabulary(path)


class Vocabulary:
    """Token bytes, merge order and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_chars()
        raw = {token: bytes(of[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.tokens[i] = raw[token]
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = special
        self.single = [ids[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        keys = np.array([a << 20 | b for a, b in self.merges] or [-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()] or [0], np.int64)[order]
        self.bytes_ = np.array(self.single, np.int64)
        self.made = np.array([m for _, m in self.merges.values()] or [0], np.int64)
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word: the pair of lowest rank merges first, the leftmost of equal ones, until none is left."""
        parts = [self.single[b] for b in word]
        if len(parts) > 48:
            return self._merge_long(parts)
        of, none = self.merges.get, (1 << 30, 0)
        found = [of(p, none) for p in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best[0] == 1 << 30:
                break
            i = found.index(best)
            parts[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = of((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = of((parts[i], parts[i + 1]), none)
        return tuple(parts)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merge() of each word as (ids, start, size): one merge a round in all words together, over arrays."""
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, used = [], 0

        def add(at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal used
            start[at], size[at] = used + np.cumsum(sizes) - sizes, sizes
            parts.append(ids)
            used += len(ids)

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero((lengths < 2) | (lengths > 32)).tolist():
            ids = np.array(self.merge(words[i]), np.int64)
            add(np.array([i]), ids, np.array([len(ids)]))
        short = np.flatnonzero((lengths >= 2) & (lengths <= 32))
        short = short[np.argsort(lengths[short], kind="stable")]
        for at in np.array_split(short, len(short) // 8192 + 1):
            if not len(at):
                continue
            wide = int(lengths[at].max())
            ids = np.full((len(at), wide + 1), -1, np.int64)
            ids[np.arange(wide + 1) < lengths[at][:, None]] = self.bytes_[np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8)]
            ranks, cols = self._ranks(ids[:, :-1], ids[:, 1:]), np.arange(wide + 1)
            while len(at):
                i = ranks.argmin(axis=1)
                rows = np.arange(len(at))
                best = ranks[rows, i]
                done = best == _NONE
                if done.any():
                    there = ids[done] >= 0
                    add(at[done], ids[done][there], there.sum(axis=1))
                    go = ~done
                    at, ids, ranks, i, best = at[go], ids[go], ranks[go], i[go], best[go]
                    if not len(at):
                        break
                    rows = np.arange(len(at))
                ids[rows, i] = self.made[best]
                source = np.minimum(cols + (cols > i[:, None]), wide)
                ids = np.take_along_axis(ids, source, axis=1)
                ids[:, -1] = -1
                ranks = np.take_along_axis(ranks, source[:, :-1].clip(max=wide - 1), axis=1)
                ranks[:, -1] = _NONE
                ranks[rows, i] = self._ranks(ids[rows, i], ids[rows, i + 1])
                before = np.maximum(i - 1, 0)
                ranks[rows, before] = np.where(i > 0, self._ranks(ids[rows, before], ids[rows, before + 1]), ranks[rows, before])
        return np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int32), start, size

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it doesn't merge."""
        key = a << 20 | b & 0xFFFFF
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == key) & (b >= 0), self.pair_ranks[found], _NONE)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same in n log n steps: a heap of pairs over a linked list."""
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = new, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else n
                if x >= 0 and y < n and (m := self.merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y], m[1]))
        return tuple(p for p in parts if p >= 0)

    def words(self, text: str) -> Iterable[str | int]:
        """The words of a text in order, a special token's string as its id."""
        if self.cut is None or not any(x in text for x in self.special):
            return split_words(text)
        return [x for i, part in enumerate(self.cut.split(text)) for x in ([self.special[part]] if i % 2 else split_words(part))]


def split_words(text: str) -> list[str]:
    plain = not any(x in text for x in _SEPARATORS) if text.isascii() else not _OTHER.search(text)
    return (_PLAIN if plain else _FULL).findall(text)


def pieces(text: str, special: Iterable[str]) -> list[str] | None:
    """The text cut before its spaces, or None where a word may cross such a cut: where white space or the end follows a
    space, or a special token's string occurs. Each piece but the first stands for itself with a space before it."""
    if _GAP.search(text) or any(x in text for x in special):
        return None
    return text.split(" ")


class Automaton:
    """A minimal acyclic automaton of words with numbered arcs, in flat arrays that can be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.target, self.add, self.final, self.start, self.ids, self.root = (arrays[k] for k in ("keys", "target", "add", "final", "start", "ids", "root"))

    @staticmethod
    def build(words: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
        """Add the words in order and replace each finished state by an equal one already there (Daciuk et al., 2000)."""
        order = sorted(words)
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, state), ...))
        open_: list[list] = [[False, []]]
        last = b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                key = (final, tuple(arcs))
                if key not in known:
                    known[key] = len(states)
                    states.append(key)
                open_[-1][1][-1] = (open_[-1][1][-1][0], known[key])

        for w in order:
            same = next((i for i, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
            close(same)
            for b in w[same:]:
                open_[-1][1].append((b, -1))
                open_.append([False, []])
            open_[-1][0] = True
            last = w
        close(0)
        root = len(states)
        states.append((open_[0][0], tuple(open_[0][1])))
        below = [0] * len(states)  # words from a state on; states come after those that they lead to
        keys, target, add = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for label, to in arcs:
                keys.append(s << 8 | label)
                target.append(to)
                add.append(n)
                n += below[to]
            below[s] = n
        ids = [words[w] for w in order]
        return {
            "keys": np.array(keys, np.int64), "target": np.array(target, np.int32), "add": np.array(add, np.int32), "final": np.array([f for f, _ in states], np.uint8),
            "start": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array(list(chain.from_iterable(ids)), np.int32), "root": np.array([root], np.int32),
        }

    def entries(self, words: list[bytes]) -> np.ndarray:
        """The entry of each word, -1 where it isn't in the automaton; all words advance a byte at a time together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-np.where(sizes > LONGEST, 0, sizes), kind="stable")
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        live = order[: int(((sizes > 0) & (sizes <= LONGEST)).sum())]
        state, total = np.full(len(live), int(self.root[0]), np.int64), np.zeros(len(live), np.int64)
        for i in range(LONGEST + 1):
            done = sizes[live] == i
            if done.any():
                hit = done & (self.final[state] == 1)
                out[live[hit]] = total[hit]
                live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
            key = state << 8 | flat[begin[live] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, total = live[ok], at[ok], total[ok]
            state, total = self.target[at].astype(np.int64), total + self.add[at]
        return out


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values())
    return len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8) + body


def map_arrays(packed: bytes) -> dict[str, np.ndarray]:
    """Write the compiled file beside the worker, memory-map it and unlink it; the map lives as long as the arrays."""
    with tempfile.TemporaryFile() as f:
        f.write(packed)
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(view[:8], "little")
    at, out = 8 + size + -size % 8, {}
    for name, (kind, n) in json.loads(view[8 : 8 + size]).items():
        out[name] = np.frombuffer(view, kind, n, at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of size places each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Ids of texts, word by word: remembered ones first, then the automaton's, then exact merges.

    Remembered words have a slot each in flat arrays of ids, so that a batch's ids are one gather.
    """

    def __init__(self, words: Vocabulary, automaton: Automaton):
        self.vocabulary, self.automaton = words, automaton
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str | int, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, new: list[str | int]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in new]
        a, start, size = self.automaton, np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        found = a.entries(raw)
        known, special = np.flatnonzero(found >= 0), np.array([i for i, w in enumerate(new) if isinstance(w, int)], np.int64)
        unseen = np.setdiff1d(np.flatnonzero(found < 0), special)
        merged, at, n = self.vocabulary.merge_many([raw[i] for i in unseen.tolist()])
        ids = [self.ids, merged]
        start[unseen], size[unseen] = at + len(self.ids), n
        begin = a.start[found[known]].astype(np.int64)
        n = a.start[found[known] + 1] - begin
        start[known], size[known] = sum(map(len, ids)) + np.cumsum(n) - n, n
        ids.append(a.ids[_spread(begin, n)])
        start[special], size[special] = sum(map(len, ids)) + np.arange(len(special)), 1
        ids.append(np.array([new[i] for i in special.tolist()], np.int32))
        self.slots.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.ids, self.start, self.size = np.concatenate(ids), np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end (from 0 on)."""
        if len(self.slots) > HELD:
            self._forget()
        split = [self.vocabulary.words(t or "") for t in texts]
        words = list(chain.from_iterable(split))
        self._learn([w for w in dict.fromkeys(words) if w not in self.slots])
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        sizes = self.size[slots]
        ids = self.ids[_spread(self.start[slots], sizes)]
        ends = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]


def _count(path: str, kept: int):
    """Words of a task with their counts. Beyond HELD entries the smallest counts are subtracted (Misra and Gries), so
    what makes more than one in HELD / 2 of the task's pieces is always kept, in bounded memory."""

    def trim(seen: Counter) -> Counter:
        if len(seen) <= HELD:
            return seen
        least = np.partition(np.fromiter(seen.values(), np.int64, len(seen)), -HELD // 2)[-HELD // 2]
        return Counter({w: c - least for w, c in seen.items() if c > least})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, later = vocabulary(path), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cut = pieces(text or "", own.special)
                later.update(cut[1:] if cut else ())
                seen.update(split_words(cut[0]) if cut else own.words(text or ""))
            seen, later = trim(seen), trim(later)
        for piece, n in later.items():
            for w in split_words(" " + piece):
                seen[w] += n
        top = [(w.encode("utf-8", "surrogatepass"), c) for w, c in seen.most_common(kept) if isinstance(w, str)]
        if top:
            yield pa.record_batch({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([c for _, c in top], pa.int64())})

    return count


def frequent_words(docs: DataFrame, text: str, path: str, size: int = LEXICON) -> list[bytes]:
    """The most frequent words over all texts, by the tasks' summed summaries; at most size words of at most LONGEST bytes."""
    summed = docs.select(text).mapInArrow(_count(path, size // 2), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r[0]) for r in summed.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(size).select("word").collect()]


def compile_lexicon(words: list[bytes], path: str) -> bytes:
    ids, start, size = vocabulary(path).merge_many(words)
    return pack_arrays(Automaton.build({w: tuple(ids[a : a + n].tolist()) for w, a, n in zip(words, start.tolist(), size.tolist(), strict=True)}))


def _encode(path: str, lexicon):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary(path), Automaton(map_arrays(lexicon.value)))
        for batch in batches:
            ids, ends = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            ids, ends, there = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_pylist(), batch.column(1).is_valid().to_pylist()
            texts = [b"".join(map(token, ids[a:b].tolist())).decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], there, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return decode


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, words: int = LEXICON) -> DataFrame:
    """id, ids: the token ids of every whole text, a row per input row; other columns are not read.

    The ids are those of the vocabulary's own encoder without added special tokens; a special token's string in a text
    is that token. Null and empty texts have no ids. Null and repeated ids pass through. No rows give no rows. The
    lexicon is bounded by words entries of at most LONGEST bytes, about 5 MB; it speeds encoding up and changes no id.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_path()
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lexicon = spark.sparkContext.broadcast(compile_lexicon(frequent_words(docs, "text", path, words), path))
    schema = T.StructType([docs.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(path, lexicon), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """id, ids, decoded: the text of each row's ids, special tokens as their strings, invalid UTF-8 as U+FFFD; null ids give null."""
    schema = T.StructType([encoded.schema["id"], encoded.schema["ids"], T.StructField("decoded", T.StringType())])
    return encoded.select("id", "ids").mapInArrow(_decode(path or tokenizer_path()), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of documents encoded and decoded again."""
    out = decode(encode(read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"),
    )
