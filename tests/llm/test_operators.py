"""The corpus operators against plain versions, round trips and held-out accuracy, on the smallest tables."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tessel.llm import bpe, embeddings, hmm, langid, packing, pii, queries, simhash, topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)


def test_language_id(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.98


def test_network_gradient():
    net = langid.Network(["a", "b", "c"], 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, sizes, y = rng.integers(0, 256, (5, 9)).astype(np.uint8), np.array([9, 9, 7, 4, 1]), np.array([0, 1, 2, 0, 1])
    _, grad = net.loss(x, sizes, y)
    for k, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        at = (int(x[0, 0]), at[1]) if "e_" in k else at
        old, step = w[at], 1e-5
        w[at] = old + step
        up = net.loss(x, sizes, y)[0]
        w[at] = old - step
        down = net.loss(x, sizes, y)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - grad[k][at]) < 1e-5


def test_network_rows_are_independent():
    net, rng = langid.Network(["a", "b"]), random.Random(3)
    own = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 5, 127, 128, 129, 700, 2000)]
    together = langid.label_texts(net, own)[0]
    alone = np.concatenate([langid.label_texts(net, [t])[0] for t in own])
    assert np.allclose(together, alone, atol=1e-5)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    out = queries.QUERIES["op2_packing"](spark, SF).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        docs[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [(p, len(ids[d])) for d, p in docs.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= packing.WINDOW
    assert set(docs) == set(ids) and len(sequences) <= -(-sum(map(len, ids.values())) // packing.WINDOW) + 4


def test_packing_solution():
    rng = np.random.default_rng(1)
    rows = packing.strategies(np.arange(1, 33), 32)
    assert all(r.sum() == 32 for r in rows) and len({tuple(r) for r in rows}) == len(rows)
    x = np.where(rng.random(len(rows)) < 0.2, rng.integers(0, 50, len(rows)), 0)
    histogram = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=33)
    histogram[0] = 0
    found = packing.solve(rows, histogram, 3000)
    again = np.bincount(rows.ravel(), weights=np.repeat(found, 3), minlength=33)
    assert (found >= 0).all() and np.abs(again[1:] - histogram[1:]).max() < 0.02 * histogram.max()


def test_bpe_against_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    for r in queries.QUERIES["op3_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_fuzz():
    from tokenizers import Tokenizer

    path, rng = bpe.tokenizer_path(), random.Random(5)
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    added = library.get_added_tokens_decoder()  # matched before any merge, so that merges needn't give them
    assert all(own.merge(t) == (i,) for i, t in enumerate(own.tokens) if i not in added)
    assert [packing.token_ids(t.content, path) for t in added.values()] == [[i] for i in added]
    signs = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0aAzéèßñ'sSt019²½٣中文  　​🎉👨‍👩‍👧_-.,!ǅªⅧ﻿­\x00"
    some = ["<|endoftext|>", "'re", "'ll", "  ", "\n\n", " the"]
    cases = ["".join(rng.choice(signs) if rng.random() < 0.8 else rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    cases += ["a" * 5000, " " * 3000 + "x", "ab" * 4000, "é" * 3000]
    lexicon = bpe.compile_lexicon([b"a", b" the", b"ab", b"abab", " é".encode()], path)
    encoder = bpe.Encoder(own, bpe.Automaton(bpe.map_arrays(lexicon)))
    ids, ends = encoder.encode(cases)
    for text, a, b, want in zip(cases, ends, ends[1:], library.encode_batch(cases, add_special_tokens=False), strict=False):
        assert ids[a:b].tolist() == want.ids, text
    assert all(packing.token_ids(t, path) == library.encode(t, add_special_tokens=False).ids for t in cases[:1000])


def test_automaton_is_minimal():
    words = {w: (i,) for i, w in enumerate([b"tap", b"taps", b"top", b"tops", b"stop", b"stops"])}
    arrays = bpe.Automaton.build(words)
    a = bpe.Automaton(bpe.map_arrays(bpe.pack_arrays(arrays)))
    assert len(arrays["final"]) == 7  # the root, after t, s and st, before p, after p and after s: suffixes are shared
    order = sorted(words)
    assert [order[e] if e >= 0 else None for e in a.entries([*words, b"sto", b"", b"stopx"]).tolist()] == [*words, None, None, None]


def test_top_k_reading():
    rng = np.random.default_rng(2)
    rows = rng.integers(-90, 90, (700, 16))
    lists = topk.Lists(rows)
    for q in rows[:20]:
        score = rows @ q
        best = set(np.lexsort((np.arange(700), -score))[:6].tolist())
        for least in (-np.inf, float(np.sort(score)[-6])):
            assert best <= set(topk.nra(q.astype(float), lists, 6, least)[0].tolist())


def test_hmm_counts_and_likelihood(spark, texts):
    out = queries.QUERIES["op6_hmm_score"](spark, SF).collect()
    own = {d: t.encode().lower().split() for d, t in texts.items()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    c = Counter(w for d, ws in own.items() if d not in held for w in ws)
    total, distinct, ends = sum(c.values()) + len(texts) - len(held), len(c) + 1, len(texts) - len(held)
    base = lambda n: math.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
    for r in out:
        ws = own[r["doc_id"]]
        assert r["n_tokens"] == len(ws) + 1 and r["train_tokens"] == total and r["held_out"] == (r["doc_id"] in held)
        assert r["n_known"] == sum(c[w] > 0 for w in ws) + 1
        assert math.isclose(r["base_score"], sum(base(c[w]) for w in ws) + base(ends), rel_tol=1e-9)


def test_hmm_recursions():
    """Against sums over all state paths."""
    from itertools import product

    rng = np.random.default_rng(4)
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    rows = [np.array([0, 4, 2, 2]), np.array([1]), np.array([3, 3, 0])]
    start, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    logs = []
    for r in rows:
        paths = {p: m.start[p[0]] * m.emit[r[0], p[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], r[1:], strict=False)) for p in product(range(3), repeat=len(r))}
        total = sum(paths.values())
        logs.append(math.log10(total))
        for p, w in paths.items():
            start[p[0]] += w / total
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w / total
            for o, a in zip(r, p, strict=True):
                emitted[o, a] += w / total
    assert np.allclose(hmm.likelihood(m, rows), logs)
    a, b, c, d = hmm.expected(m, rows)
    assert np.allclose(a, start) and np.allclose(b, moves) and np.allclose(c, emitted) and math.isclose(d, sum(logs) * math.log(10))


def test_baum_welch_climbs(spark, texts):
    words = sorted({w for t in texts.values() for w in hmm.words(t)})
    at = {w: i for i, w in enumerate(words)}
    rows = [(i, np.array([*(at[w] for w in hmm.words(t)), len(words)], "<u2").tobytes()) for i, t in texts.items()]
    prior = np.full(len(words) + 1, 1 / (len(words) + 1))
    _, history = hmm.train(spark.createDataFrame(rows, "row long, symbols binary"), prior, 4, 4)
    assert history == sorted(history)


def test_simhash(spark, texts):
    def plain(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {d: plain(t) for d, t in texts.items()}
    group = dict.fromkeys(prints)
    for d in sorted(prints):
        if group[d] is None:
            todo, group[d] = [d], d
            while todo:
                x = todo.pop()
                for y in prints:
                    if group[y] is None and (prints[x] ^ prints[y]).bit_count() <= 3:
                        group[y] = d
                        todo.append(y)
    out = queries.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()
    assert {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in out} == {(d, prints[d], group[d]) for d in prints}


def test_simhash_links_at_the_radius(spark):
    rng = random.Random(9)
    rows, node = [], 0
    for _ in range(40):
        x = rng.getrandbits(64)
        for flips in (0, 3, 4):
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            rows.append((y - (1 << 64) if y >> 63 else y, node))
            node += 1
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long")).collect()
    assert {(r["u"], r["v"]) for r in links} >= {(3 * i + 1, 3 * i) for i in range(40)}
    assert not any(r["u"] % 3 == 2 and r["v"] == r["u"] - 2 for r in links)


def test_multi_sequence_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(8), rng.random(8)
    cells = list(embeddings.multi_sequence(a, b, 0.7))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(8) for j in range(8) if a[i] + b[j] <= 0.7}


def _feistel_pair(key, kind, left, right, ml, mr):
    h = lambda k, x: int(hashlib.sha256(f"{key}|{kind}|{k}|{x}".encode()).hexdigest()[:14], 16)
    for k in range(1, pii.ROUNDS + 1):
        left, right = ((left + h(k, right)) % ml, right) if k % 2 else (left, (right + h(k, left)) % mr)
    return left, right


def test_pii_against_plain(spark):
    day = datetime.date(1984, 2, 29)
    n = (day - datetime.date(1600, 1, 1)).days
    a, b = _feistel_pair("key", "date", n % 146097 // 773, n % 146097 % 773, 189, 773)
    date = datetime.date(1600, 1, 1) + datetime.timedelta(days=n - n % 146097 + a * 773 + b)
    a, b = _feistel_pair("key", "ip", 42 * 256 + 144, 35 * 256 + 254, 65536, 65536)
    ip = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    cases = {
        "on 1984-02-29, at 42.144.35.254.": f"on {date}, at {ip}.",
        "1983-02-29 999.1.1.1 1.2.3 4041894974608796 000-12-3456 2.0. GB83WEST12345698765432": None,
    }
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), "key").orderBy("id").collect()
    for r, (text, want) in zip(out, cases.items(), strict=True):
        assert r["safe_text"] == (text if want is None else want)


def test_pii_keeps_formats_and_is_one_to_one(spark):
    rng = random.Random(6)

    def card():
        d = [4, *(rng.randrange(10) for _ in range(14))]
        s = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        return "".join(map(str, d)) + str(-s % 10)

    kinds = {
        "card": card, "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "phone": lambda: f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04d}",
        "ssn": lambda: f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}", "email": lambda: f"ab{rng.randrange(10**6)}.x@mail{rng.randrange(9)}.example.com",
        "date": lambda: str(datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(60000))),
    }
    rows = [(i, k, f()) for i, (k, f) in enumerate((k, f) for k, f in kinds.items() for _ in range(120))]
    frame = spark.createDataFrame([(i, f"so {v} and {v}.") for i, _, v in rows], "doc_id long, text string")
    once = {r["id"]: r for r in pii.pseudonymize(frame, "key").collect()}
    maps = defaultdict(dict)
    for i, k, v in rows:
        found = once[i]["found"]
        assert [f["kind"] for f in found] == [k, k] and found[0]["pseudonym"] == found[1]["pseudonym"] != v
        assert once[i]["safe_text"] == f"so {found[0]['pseudonym']} and {found[0]['pseudonym']}."
        assert re.sub("[0-9]+" if k == "ip" else "[0-9]", "9", re.sub("[a-z]", "a", v)) == re.sub("[0-9]+" if k == "ip" else "[0-9]", "9", re.sub("[a-z]", "a", found[0]["pseudonym"]))
        maps[k][v] = found[0]["pseudonym"]
    assert all(len(set(m.values())) == len(m) for m in maps.values())
    again = spark.createDataFrame([(i, once[i]["safe_text"]) for i in once], "doc_id long, text string")
    assert all(len(r["found"]) == 2 for r in pii.pseudonymize(again, "key").collect())  # pseudonyms are valid values themselves


def test_pipeline(spark, texts):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in out}
    assert kept <= set(texts) and len(kept) > 0.8 * len({t for t in texts.values() if t})
    assert not any(re.search(r"\w", texts[d]) is None for d in kept)
