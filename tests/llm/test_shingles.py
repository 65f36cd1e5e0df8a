"""Near copies of the pipeline against the exact similarity of all pairs."""

import random

import numpy as np

from tessel.llm import shingles, simhash


def _plain(text, words=5):
    own = (text or "").lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _planted():
    """Texts of 300 words and copies with more and more words changed; ids ascend."""
    rng, out = random.Random(4), []
    word = lambda: f"w{rng.randrange(5000)}"
    for _ in range(40):
        base = [word() for _ in range(300)]
        out.append(base)
        for changed in (1, 3, 5, 6, 7, 9, 20):
            copy = list(base)
            for i in rng.sample(range(300), changed):
                copy[i] = word()
            out.append(copy)
    texts = [" ".join(t) for t in out]
    return [*texts, "", "too few words", "Too  few WORDS", "too few other words", None]


def _groups(texts):
    sets, group = [_plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if _like(sets[i], sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return dict(enumerate(group))


def test_groups_are_exact(spark, monkeypatch):
    texts = _planted()
    want = _groups(texts)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    for block in (1024, 3):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(simhash, "BLOCK", block)
        out = simhash.near_copy_groups(docs).collect()
        assert len(out) == len(texts)
        assert {r["id"]: r["component_id"] for r in out} == want


def test_rows_with_the_same_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " end"), (3, a + " end"), (4, c)], "doc_id long, text string")
    assert sorted((r["id"], r["component_id"]) for r in simhash.near_copy_groups(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_pairs():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(n)] for n in (20, 30))
    rows, cols = shingles.near_pairs(a, b, 0.3)
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if _like(set(x.tolist()), set(y.tolist())) >= 0.3}


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    texts = _planted()
    want = _groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(want.values())
