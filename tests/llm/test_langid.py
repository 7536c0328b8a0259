import itertools
import random

import numpy as np
import pytest

from callgrid.llm import langid


def corpus(n=240, seed=1):
    r = random.Random(seed)
    parts = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["sch", "ein", "ver", "ung"], "ru": ["по", "не", "ва", "ли"]}
    word = lambda x: "".join(r.choice(parts[x]) for _ in range(r.randint(1, 3)))
    return [(i, " ".join(word(x) for _ in range(r.randint(3, 30))), x) for i in range(n) for x in [r.choice([*parts])]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? \n", "aa"), (None, "kamori tu", None), (3, rows[3][1], rows[3][2]), (1003, "по не ва " * 20 + "verein ungschein " * 20, None)]
    df = spark.createDataFrame([(*x, "s") for x in rows + odd], "doc_id long, text string, lang string, score string")
    got = langid.predict_documents(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, []) for i in (1000, 1001, 1002))
    assert by[None].held_out is False and by[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert [s.lang for s in by[1003].spans] == ["ru", "bb"] and by[1003].spans[0].start == 0
    assert langid.predict_documents(df.limit(0)).count() == 0
    unlabelled = langid.predict_documents(df.where("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(0)
    model = langid.Model(["x", "y", "z"], np.ones((3, langid.BUCKETS + len(langid.NAMES))))
    for _ in range(20):
        sizes = r.integers(0, 6, 5)
        first = np.concatenate(([0], np.cumsum(sizes)))
        scores = r.normal(0, 8, (first[-1], 3)).astype(np.float32)
        path = model.paths(scores, first)
        for a, b in zip(first, first[1:]):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(p[i] != p[i - 1] for i in range(1, len(p)))  # noqa: E731, B023
            if b > a:
                best = max(map(value, itertools.product(range(3), repeat=b - a)))
                assert abs(value(path[a:b].tolist()) - best) < 1e-3


def test_counts_and_word_scores_equal_plain_loops():
    """Grams between word edges, counted by word; the mean over gram lengths of their log shares."""
    texts = ["Kamo kamo, ri! über", "по не kamo", "", "x"]
    words = langid.Words(texts)
    plain = [w.lower() for t in texts for w in "".join(c if c.isalpha() else " " for c in t).split()]
    assert [int(s) for s in words.size] == [len(w) for w in plain]

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9) % 2**64 >> 49

    def grams(w):
        s = [1, *map(ord, w), 2]
        return [[bucket(s[i : i + k]) for i in range(len(s) - k + 1)] for k in langid.GRAMS]

    want = np.zeros(langid.BUCKETS)
    for w in plain:
        for k in grams(w):
            np.add.at(want, k, 1)
    got = np.zeros(langid.BUCKETS)
    for b, owner in words.grams():
        np.add.at(got, b, words.count[owner])
    assert (got == want).all()
    r = np.random.default_rng(2)
    counts = np.concatenate((r.integers(0, 9, (2, langid.BUCKETS)), np.ones((2, len(langid.NAMES)))), axis=1)
    share = np.log((counts[:, : langid.BUCKETS] + langid.SMOOTH) / (counts[:, : langid.BUCKETS] + langid.SMOOTH).sum(axis=1, keepdims=True))
    found = langid.Model(["a", "b"], counts).word_scores(words)
    for i, w in enumerate(plain):
        for x in range(2):
            assert abs(found[i, x] - sum(share[x][k].sum() for k in grams(w)) / len(langid.GRAMS)) < 1e-3


def test_many_labels(spark, monkeypatch):
    rows = [(i, f"word{'abcdefgh'[i % 8] * 5} " * 20, f"l{i % 8}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, langid.predict_documents(df).collect()))
    monkeypatch.setattr(langid, "TASK_LABELS", 2)
    assert sorted(map(tuple, langid.predict_documents(df).collect())) == whole
    monkeypatch.setattr(langid, "MOST_LABELS", 7)
    with pytest.raises(ValueError):
        langid.predict_documents(df)


def test_ties_and_repeated_rows(spark):
    """Labels that were learned from the same texts tie: the first in order wins, for every row alike."""
    rows = [(i, "kamo ritu moka", x) for i in range(60) for x in ("bb", "aa")]
    got = langid.predict_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 120 and {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}
    assert len({r.held_out for r in got}) == 2 and all(len({r.held_out for r in got if r.doc_id == i}) == 1 for i in range(60))


def test_long_text(spark):
    df = spark.createDataFrame([*corpus(60), (500, "kamo ritu " * 150_000, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r for r in langid.predict_documents(df).collect()}[500].lang_pred == "aa"
