import random
from collections import Counter

import numpy as np

from callgrid.llm import lmscore as lm


def corpus(n=150, seed=3):
    """Sentences of a cyclic grammar, and as many with the words shuffled."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        a = r.randrange(12)
        out.append((i, " ".join(words[(a + k) % 12] for k in range(r.randint(20, 200)))))
    return out


def test_order_is_learned(spark):
    rows = corpus()
    r = random.Random(1)
    shuffled = []
    for i, t in rows[:40]:
        w = t.split()
        r.shuffle(w)
        shuffled.append((1000 + i, " ".join(w)))
    odd = [(None, "w1 w2"), (5000, None), (5001, " \n"), (7, rows[7][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows + shuffled + odd], "doc_id long, text string, log_prob int")
    got = lm.score_documents(df).collect()
    assert len(got) == len(rows) + len(shuffled) + len(odd)
    by = {x.doc_id: x for x in got}
    mean = lambda ids: np.mean([by[i].mean_log_prob for i in ids])
    assert mean(range(40)) > mean(range(1000, 1040)) + 0.5
    assert (by[5000].n_tokens, by[5000].log_prob, by[5000].mean_log_prob) == (0, 0.0, None) == (by[5001].n_tokens, by[5001].log_prob, by[5001].mean_log_prob)
    assert by[None].n_tokens == 2 and all(x.log_prob <= 0 for x in got)
    assert np.ptp([x.log_prob for x in got if x.doc_id == 7]) < 1e-4
    assert lm.score_documents(df.limit(0)).count() == 0


def test_windows_and_scores_equal_plain_loops():
    r = np.random.default_rng(0)
    sizes = [0, 1, 3, 7]
    first = np.cumsum([0, *sizes])
    tokens = r.integers(0, lm.EDGE, first[-1])
    around = lm.windows(tokens, first)
    w = lm.start_weights()
    for a, b in zip(first, first[1:], strict=False):
        for i in range(a, b):
            want = [tokens[i + d] if a <= i + d < b else lm.EDGE for d in (-2, -1, 1, 2)]
            assert around[:, i].tolist() == want
            h = np.tanh(sum(w[0][k][c] for k, c in enumerate(want)) + w[1])
            z = h @ w[2] + w[3]
            p = z - np.log(np.exp(z).sum())
            assert abs(lm.log_probs(w, around[:, i : i + 1], tokens[i : i + 1])[0] - p[tokens[i]]) < 1e-4


def test_gradient_lowers_the_loss():
    r = np.random.default_rng(1)
    tokens = np.tile(np.arange(20), 100)
    around = lm.windows(tokens, np.array([0, len(tokens)]))
    t = lm.Trainer()
    before = lm.log_probs(t.w, around, tokens).mean()
    for _ in range(20):
        t.batch(around, tokens)
    assert lm.log_probs(t.w, around, tokens).mean() > before + 1 and r is not None


def test_words_of_a_class_differ(spark, monkeypatch):
    """Every word has its own probability: a softmax in two levels, by brute force."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(lm.FREQUENT)]
    others = [f"{x}{y}ing" for x in "abcdefgh" for y in "stuvw"]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.9 else others[min(int(r.expovariate(0.2)), 39)] for _ in range(200))) for i in range(60)]
    rows += [(100, " ".join([*common[:3], "Asing", *common[3:6]])), (101, " ".join([*common[:3], "oddling", *common[3:6]])), (102, None), (103, "i"), (104, "I")]
    words = [[w.lower() for w in (t or "").split()] for _, t in rows]
    n = Counter(w for x in words for w in x)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    vocab, _ = lm.vocabulary(lm.count_words(df.select("text")))
    weights = lm.train(df.select("text"), vocab)
    flat = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
    of = {w: int(vocab.tokens(*flat(w))[0][0]) for w in n}
    totals = Counter()
    for w, k in n.items():
        totals[of[w]] += k
    want = {}
    for (i, t), x in zip(rows, words, strict=True):
        tokens, first = vocab.tokens(*flat(t or ""))
        assert tokens.tolist() == [of[w] for w in x]
        p = lm.log_probs(weights, lm.windows(tokens, first), tokens).sum() if x else 0
        want[i] = p + sum(np.log(n[w] / totals[of[w]]) for w in x)
    for top in (lm.TOP, 20, 0):  # counts from the broadcast, from both, and from the join
        monkeypatch.setattr(lm, "TOP", top)
        got = {x.doc_id: x.log_prob for x in lm.score_documents(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-2 for i in want), top
        assert got[101] < got[100] - 2 and got[103] == got[104]


def test_gradient_equals_differences():
    """One step of the first batch moves every weight as the differences of the loss tell."""
    r = np.random.default_rng(4)
    tokens = r.integers(0, lm.CLASSES - 1, 40)
    around = lm.windows(tokens, np.array([0, 15, 40]))
    t = lm.Trainer()
    before = [x.copy() for x in t.w]
    t.batch(around, tokens)
    loss = lambda w: -lm.log_probs(w, around, tokens).mean()
    for k, w in enumerate(before):
        flat = w.reshape(-1)
        moved = (t.w[k].reshape(-1) - flat) / -lm.RATE
        grad = np.sign(moved) * np.sqrt(1e-3 * moved**2 / np.maximum(1e-9, 1 - moved**2))  # as Adagrad scaled it
        for i in np.argsort(-abs(grad))[:6]:
            up, down = ([x.astype(np.float64) for x in before] for _ in range(2))
            up[k].reshape(-1)[i] += 1e-4
            down[k].reshape(-1)[i] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - grad[i]) < 0.05 * abs(grad[i]) + 1e-4


def test_weights_are_averaged_by_tokens(spark, monkeypatch):
    """Training over several tasks equals plain loops over their rows, weighted by tokens."""
    monkeypatch.setattr(lm, "PART_TOKENS", 1)
    rows = [(t,) for _, t in corpus(60)]
    df = spark.createDataFrame(rows, "text string").repartition(3).cache()
    vocab, _ = lm.vocabulary(lm.count_words(df))
    total, seen = None, 0
    for part in df.rdd.glom().collect():
        t = lm.Trainer()
        raw = [r.text.encode() for r in part]
        tokens, first = vocab.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        around = lm.windows(tokens, first)
        for a in range(0, len(tokens), lm.BATCH):
            t.batch(around[:, a : a + lm.BATCH], tokens[a : a + lm.BATCH])
        w = [x.astype(np.float64) * t.seen for x in t.w]
        total = w if total is None else [x + y for x, y in zip(total, w, strict=True)]
        seen += t.seen
    assert all(np.allclose(x, y / seen, atol=1e-5) for x, y in zip(lm.train(df, vocab), total, strict=True))


def test_long_text_and_every_text_its_own_windows(spark):
    long = " ".join(f"w{i % 50}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, "w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    assert got[1].n_tokens == 300_000 and abs(got[2].log_prob - got[3].log_prob) < 1e-4


def test_small_splits_are_put_together(spark):
    """The same rows over one or many partitions, in the same order, give the same network."""
    rows = [(i, t) for i, t in corpus(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    many = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(9, "doc_id").sortWithinPartitions("doc_id")
    scores = [{r.doc_id: r.log_prob for r in lm.score_documents(d).collect()} for d in (df, many)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 0.02 * abs(scores[0][i]) for i in scores[0])
