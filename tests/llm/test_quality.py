import random
import re
from collections import Counter

import numpy as np

from callgrid.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = W.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if W.search(x)]
    lost = 0
    failed = 0
    for x in lines:
        w = len(W.findall(x))
        c = Counter(x)
        bars, syms, bangs, ends = c["|"], sum(c[k] for k in "#*$%&|<>"), c["!"], sum(c[k] for k in ".?!")
        bad = bars >= 3 and 4 * bars >= w or w >= 3 and 2 * syms >= w or w >= 3 and 2 * bangs >= w or w >= 40 and not ends
        bad = bad or any(p in x.encode().lower().decode() for p in quality.BOILERPLATE)
        failed += bad
        lost += w * bad
    base = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    counts = (len(words), sum(map(len, words)), sum(t.count(k) for k in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
    return *counts, base, not base and 100 * lost <= 40 * len(words), len(lines), failed, lost


def texts(n=300, seed=4):
    r = random.Random(seed)
    parts = ["the", "of", "über", "|", "a|b", "$$$", "yes!", "end.", "日本", " x", "All rights reserved", "x" * 9, "<b>", "\u0085q"]
    seps = [" ", " ", " ", "\n", "\t", "\r\n", "  ", "\x0b"]
    return ["".join(r.choice(parts) + r.choice(seps) for _ in range(r.randrange(0, 160))) for _ in range(n)]


def test_equals_brute_force(spark):
    rows = list(enumerate([*texts(), "", None, " \n", "a b c " * 20]))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: tuple(r)[1:] for r in quality.judge_documents(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert quality.judge_documents(df.limit(0)).count() == 0


def test_clean_documents(spark):
    good = " ".join(f"word{i}." for i in range(60))
    rows = [(1, f"{good}\nHome | About | News | Contact\nlast line of it.", 0), (2, "short", 0), (None, good, 0), (4, None, 0), (5, good, 0), (5, good, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = quality.clean_documents(df)
    assert got.columns == df.columns
    rows = sorted(((r.doc_id or 0), r.text, r.n_chars) for r in got.collect())
    assert rows == [(0, good, len(good)), (1, f"{good}\nlast line of it.", len(good) + 17), (5, good, len(good)), (5, good, len(good))]


def test_long_text(spark):
    text = "one two three four. " * 200_000 + "\n" + " ".join(map(str, range(100)))
    r = quality.judge_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(r)[1:] == brute(text)


def test_equal_hashes_are_compared(monkeypatch):
    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    every = [*texts(60), f"{a}\n{b}", f"{a[:1024]}\n{b[:1024]} {a} x x {b} x x"]
    raw = [t.encode() for t in every]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [brute(t) for t in every]
    for bits in (64, 3):
        monkeypatch.setattr(quality, "run_hashes", lambda *x, f=quality.run_hashes, bits=bits: f(*x) >> np.uint64(64 - bits))
        monkeypatch.setattr(quality, "mix64", lambda x, f=quality.mix64, bits=bits: f(x) >> np.uint64(64 - bits))
        got = quality._judge(flat, offsets)[0]
        assert [got["n_dup_lines"][i] for i in range(len(every))] == [x[3] for x in want]
        assert [got["n_repeat_words"][i] for i in range(len(every))] == [x[4] for x in want]
