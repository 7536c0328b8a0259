import collections
import hashlib
import math
import random

import numpy as np

from callgrid.llm import fingerprint as fp


def test_entropy_levels_equal_the_formula():
    x = np.frombuffer(("Hello wörld, " + "a" * 70 + "b some text and more text 0123456789").encode(), np.uint8)
    levels = fp.entropy_levels(x)
    for s in range(len(x) - fp.WINDOW + 1):
        c = collections.Counter(x[s : s + fp.WINDOW].tolist())
        h = -sum(v / fp.WINDOW * math.log2(v / fp.WINDOW) for v in c.values())
        assert abs(levels[s] - fp.LEVELS * h / math.log2(fp.WINDOW)) < 1.01


def brute_features(data, rank):
    """Feature windows of one text by plain loops: positions, in order."""
    n = len(data) - fp.WINDOW + 1
    levels = fp.entropy_levels(np.frombuffer(data, np.uint8))
    key = [(int(rank[v]), i) if v >= fp.LEAST_LEVEL else None for i, v in enumerate(levels)]
    hoods = max(n - fp.WINDOW + 1, 1) if n > 0 else 0
    wins = collections.Counter()
    for t in range(hoods):
        found = [k for k in key[t : min(t + fp.WINDOW, n)] if k]
        if found:
            wins[min(found)[1]] += 1
    return [data[i : i + fp.WINDOW] for i in sorted(wins) if wins[i] >= min(fp.POPULAR, hoods)]


def texts(n=60, seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 8)))
    return [" ".join(word() for _ in range(r.choice([0, 1, 5, 9, 30, 200]))) for _ in range(n)] + ["a" * 100, "x"]


def test_features_equal_plain_loops():
    rank = np.random.default_rng(1).permutation(fp.LEVELS + 1)
    raw = [t.encode() for t in texts()]
    offsets = np.cumsum([0, *map(len, raw)])
    together = fp.features(np.frombuffer(b"".join(raw), np.uint8), offsets, rank)
    for t, got in zip(raw, together, strict=True):
        alone = fp.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank)[0]
        assert got.tolist() == alone.tolist()
        want = list(dict.fromkeys(brute_features(t, rank)))
        assert len(got) == (len(want) or bool(t))


def test_likeness():
    rank = np.arange(fp.LEVELS + 1)
    r = random.Random(2)
    a = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(600))
    b = " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(600))
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    x, y, z, e = fp.digests([a.encode(), b.encode(), half.encode(), b""], rank)
    assert x.likeness(x) == 1 and x.likeness(y) < 0.05 < x.likeness(z) < 0.95 and e.likeness(e) == 1 and e.likeness(x) == 0
    assert x.likeness(z) == z.likeness(x) and str(e) == ""


def test_documents(spark):
    rows = [(i * 3 % 97, t) for i, t in enumerate(texts())] + [(200, None), (None, "first of all")]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprint_documents(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(fp.edited(t, after).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by = collections.defaultdict(set)
    for i, t in rows:
        by[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and by[""] == {""}
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    one = fp.fingerprint_documents(spark.createDataFrame([(5, "abcd" * 32), (5, "abcd" * 32)], "doc_id long, text string")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)] * 2


def test_digests_equal_sets_of_bits():
    """The chained filters and the likeness by plain sets and loops."""
    r = random.Random(8)
    drawn = [r.getrandbits(64) for _ in range(700)]
    chains = [drawn[:0], drawn[:1], drawn[:128], drawn[:129], drawn[100:400], drawn[:700]]

    def filters(hashes):
        parts = [hashes[i : i + fp.PER_FILTER] for i in range(0, len(hashes), fp.PER_FILTER)]
        return [(len(p), {h >> 11 * k & 2047 for h in p for k in range(fp.HASHES)}) for p in parts]

    def like(x, y):
        a, b = sorted((filters(x), filters(y)), key=lambda f: (len(f), sum(n for n, _ in f)))
        if not a or not b:
            return float(len(a) == len(b))
        total = 0
        for n, bits in a:
            best = 0
            for _, other in b:
                chance, most = len(bits) * len(other) / 2048, min(len(bits), len(other))
                least = chance + fp.CUT * (most - chance)
                best = max(best, min(1, max(0, (len(bits & other) - least) / max(most - least, 1e-9))))
            total += n * best
        return total / sum(n for n, _ in a)

    made = [fp.Digest(np.array(c, np.uint64)) for c in chains]
    for c, d in zip(chains, made, strict=True):
        assert [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in d.filters] == [b for _, b in filters(c)]
        for c2, d2 in zip(chains, made, strict=True):
            assert abs(d.likeness(d2) - like(c, c2)) < 1e-9


def test_ranges(spark):
    """Null, equal and very large ids over many blocks; a very long text."""
    r = random.Random(9)
    rows = [(r.choice([None, 7, 7, (1 << 62) + i, -i]), f"text {i} " + "x y z " * (i % 5)) for i in range(300)] + [(1 << 61, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    th = {x.text: x.th for x in df.selectExpr("text", "xxhash64(text) as th").collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, th[x[1]]))
    want = sorted((str(i), hashlib.sha256(fp.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(x.doc_id), x.edited_sha256) for x in fp.fingerprint_documents(df).collect()) == want
