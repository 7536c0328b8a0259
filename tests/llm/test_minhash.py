import random
import re

import corpus_pipeline
from callgrid.llm import minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    """Families of edited copies: of one base, and chains whose ends are far apart."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    out, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 40, 150, 400]))]
        for k in range(r.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, max(1, len(base) // 60)])):
                copy[r.randrange(len(copy))] = word()
            if k % 3 == 0:
                base = copy  # the next ones start from here
            sep = r.choice([" ", "\n", "\t "])
            out.append((n, sep.join(x.upper() if r.random() < 0.1 else x for x in copy)))
            n += 1
    out += [(n, ""), (n + 1, " \n\t"), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, None)]
    return out


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, chunk in ((1, 256), (2, 3)):
        # small chunks: a bucket is then dealt over many pairs of chunks
        monkeypatch.setattr(minhash, "CHUNK_ROWS", chunk)
        rows = corpus(seed)
        want = brute(rows)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert any(i != c for i, (_, c) in want.items())


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "x"), (5, text, "x"), (7, text, None), (None, text, "y"), (9, "other text here", "z"), (9, text + " more", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False)]
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 5]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i * i % 9973}x{i % 7}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == len(shingles(text))


def test_stage_removes_copies_from_80_percent(spark):
    """A pair at 0.82: apart for op1, one of it goes in the stage; a pair under 0.8 stays."""
    rows = []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(104)]  # 100 shingles
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(base[:-10] + [f"n{k}x{i}" for i in range(10)])), (3 * k + 2, " ".join(base[:-13] + [f"m{k}x{i}" for i in range(13)]))]
    sets = [shingles(t) for _, t in rows[:3]]
    near = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.81 < near[0] < 0.83 and near[1] < 0.8 and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(df).collect())
    assert {r.doc_id for r in minhash.keep_one_of_each(df).collect()} == {i for i, _ in rows if i % 3 != 1}
    assert [r.doc_id for r in corpus_pipeline.dedup_documents(spark, df.where("doc_id < 3"), "").orderBy("doc_id").collect()] == [0, 2]


def thue_morse(n):
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_ids_at_both_ends_of_their_range(spark):
    text = " ".join(f"w{i}" for i in range(40))
    ids = [-(1 << 63), -(1 << 63) + 1, 6 * 10**18, 6 * 10**18 + 1, (1 << 63) - 2, (1 << 63) - 1]
    rows = [(i, text + f" end{k}") for k, i in enumerate(ids)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, ids[0]) for i in ids}


def test_words_that_a_polynomial_hash_confuses(spark):
    rows = [(k, t) for n in (1024, 2048) for k, t in zip((n, n + 1), thue_morse(n), strict=True)]
    rows += [(i + 10_000, " ".join([t] * 3 + [str(i)])) for i, t in rows]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_size_classes_and_repeated_buckets(spark, monkeypatch):
    """Texts of many sizes that share a passage meet in the same buckets of many bands."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 2)
    monkeypatch.setattr(minhash, "universal", lambda hashes, f=minhash.universal: tuple(x * 0 + y[0] for x, y in zip(f(hashes), f(hashes), strict=True)))
    r = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(40):
        own = [f"o{k // 2}x{i}" for i in range(r.choice([1, 5, 9, 20, 40, 80]) if k % 2 == 0 else len(own))]
        rows.append((k, " ".join(shared + own)))
    want = brute(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
