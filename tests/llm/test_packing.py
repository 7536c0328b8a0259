import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from callgrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plans_hold_every_piece():
    r = random.Random(2)
    for _ in range(200):
        c = r.choice([10, 50, 2048])
        h = defaultdict(int)
        for _ in range(r.randrange(0, 50)):
            h[r.randint(1, c)] += r.randint(1, 5)
        got = defaultdict(int)
        for n, held in packing.plan(dict(h), c):
            assert n > 0 and sum(s * m for s, m in held) <= c
            for s, m in held:
                got[s] += n * m
        assert got == h


def best(sizes, c):
    """The fewest sequences, by exhaustive search."""
    for k in itertools.count(0):
        def place(i, room):
            if i == len(sizes):
                return True
            for j in sorted(set(room), reverse=True):
                if j >= sizes[i] and place(i + 1, _less(room, j, sizes[i])):
                    return True
            return False
        if place(0, [c] * k):
            return k


def _less(room, j, s):
    out = list(room)
    out[out.index(j)] -= s
    return out


def test_dominance_never_costs_a_sequence():
    r = random.Random(3)
    for _ in range(120):
        c = r.choice([7, 10, 13])
        sizes = sorted((r.randint(1, c) for _ in range(r.randint(1, 8))), reverse=True)
        left = np.bincount(sizes, minlength=c + 1)
        fixed = sum(n for n, _ in packing.dominance(left, c))
        rest = [s for s in range(c, 0, -1) for _ in range(left[s])]
        assert fixed + best(rest, c) == best(sizes, c), sizes
        assert sum(n for n, _ in packing.plan({s: sizes.count(s) for s in sizes}, c)) <= best(sizes, c) + 1


def test_very_long_text_and_equal_rows(spark):
    """A text of hundreds of pieces, and many equal rows that tie in everything."""
    long = " ".join(f"w{i % 977}é" for i in range(150_000))
    rows = [(1, long), *[(2, "the same words")] * 3_000, *[(k, "the same words") for k in range(3, 500)]]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    ids = np.array([*Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, 0], "<u4")
    pieces = sorted((x.piece, x.start, x.length, x.ids_crc32) for x in got if x.doc_id == 1)
    assert len(pieces) > 100 and sum(x[2] for x in pieces) == len(ids) and all(x[2] == 2048 for x in pieces[1:])
    assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, c in pieces)
    assert len(got) == len(pieces) + 3_497 and len({(x.sequence_id, x.offset) for x in got}) == len(got)
    bins = defaultdict(int)
    for x in got:
        bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "of", "zebra", "été", "\n"]) for _ in range(r.choice([0, 3, 300, 1500, 5000])))) for i in range(60)]
    rows += [(None, "x y"), (70, None), (5, rows[5][1]), (71, "<|endoftext|> a")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, offset int")
    got = packing.pack_documents(df, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048 or 2048
        edges = [0, *range(head, len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(map(str, (tuple(x)[:5] for x in got))) == sorted(map(str, want))
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(x.length for x in got) // 2048) + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
