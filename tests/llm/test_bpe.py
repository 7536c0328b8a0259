import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callgrid.llm import bpe, packing, pretoken

PATH, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHA = [*"abcdeTHEINthein  \n\t'sS.,!12<|>é ñßΣσİKſ中文日本", "ȩ́", " ", "\x1c", "\x85", "‍", "😀", "👍🏽", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "½", "Ⅷ", "ˮ", "\x00"]


def texts(n=1500, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHA) for _ in range(r.randrange(0, 60))) for _ in range(n)] + ["", "a" * 700, "the" * 300, "x" * 300 + "é" * 200]


@pytest.mark.parametrize("path,make", [(PATH, bpe.Encoder), (PIECES, packing.PieceEncoder)])
def test_ids_equal_the_library(path, make):
    own, lib = make(path), Tokenizer.from_file(path)
    all_ = texts()
    for t, ids in zip(all_, own.encode(all_), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t
        if path == PATH:
            assert own.decode(ids.tolist()) == lib.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("path,make", [(PATH, bpe.Encoder), (PIECES, packing.PieceEncoder)])
def test_words_of_equal_hashes_keep_their_ids(path, make, monkeypatch):
    lib = Tokenizer.from_file(path)
    all_ = texts(300)
    for n in (1024, 2048):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        all_ += [a, a.translate(str.maketrans("ab", "ba"))]
    want = [lib.encode(t, add_special_tokens=False).ids for t in all_]
    assert [x.tolist() for x in make(path).encode(all_)] == want
    # all hashes into 20 values: nearly every word meets another one's entry
    monkeypatch.setattr(pretoken, "_hashed", lambda *a, f=pretoken._hashed: f(*a) % np.uint64(20))
    own = make(path)
    assert [x.tolist() for x in own.encode(all_)] == want and [x.tolist() for x in own.encode(all_)] == want


def test_long_text():
    text = " ".join(f"w{i % 977}é" for i in range(120_000)) + " " + "z" * 300_000
    for path, own in ((PATH, bpe.Encoder(PATH)), (PIECES, packing.PieceEncoder(PIECES))):
        lib = Tokenizer.from_file(path)
        assert own.encode([text[:900_000]])[0].tolist() == lib.encode(text[:900_000], add_special_tokens=False).ids


def test_documents(spark):
    rows = list(enumerate([*texts(100), None])) + [(None, "hello"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, n_tokens string")
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, bpe.digest_documents(df, PATH).collect()))) == sorted(map(str, want))
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH)
    assert back.count() == len(rows) and bpe.digest_documents(df.limit(0), PATH).count() == 0
