import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from callgrid.llm import linededup, minhash, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    line = lambda a, n: " ".join(f"w{(a * 7919 + i * i) % 5003}." for i in range(n))
    passage = line(999, 60)
    rows = [(i, f"{line(i, 70)}\n{line(i + 500, 30)}") for i in range(20)]
    rows += [(30, rows[3][1]), (31, f"{line(600, 80)}\n{passage}"), (32, f"{line(601, 80)}\n{passage}"), (33, line(602, 120) + " token=abcdefgh1 end."), (34, "too short"), (35, None), (36, "x! " * 90)]
    near = line(700, 200).split(" ")
    rows += [(40, " ".join(near)), (41, " ".join(near[:100] + ["changed."] + near[101:]))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "secrets", "packing"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in at[name].values())
    assert set(at["quality"]) == {i for i, *_ in rows} - {34, 35, 36}
    # 40 and 41 are one long line each, which differ
    assert set(at["line_dedup"]) == set(at["quality"]) - {30} and "\n" not in at["line_dedup"][32].text and "\n" in at["line_dedup"][31].text
    assert set(at["near_dedup"]) == set(at["line_dedup"]) - {41}
    assert "[assign]" in at["secrets"][33].text and "abcdefgh1" not in at["secrets"][33].text
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = {i: zlib.crc32(np.array([*lib.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, r in at["secrets"].items()}
    assert {r.doc_id: r.ids_crc32 for r in at["packing"]} == crc
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, at["packing"]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("clean", [quality.clean_documents, linededup.clean_documents, minhash.keep_one_of_each, secrets.redact_documents])
def test_stages_pass_other_columns_on(spark, clean):
    one, two = (" ".join(f"{x}{i}." for i in range(60)) for x in ("plain", "other"))
    df = spark.createDataFrame([(1, one, [1, 2], "a"), (2, two, None, None)], "doc_id long, text string, th array<int>, _gone string")
    out = clean(df)
    assert out.columns == df.columns and {(r.doc_id, str(r.th), r._gone) for r in out.collect()} == {(1, "[1, 2]", "a"), (2, "None", None)}


def test_scraps_repeated_rows_and_odd_rows(spark, tmp_path):
    """What is left of a copy goes if it is too short; one row of a doc_id is packed; rows without a
    doc_id, very long texts and other columns pass through."""
    line = lambda a, n: " ".join(f"v{a}x{i}." for i in range(n))
    base = [line(k, 40) for k in range(6)]
    long = "\n".join(line(100 + k, 50) for k in range(4_000))
    rows = [(1, "\n".join(base)), (2, "\n".join([*base[:3], line(50, 30), *base[3:]])), (3, "\n".join([*base, line(60, 70)])), (4, line(70, 80)), (4, line(70, 80)), (None, line(80, 90)), (5, None), (6, ""), (7, long), (1, line(90, 60))]
    docs = spark.createDataFrame([(*x, "a", [1]) for x in rows], "doc_id long, text string, kept string, n_lines_removed array<int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "kept", "n_lines_removed"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    # 2 kept 30 words of its own, 3 kept 70; the two texts of 1 are one document
    got = sorted((r.doc_id or 0, len(r.text.split())) for r in docs.collect())
    assert [i for i, _ in got] == [0, 1, 3, 4, 7] and dict(got)[3] == 70 and dict(got)[7] == 200_000
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {None, 1, 3, 4, 7} and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
