"""DataFrame operators, sources, streams and the registered queries."""

import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from callgrid.kernel.phone import Phone, PhoneError, Phones
from callgrid.operators import catalog
from callgrid.operators import numbers as O
from callgrid.plans import Plan, default_plan, loader
from callgrid.sources import files
from callgrid.streaming import numbers as S

P = Phones(default_plan())
SF = "/root/testdata/sf0.001"


def test_match_numbers_equals_all_pairs(spark):
    left = [(1, 64, 33316005, None, None, None), (2, 1, 6502530000, None, None, "12"), (3, 0, 2530000, None, None, None), (4, 39, 236618300, True, None, None), (5, 1, 5, None, None, None)]
    right = [(11, 64, 33316005, None, None, None), (12, 0, 33316005, None, None, None), (13, 64, 316005, None, None, None), (14, 1, 6502530000, None, None, "3"), (15, 1, 2530000, None, None, None), (16, 39, 236618300, None, None, None), (17, 39, 236618300, True, 1, None), (18, 1, 6502530005, None, None, None)]
    schema = "id long, cc int, national_number long, zero boolean, zeros int, ext string"
    got = {(r.a_id, r.b_id): r.match for r in O.match_numbers(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    phone = lambda r: Phone(r[1], r[2], r[5], r[3], r[4])
    want = {(a[0], b[0]): m for a in left for b in right if (m := P.match(phone(a), phone(b))) != "NO_MATCH"}
    assert got == want and set(want.values()) == {"EXACT_MATCH", "NSN_MATCH", "SHORT_NSN_MATCH"}


def test_match_pairs_uses_every_customer(spark, tmp_path):
    keys = [(40 * k + s,) for k in range(3) for s in (0, 3, 12, 18, 30)] + [(8000 * k + 3,) for k in range(1, 4)]
    spark.createDataFrame(keys, "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = catalog._customers(spark, str(tmp_path)).collect()
    number = lambda r: (r.national_number % 1000000 if r.key % 4 == 0 else r.national_number)
    left = {r.key: Phone(r.cc, r.national_number, r.ext, r.zero, r.zeros) for r in rows}
    right = {r.key: Phone(0 if r.key % 5 == 0 else r.cc, number(r), r.ext, r.zero, r.zeros) for r in rows}
    want = {(a, b): m for a in left for b in right if (m := P.match(left[a], right[b])) != "NO_MATCH"}
    got = catalog.QUERIES["match_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a_id, r.b_id): r.match for r in got} == want and any(a % 3 == 0 for a, _ in want)


def test_parse_struct_of_all_codes_and_styles(spark, tmp_path):
    spark.range(240).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.QUERIES["parse_struct"](spark, str(tmp_path)).collect()
    assert {(r.key % 12, r.key % 40) for r in got} == {(k % 12, k % 40) for k in range(120)} and len(got) == 240

    def parsed(raw, region):
        try:
            p = P.parse(raw, region)
            return p.country_code, p.national_number, p.extension
        except PhoneError:
            return None, None, None

    for r in got:
        assert r.raw is None or (r.country_code, r.national_number, r.extension) == parsed(r.raw, r.region), r
    assert len({r.country_code for r in got}) > 15


def test_dedupe_latest_numbered_and_prefixes(spark):
    df = spark.createDataFrame([("+1", 3, "a"), ("+1", 1, "b"), ("+2", 2, None)], "e164 string, t int, who string")
    assert sorted(map(tuple, O.dedupe(df, "e164", "t").collect())) == [("+1", 1, "b"), ("+2", 2, None)]
    assert sorted(tuple(r) for r in O.latest_by_user(df, "e164", "t").select("e164", "t").collect()) == [("+1", 3), ("+2", 2)]
    assert {(r.e164, r.t): r.use for r in O.numbered(df, "e164", "t").collect()} == {("+1", 1): 1, ("+1", 3): 2, ("+2", 2): 1}
    names = spark.createDataFrame([("1", "one"), ("165", "three"), ("44", "two")], "prefix string, name string")
    got = O.longest_prefix(spark.createDataFrame([("16502",), ("1777",), ("99",), ("",), ("",)], "d string"), "d", names)
    assert sorted(str((r.d, r.name)) for r in got.collect()) == sorted(map(str, [("16502", "three"), ("1777", "one"), ("99", None), ("", None), ("", None)]))


def test_prefixes_of_any_length(spark):
    names = spark.createDataFrame([("1", "one"), ("123456789012", "long")], "prefix string, name string")
    df = spark.createDataFrame([("1234567890123",), ("12345678901",)], "d string")
    assert {r.d: r.name for r in O.longest_prefix(df, "d", names).collect()} == {"1234567890123": "long", "12345678901": "one"}
    assert {r.name for r in O.longest_prefix(df, "d", names.limit(0)).collect()} == {None}


def test_sources(spark, tmp_path):
    (tmp_path / "256.txt").write_text("# comment\n\n25639|Africell\n 25670 | Airtel|x\nbad line\n")
    assert sorted(map(tuple, files.prefix_map(spark, str(tmp_path / "256.txt")).collect())) == [("25639", "Africell"), ("25670", "Airtel|x")]
    (tmp_path / "r.csv").write_text('Prefix ; Length ; Type\n"9[1-3]" ; 9 ; "PREMIUM RATE"\n')
    t = files.code_table(spark, str(tmp_path / "r.csv"))
    assert t.columns == ["Prefix", "Length", "Type"] and tuple(t.first()) == ("9[1-3]", "9", "PREMIUM RATE")
    docs = spark.createDataFrame([(1, "call +1 (310) 555-4510 or 10.0.0.1 or 4111 1111 1111 1111"), (2, None)], "id int, text string")
    assert [tuple(r) for r in files.extract_numbers(docs, "text", "id").collect()] == [(1, "+1 (310) 555-4510", "+13105554510")]


def test_streams(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("0650 2530000", "US", at(0)), ("+1 650 253 0000", "ZZ", at(1)), ("650-253-0001", "US", at(2)), ("junk", "US", at(3))]
    spark.createDataFrame(rows, "raw string, region string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("raw string, region string, ts timestamp").parquet(str(tmp_path / "in"))
    parsed = O.with_nsn(O.from_struct(O.parse_column(stream, "raw", "region").where("parsed.ok"), "parsed.phone"))
    parsed = parsed.withColumn("e164", F.concat(F.lit("+"), F.col("cc").cast("string"), F.col("nsn")))
    for name, out in (("firsts", S.dedupe_within(parsed, "e164", "ts")), ("windows", S.counts_by_window(parsed, "ts", "cc"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "firsts" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.e164 for r in spark.table("firsts").collect()} >= {"+16502530000", "+16502530001"}
    assert spark.table("firsts").where("e164 = '+16502530000'").count() == 1
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 3


def test_plan_from_a_path_and_bad_plans(tmp_path):
    path = Path(loader.__file__).with_name("plan.json")
    assert len(Plan.load(str(path)).records) == 36
    with pytest.raises(ValueError):
        Plan([{"id": "XX", "country_code": 1, "descs": {"general": {"pattern": "(a|)"}}}])


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([r[c] for c in cols]) for r in df.collect())
    assert rows or name == "page_numbers_e164"  # few pages of the smallest tables hold a number
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols and sorted(str([r[i] for i in at]) for r in rel.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['callgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries()); assert 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
