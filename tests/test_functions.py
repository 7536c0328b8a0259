"""Native and vectorized functions agree with the row logic."""

import pytest
from pyspark.sql import functions as F

from callgrid.functions import compiled
from callgrid.functions import native as N
from callgrid.functions import vectorized as V
from callgrid.kernel import text as T
from callgrid.kernel.phone import Phone, Phones
from callgrid.operators import numbers as O
from callgrid.plans import Plan, default_plan
from callgrid.sources import synthetic

P = Phones(default_plan())
TEXTS = [
    "", "a", "12", "+1 650-253-0000", "＋１　（６５０）　３３３－６０００", "0800 DDA 005", "1 MICROSOFT", "08-PIZZA", "(530) 583-6985 x302/x2303", "Tel:+800-345-600", "٠١٢٣ ۴۵۶", "Num-123", "650 x 253 - 1234",
    "12345+", "12+34*5#", "**1**", "tel:03-331-6005;phone-context=+64-3", ";phone-context=a.b-c.d;x", ";phone-context=-", "8 (423) 202-25-11 ДОБ 100", "abc def ghi", "00", "0", "000", "0120", "+1 650 253 0000 ext. 12", "650 253 0000 #12", "1-800-FLOWERS x5", "12 x 3", "𝟙𝟚𝟛 4", "6502530000;ext=7", "650253,,12", "\n+12\n34 ", "1/2-3.4 5", "١", None,
]


def test_text_functions(spark):
    r = F.col("raw")
    cols = {
        "digits": (N.digits_only(r), T.digits_only), "diallable": (N.diallable_only(r), T.diallable_only), "keypad": (N.keypad(r), T.keypad), "normalize": (N.normalize(r), T.normalize),
        "grouping": (N.grouping_only(r), T.grouping_only), "trim": (N.trim_end(r), T.trim_end), "viable": (N.is_viable(r), T.is_viable), "possible": (N.possible_number(r), T.possible_number),
        "context": (N.phone_context(r), T.phone_context), "valid_context": (N.is_context_valid(r), T.is_context_valid), "zeros": (N.leading_zeros(r), T.leading_zeros),
        "cut": (N.split_extension(r), T.split_extension), "alpha": (N.is_alpha_number(r), T.is_alpha_number),
    }
    df = spark.createDataFrame([(t,) for t in TEXTS], "raw string")
    for row in df.select("raw", *(c.alias(k) for k, (c, _) in cols.items())).collect():
        for k, (_, f) in cols.items():
            if k == "zeros" and row.raw and not row.raw.isdigit():
                continue
            if k == "cut":
                assert row.raw is None or tuple(row[k]) == f(row.raw), row.raw
                continue
            assert row[k] == (None if row.raw is None else f(row.raw)), (k, row.raw)


def _numbers(spark):
    return synthetic.from_key(spark.range(1200).withColumnRenamed("id", "key"), "key")


def _phone(r):
    return Phone(r.cc, r.national_number, r.ext, r.zero or None)


@pytest.mark.parametrize("most", [compiled.MOST_PATTERNS, 0])  # literal patterns, then the joined plan
def test_decisions(spark, monkeypatch, most):
    monkeypatch.setattr(compiled, "MOST_PATTERNS", most)
    df = _numbers(spark)
    for r in O.classify(df).collect():
        p = _phone(r)
        assert (r.number_region, r.number_type, r.is_valid, r.reason, r.dialled_abroad) == (P.region(p), P.type(p), P.is_valid(p), P.possible(p), P.can_be_dialled_abroad(p)), r
    for r in O.formats(df).collect():
        p = _phone(r)
        assert [r.e164, r.international_format, r.national_format, r.rfc3966_format] == [P.format(p, k) for k in O.KINDS], r
    for r in O.area_codes(df).collect():
        assert (r.ndc_length, r.area_code_length) == (P.destination_code_length(_phone(r)), P.area_code_length(_phone(r))), r


@pytest.mark.parametrize("most", [compiled.MOST_PATTERNS, 0])
def test_valid_for_region(spark, monkeypatch, most):
    monkeypatch.setattr(compiled, "MOST_PATTERNS", most)
    df = _numbers(spark).withColumn("asked", F.when(F.col("key") % 4 == 0, "CA").when(F.col("key") % 4 == 1, F.lit(None)).when(F.col("key") % 4 == 2, "YT").otherwise(F.col("region")))
    got = O.valid_for_region(df, "asked").collect()
    for r in got:
        assert r.valid_for_region == (r.asked is not None and P.is_valid_for_region(_phone(r), r.asked)), r
    assert {r.valid_for_region for r in got} == {True, False}


def test_region_columns(spark):
    df = spark.createDataFrame([("US",), ("UZ",), ("AO",), ("001",), ("xx",), (None,)], "r string")
    got = df.select("r", N.country_code_of(F.col("r"), default_plan()).alias("code"), N.national_prefix_of(F.col("r"), default_plan()).alias("ndd")).collect()
    assert [tuple(x) for x in got] == [("US", 1, "1"), ("UZ", 998, "8"), ("AO", 244, "00"), ("001", 0, None), ("xx", 0, None), (None, 0, None)]


def test_large_plans_agree_with_the_row_logic(spark):
    """A plan of many records: classes from workers, formats from the joined plan."""
    rows = [dict(r) for r in default_plan().rows]
    rows += [dict(r, id=f"Q{k}", country_code=400 + k) for k, r in enumerate([x for x in rows if x["id"] not in ("001",) and not x.get("main_country_for_code")] * 5)]
    plan = Plan(rows)
    assert not compiled.fits(plan)
    ops, codes = Phones(plan), sorted(plan.by_code)
    df = _numbers(spark).withColumn("cc", F.when(F.col("key") % 2 == 0, F.get(F.array(*map(F.lit, codes)), (F.col("key") % len(codes)).cast("int"))).otherwise(F.col("cc")))
    for r in O.formats(O.classify(df, plan), plan).collect():
        p = _phone(r)
        assert (r.number_region, r.number_type, r.is_valid, r.reason, r.national_format) == (ops.region(p), ops.type(p), ops.is_valid(p), ops.possible(p), ops.format(p, "NATIONAL")), r


def test_possible_by_type(spark):
    kinds = ("UNKNOWN", "MOBILE", "TOLL_FREE", "FIXED_LINE_OR_MOBILE")
    for r in O.possible_by_type(_numbers(spark), kinds).collect():
        assert [r[f"reason_{k.lower()}"] for k in kinds] == [P.possible(_phone(r), k) for k in kinds], r


@pytest.mark.parametrize("most", [compiled.MOST_PATTERNS, 0])
def test_classes_of_structs(spark, monkeypatch, most):
    monkeypatch.setattr(compiled, "MOST_PATTERNS", most)
    got = O.phones(_numbers(spark)).withColumn("phone", F.when(F.col("key") % 50 != 7, F.col("phone")))
    n = F.col("phone")
    for r in got.select("*", V.number_type(n).alias("t"), V.region(n).alias("g"), V.is_valid(n).alias("v"), V.is_valid_for_region(n, F.lit("GB")).alias("gb")).collect():
        p = _phone(r)
        want = (None,) * 4 if r.phone is None else (P.type(p), P.region(p), P.is_valid(p), P.is_valid_for_region(p, "GB"))
        assert (r.t, r.g, r.v, r.gb) == want, r


def test_vectorized_parse_and_formats(spark):
    df = synthetic.written(_numbers(spark), "key").limit(600)
    got = O.parse_column(df, "raw", "region", keep_raw=True).withColumn("p", F.col("parsed.phone"))
    got = got.select("raw", "region", "parsed", V.format(F.col("p"), "NATIONAL").alias("nat"), V.format_abroad(F.col("p"), F.lit("AU")).alias("abroad"), V.format_original(F.col("p"), F.lit("US")).alias("orig"), V.number_type(F.col("p")).alias("t"))
    n = 0
    for r in got.collect():
        p, error, _ = P.try_parse(r.raw, r.region, keep_raw=True)
        assert (r.parsed.ok, r.parsed.error) == (p is not None, error)
        if p is None:
            assert r.nat is None and r.t is None
        else:
            n += 1
            assert V.as_phone(r.parsed.phone.asDict()) == p
            assert (r.nat, r.abroad, r.orig, r.t) == (P.format(p, "NATIONAL"), P.format_abroad(p, "AU"), P.format_original(p, "US"), P.type(p))
    assert n > 100


def test_sql_names(spark):
    V.register(spark)
    r = spark.sql("SELECT phone_e164('0343 15 555 1212', 'AR') a, phone_is_valid('+1 650 253 0000', 'ZZ') b, phone_type('+44 7912 345678', 'ZZ') c, phone_format('+16502530000', 'ZZ', 'NATIONAL') d, phone_parse('x', 'US').error e, phone_e164('x', 'US') f").first()
    assert tuple(r) == ("+5493435551212", True, "MOBILE", "650 253 0000", "NOT_A_NUMBER", None)


def test_every_sql_name(spark):
    """Each name, called from SQL, gives what the row logic gives."""
    V.register(spark)
    texts = [("0343 15 555 1212", "AR"), ("+1 650 253 0000 ext. 12", "ZZ"), ("junk", "US"), (None, None), ("1-800-FLOWERS", "US"), ("+65 6521 8000", "GB")]
    spark.createDataFrame(texts, "t string, r string").createOrReplaceTempView("texts")
    more = {"phone_format": ["RFC3966"], "phone_possible_reason_for_type": ["MOBILE"], "phone_is_valid_for_region": ["US"], "phone_format_with_carrier": ["15"], "phone_format_with_preferred_carrier": ["15"]}
    more |= dict.fromkeys(("phone_format_abroad", "phone_format_abroad_keeping_letters", "phone_format_original", "phone_format_for_mobile"), ["AU"])
    for name, (call, _) in V.SQL_ON_TEXTS.items():
        args = more.get(name, [])
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(['t', 'r', *(repr(a) for a in args)])}) FROM texts").collect()]
        phones = [P.try_parse(t, r, keep_raw=True)[0] for t, r in texts]
        assert got == [None if p is None else call(P, p, *args) for p in phones], name
    values = {"phone_match": ("+1 650 253 0000", "650 253 0000"), "phone_region_of_code": (44,), "phone_example": ("GB", "MOBILE"), "phone_code_of_region": ("GB",), "phone_national_prefix_of_region": ("UZ",)}
    for name, (call, _) in V.SQL_ON_VALUES.items():
        args = values.get(name, ("1-800-FLOWERS ext. 3",))
        assert spark.sql(f"SELECT {name}({', '.join(map(repr, args))})").first()[0] == call(P, *args) is not None, name
