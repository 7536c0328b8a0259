"""DataFrame operators over numbers.

A number is given by the columns cc, national_number, zero, zeros and ext. Classification
and formats join the plan's row of the calling code by broadcast (its size is the plan's,
not the data's) and decide inside one projection: no shuffle, one row in, one row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrid.functions import compiled
from callgrid.functions import native as N
from callgrid.functions import vectorized as V
from callgrid.plans import tables
from callgrid.plans.loader import Plan, default_plan

KINDS = ("E164", "INTERNATIONAL", "NATIONAL", "RFC3966")


def with_nsn(df: DataFrame) -> DataFrame:
    return df.withColumn("nsn", N.nsn(F.col("national_number"), F.col("zero"), F.col("zeros")))


PLAN_COLUMNS = ("main_region", "national", "intl", "extn", "lengths", "locals")


def with_plan(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """df with nsn and the plan columns of its calling code (null where it is unknown)."""
    codes = tables.codes(df.sparkSession, plan or default_plan())
    return with_nsn(df).join(F.broadcast(codes), "cc", "left")


def _with_class(p: DataFrame, plan: Plan) -> DataFrame:
    """p with _c: struct(region, type, barred, national_prefix), null where none claims it."""
    cc, nsn = F.col("cc"), F.col("nsn")
    if compiled.fits(plan):
        return p.withColumn("_c", compiled.classified(cc, nsn, plan))
    return p.withColumn("_c", V.classified(cc, nsn, plan))


def _with_bodies(p: DataFrame, plan: Plan) -> DataFrame:
    """p with _nat and _int: the written number, null where the calling code is unknown."""
    cc, nsn, known = F.col("cc"), F.col("nsn"), F.col("national").isNotNull()
    if compiled.fits(plan):
        return p.withColumns({"_nat": compiled.national_body(cc, nsn, plan), "_int": compiled.plain_body(cc, nsn, plan)})
    body = lambda k, template: F.when(known, N.written(nsn, N.chosen_format(nsn, F.col(k)), template))
    return p.withColumns({"_nat": body("national", "national"), "_int": body("intl", "plain")})


def classify(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """df with nsn, number_region, number_type, is_valid, reason and dialled_abroad."""
    plan = plan or default_plan()
    p = _with_class(with_plan(df, plan), plan)
    p = p.withColumns({
        "number_type": F.coalesce("_c.type", F.lit("UNKNOWN")), "number_region": F.coalesce("_c.region", F.lit("ZZ")), "is_valid": F.coalesce(F.col("_c.type") != "UNKNOWN", F.lit(False)),
        "reason": N.possible_for(F.col("nsn"), F.col("lengths"), F.col("locals"), "UNKNOWN"), "dialled_abroad": ~F.coalesce("_c.barred", F.lit(False)),
    })
    return p.drop("_c", *PLAN_COLUMNS)


def formats(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """df with nsn, e164, national_format, international_format and rfc3966_format."""
    plan = plan or default_plan()
    p = _with_bodies(with_plan(df, plan), plan)
    cc, nsn, ext = F.col("cc"), F.col("nsn"), F.col("ext")
    out = p.withColumns({
        "e164": N.e164(cc, nsn), "national_format": N.national(F.col("_nat"), nsn, ext, F.col("extn")),
        "international_format": N.international(cc, F.col("_int"), nsn, ext, F.col("extn")), "rfc3966_format": N.rfc3966(cc, F.col("_int"), nsn, ext),
    })
    return out.drop("_nat", "_int", *PLAN_COLUMNS)


def valid_for_region(df: DataFrame, region: str, plan: Plan | None = None) -> DataFrame:
    """df with nsn and valid_for_region: the number is valid in the region of the column."""
    plan = plan or default_plan()
    df = with_nsn(df)
    if not compiled.fits(plan):
        return df.withColumn("valid_for_region", V.valid_in(F.col("cc"), F.col("nsn"), F.col(region), plan))
    return df.withColumn("valid_for_region", compiled.valid_in(F.col("cc"), F.col("nsn"), F.col(region), plan))


def area_codes(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """df with nsn, number_type, ndc_length and area_code_length."""
    plan = plan or default_plan()
    p = _with_bodies(_with_class(with_plan(df, plan), plan), plan)
    cc, nsn, none = F.col("cc"), F.col("nsn"), F.lit(None).cast("string")
    p = p.withColumn("number_type", F.coalesce("_c.type", F.lit("UNKNOWN")))
    p = p.withColumn("ndc_length", N.destination_code_length(cc, F.col("number_type"), N.international(cc, F.col("_int"), nsn, none, none)))
    p = p.withColumn("area_code_length", N.area_code_length(cc, F.col("_c.region"), F.col("_c.national_prefix"), F.col("number_type"), F.col("zero"), F.col("ndc_length")))
    return p.drop("_c", "_nat", "_int", *PLAN_COLUMNS)


def possible_by_type(df: DataFrame, kinds: tuple[str, ...], plan: Plan | None = None) -> DataFrame:
    """df with nsn and, for each type, a column reason_<type>."""
    p = with_plan(df, plan)
    for k in kinds:
        p = p.withColumn(f"reason_{k.lower()}", N.possible_for(F.col("nsn"), F.col("lengths"), F.col("locals"), k))
    return p.drop(*PLAN_COLUMNS)


def split_codes(df: DataFrame, digits: str, plan: Plan | None = None) -> DataFrame:
    """df with code (shortest known calling code in front, else null) and rest."""
    known = sorted((plan or default_plan()).by_code)
    d = F.col(digits)
    code = F.coalesce(*(F.when((F.length(d) >= k) & F.substring(d, 1, k).isin([str(c) for c in known if len(str(c)) == k]), F.substring(d, 1, k)) for k in (1, 2, 3)))
    code = F.when(~d.startswith("0"), code)
    return df.withColumn("code", code.cast("int")).withColumn("rest", F.when(code.isNotNull(), F.substr(d, F.length(code) + 1)))


def parse_column(df: DataFrame, raw: str, region: str, keep_raw: bool = False, plan: str | None = None) -> DataFrame:
    """df with parsed: ok, error, error_detail and phone of the text in raw."""
    return df.withColumn("parsed", V.parse(F.col(raw), F.col(region), keep_raw=keep_raw, plan=plan))


def from_struct(df: DataFrame, phone: str) -> DataFrame:
    """df with the columns cc, national_number, zero, zeros, ext of a phone struct."""
    p = F.col(phone)
    return df.withColumns({"cc": p["country_code"], "national_number": p["national_number"], "zero": p["italian_leading_zero"], "zeros": p["number_of_leading_zeros"], "ext": p["extension"]})


def phones(df: DataFrame) -> DataFrame:
    """df with phone, the struct of its columns cc, national_number, zero, zeros, ext."""
    none = [F.lit(None).cast("string").alias(k) for k in ("raw_input", "country_code_source", "preferred_domestic_carrier_code")]
    names = (("cc", "country_code"), ("national_number", "national_number"), ("ext", "extension"), ("zero", "italian_leading_zero"), ("zeros", "number_of_leading_zeros"))
    return df.withColumn("phone", F.struct(*(F.col(a).alias(b) for a, b in names), *none))


def dedupe(df: DataFrame, e164: str, order: str) -> DataFrame:
    """The first row of each number by order; combined before the shuffle, so a number on
    very many rows isn't gathered in one place."""
    cols = df.columns
    first = df.groupBy(e164).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_first"))
    return first.select("_first.*")


def latest_by_user(df: DataFrame, user: str, ts: str) -> DataFrame:
    """The last row of each user by time (the largest of the other columns on a tie)."""
    rest = [c for c in df.columns if c not in (user, ts)]
    last = df.groupBy(user).agg(F.max(F.struct(ts, *rest)).alias("_last"))
    return last.select(user, "_last.*")


def rollup_by_region(df: DataFrame) -> DataFrame:
    """Counts by region and type with subtotals, of classified numbers."""
    out = df.rollup("number_region", "number_type").agg(F.count("*").alias("n"), F.sum(F.col("is_valid").cast("long")).alias("n_valid"))
    return out


def numbered(df: DataFrame, e164: str, order: str) -> DataFrame:
    """df with use: the how-manieth row of its number, by order."""
    return df.withColumn("use", F.row_number().over(Window.partitionBy(e164).orderBy(order)))


def match_numbers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of numbers that match, with match: EXACT, NSN or SHORT_NSN.

    Both sides: id, cc, national_number, zero, zeros, ext. Of two numbers that match, one
    ends with the other, so each side's whole numbers are joined with the other side's
    suffixes: an equi-join that makes no pair but those of numbers that end alike, which
    Spark may split where a number is frequent.
    """
    fields = ("id", "cc", "national_number", "zero", "zeros", "ext")
    number = F.col("national_number").cast("string")

    def side(df: DataFrame, name: str, suffixes: bool, own: bool) -> DataFrame:
        key = number
        if suffixes:
            lengths = F.sequence(F.lit(1), F.length(number) if own else F.length(number) - 1)
            lengths = lengths if own else F.when(F.length(number) > 1, lengths).otherwise(F.array().cast("array<int>"))
            key = F.explode(F.transform(lengths, lambda k: F.right(number, k)))
        return df.select(key.alias("_key"), *(F.col(c).alias(f"{name}_{c}") for c in fields))

    # right numbers that end with a left one (or equal it), then left ones that end with a shorter right one
    pairs = side(left, "a", False, True).join(side(right, "b", True, True), "_key").unionByName(side(left, "a", True, False).join(side(right, "b", False, True), "_key"))
    of = lambda s: {k: F.col(f"{s}_{c}") for k, c in zip(("cc", "number", "zero", "zeros", "ext"), fields[1:], strict=True)}
    return pairs.select("a_id", "b_id", N.match(of("a"), of("b")).alias("match")).where("match <> 'NO_MATCH'")


#: Prefix maps of more entries are joined by a shuffle.
BROADCAST_PREFIXES = 1_000_000


def longest_prefix(df: DataFrame, digits: str, prefixes: DataFrame) -> DataFrame:
    """df with name: that of the longest prefix in front (the least of a prefix's names).

    One lookup for each length that a prefix has: rows are neither multiplied nor numbered, and
    a map of up to BROADCAST_PREFIXES entries moves none of them."""
    names = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("name").alias("name"))
    sizes = {r["k"]: r["count"] for r in names.groupBy(F.length("prefix").alias("k")).count().collect()}
    small = sum(sizes.values()) <= BROADCAST_PREFIXES
    out, found = df, []
    for k in sorted(sizes, reverse=True):
        found.append(f"_name{k}")
        own = names.where(F.length("prefix") == k).select(F.col("prefix").alias("_prefix"), F.col("name").alias(found[-1]))
        out = out.join(F.broadcast(own) if small else own, F.left(F.col(digits), F.lit(k)) == F.col("_prefix"), "left").drop("_prefix")
    return out.withColumn("name", F.coalesce(*map(F.col, found), F.lit(None).cast("string"))).drop(*found)
