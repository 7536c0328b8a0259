"""The engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.functions import native as N
from callgrid.functions import vectorized as V
from callgrid.kernel import text as T
from callgrid.operators import numbers as O
from callgrid.operators import oracle as Q
from callgrid.plans import default_plan, tables
from callgrid.plans.loader import NumberFormat
from callgrid.sources import files, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made from all customers' keys."""
    return synthetic.from_key(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written numbers of all customers."""
    return synthetic.written(_customers(spark, sf_dir), "key")


_NUMBERS = synthetic.sql("customer", "c_custkey")

# --- numbers in text


@query(r"""
WITH raw AS (SELECT unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS raw FROM documents),
e AS (SELECT '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS e164 FROM raw)
SELECT substr(e164, 3, 3) AS area, count(*) AS n_numbers, count(DISTINCT e164) AS n_distinct FROM e GROUP BY 1
""")
def text_numbers_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in the documents, counted by area code."""
    found = files.extract_numbers(_read(spark, sf_dir, "documents"), "text")
    return found.groupBy(F.substring("e164", 3, 3).alias("area")).agg(F.count("*").alias("n_numbers"), F.count_distinct("e164").alias("n_distinct"))


@query(r"""
WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS raw FROM documents)
SELECT doc_id, raw, '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS e164 FROM raw
""")
def text_numbers_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extract_numbers(_read(spark, sf_dir, "documents"), "text", "doc_id")


@query(r"""
WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS raw FROM pages)
SELECT page_id, raw, '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS e164 FROM raw
""")
def page_numbers_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extract_numbers(_read(spark, sf_dir, "pages"), "html", "page_id")


# --- text scalars

_RAW = Q.written(_NUMBERS)


@query(f"WITH {_RAW} SELECT key, regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') AS digits FROM written")
def normalize_digits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.digits_only(F.col("raw")).alias("digits"))


@query(f"WITH {_RAW} SELECT key, regexp_replace(raw, '[^0-9+*#]', '', 'g') AS diallable FROM written")
def normalize_diallable_chars_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.diallable_only(F.col("raw")).alias("diallable"))


@query(f"SELECT p_partkey, translate(p_name, '{Q.KEYPAD[0]}', '{Q.KEYPAD[1]}') AS converted FROM part")
def convert_alpha_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", N.keypad(F.col("p_name")).alias("converted"))


@query(f"""WITH {_RAW} SELECT key, CASE WHEN length(regexp_replace(raw, '[^A-Za-z]', '', 'g')) >= 3
  THEN regexp_replace(translate(raw, '{Q.KEYPAD[0]}', '{Q.KEYPAD[1]}'), '[^0-9]', '', 'g')
  ELSE regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') END AS normalized FROM written""")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.normalize(F.col("raw")).alias("normalized"))


@query(f"WITH {_RAW} SELECT key, regexp_replace(upper(raw), '[^A-Z0-9/ .-]', '', 'g') AS grouped FROM written")
def grouping_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.grouping_only(F.col("raw")).alias("grouped"))


@query(f"""WITH {_RAW}, b AS (SELECT key, regexp_replace(nullif(regexp_extract(raw, '(?s)[+＋\\p{{Nd}}].*'), ''), '[^\\p{{N}}\\p{{L}}#]+$', '') AS t FROM written)
SELECT key, CASE WHEN regexp_matches(t, '[\\\\/] *x') THEN regexp_extract(t, '(.*)[\\\\/] *x', 1) ELSE t END AS possible FROM b""")
def extract_possible_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.possible_number(F.col("raw")).alias("possible"))


@query(f"WITH {_RAW} SELECT key, regexp_replace(raw, '[^\\p{{N}}\\p{{L}}#]+$', '') AS trimmed FROM written")
def trim_unwanted_end_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.trim_end(F.col("raw")).alias("trimmed"))


@query(f"WITH {_RAW} SELECT key, strlen(raw) >= 2 AND regexp_full_match(raw, {Q.quoted(Q.VIABLE)}) AS viable FROM written")
def is_viable_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", N.is_viable(F.col("raw")).alias("viable"))


@query(f"WITH {_RAW} SELECT key, starts_with(raw, '+') OR starts_with(raw, '＋') AS plus, regexp_full_match(raw, '\\p{{Nd}}*') AS all_digits, CASE WHEN starts_with(raw, '00') THEN substr(raw, 3) END AS rest FROM written")
def starts_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _texts(spark, sf_dir).select("key", raw.rlike(f"^[{T.PLUS}]").alias("plus"), raw.rlike(r"^\p{Nd}*\z").alias("all_digits"), N.strip_prefix(raw, F.lit("00")).alias("rest"))


@query(f"""WITH {_RAW}, c AS (SELECT key, 'tel:' || coalesce(raw, '') || CASE key % 4 WHEN 0 THEN ';phone-context=+64-3' WHEN 1 THEN ';phone-context=www.example.com;a=b' WHEN 2 THEN ';phone-context=+' ELSE '' END AS t FROM written),
x AS (SELECT key, CASE WHEN contains(t, ';phone-context=') THEN string_split(string_split(t, ';phone-context=')[2], ';')[1] END AS context FROM c)
SELECT key, context, regexp_full_match(context, {Q.quoted(Q.CONTEXTS[0])}) OR regexp_full_match(context, {Q.quoted(Q.CONTEXTS[1])}) AS valid FROM x""")
def phone_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, (";phone-context=+64-3", ";phone-context=www.example.com;a=b", ";phone-context=+", ""))), F.pmod(F.col("key"), F.lit(4)).cast("int"))
    t = _texts(spark, sf_dir).select("key", N.phone_context(F.concat(F.lit("tel:"), F.coalesce("raw", F.lit("")), tail)).alias("context"))
    return t.withColumn("valid", N.is_context_valid(F.col("context")))


@query(f"""WITH {_NUMBERS}, z AS (SELECT key, repeat('0', CAST(key % 5 AS INTEGER)) || CASE WHEN key % 7 = 0 THEN '' ELSE nsn END AS s FROM numbers)
SELECT key, CASE WHEN length(s) >= 2 AND starts_with(s, '0') THEN CAST(length(s) - length(ltrim(s, '0')) - CASE WHEN ltrim(s, '0') = '' THEN 1 ELSE 0 END AS INTEGER) END AS zeros FROM z""")
def italian_leading_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.with_nsn(_customers(spark, sf_dir))
    s = F.concat(F.repeat(F.lit("0"), F.pmod(F.col("key"), F.lit(5)).cast("int")), F.when(F.pmod(F.col("key"), F.lit(7)) == 0, "").otherwise(F.col("nsn")))
    return d.select("key", N.leading_zeros(s).alias("zeros"))


_TAILS = (" x123", " ext. 45", ";ext=9", " #77", "-12#", ",,5", "", " anexo 6")
_TAILED = f"{_RAW}, tailed AS (SELECT key, raw || CASE key % {len(_TAILS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END AS s FROM written)"


def _tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written numbers with extensions in many styles, or none, at their ends."""
    tail = F.get(F.array(*map(F.lit, _TAILS)), F.pmod(F.col("key"), F.lit(len(_TAILS))).cast("int"))
    return _texts(spark, sf_dir).select("key", F.concat("raw", tail).alias("s"))


@query(f"WITH {_TAILED}, {Q.extensions('tailed')} SELECT key, s, number, extension FROM cuts")
def split_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tailed(spark, sf_dir).withColumn("x", N.split_extension(F.col("s"))).select("key", "s", "x.number", "x.extension")


@query(f"WITH {_TAILED}, {Q.extensions('tailed')} SELECT key, viable AND length(regexp_replace(number, '[^A-Za-z]', '', 'g')) >= 3 AS alpha FROM cuts")
def alpha_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tailed(spark, sf_dir).select("key", N.is_alpha_number(F.col("s")).alias("alpha"))


# --- numbers: identity, codes, lengths


@query(f"WITH {_NUMBERS} SELECT key, nsn, '+' || cc || nsn AS e164 FROM numbers")
def national_significant_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_nsn(_customers(spark, sf_dir)).select("key", "nsn", N.e164(F.col("cc"), F.col("nsn")).alias("e164"))


@query(f"""WITH known(code) AS (VALUES {', '.join(f'({c})' for c in default_plan().by_code)}),
d AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + 10 AS VARCHAR) AS digits FROM orders),
c AS (SELECT o_orderkey, digits, min(length(CAST(code AS VARCHAR))) AS k FROM d LEFT JOIN known ON starts_with(digits, CAST(code AS VARCHAR)) GROUP BY 1, 2)
SELECT o_orderkey, digits, CAST(substr(digits, 1, k) AS INTEGER) AS code, substr(digits, k + 1) AS rest FROM c""")
def extract_country_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 + 10).cast("string").alias("digits"))
    return O.split_codes(d, "digits")


@query(f"WITH {_NUMBERS}, {Q.codes()}, {Q.reason('numbers', 'general')} SELECT key, reason, reason IN ('IS_POSSIBLE', 'IS_POSSIBLE_LOCAL_ONLY') AS possible FROM reasons")
def possible_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.possible_by_type(_customers(spark, sf_dir), ("UNKNOWN",))
    return p.select("key", F.col("reason_unknown").alias("reason"), F.col("reason_unknown").isin("IS_POSSIBLE", "IS_POSSIBLE_LOCAL_ONLY").alias("possible"))


@query(f"""WITH {_NUMBERS}, {Q.codes()}, {Q.reason('numbers', 'mobile', 'm')}, {Q.reason('numbers', 'toll_free', 't')}, {Q.reason_fixed_or_mobile('numbers', 'f')}
SELECT m.key, m.reason AS reason_mobile, t.reason AS reason_toll_free, f.reason AS reason_fixed_line_or_mobile FROM m JOIN t USING (key) JOIN f USING (key)""")
def possible_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("MOBILE", "TOLL_FREE", "FIXED_LINE_OR_MOBILE")
    return O.possible_by_type(_customers(spark, sf_dir), kinds).select("key", *(f"reason_{k.lower()}" for k in kinds))


# --- classification

_CLASS = f"{_NUMBERS}, {Q.regions()}, {Q.classified('numbers')}"


@query(f"WITH {_CLASS} SELECT key, number_region, number_type, number_type <> 'UNKNOWN' AS is_valid, dialled_abroad FROM classified")
def classify_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.classify(_customers(spark, sf_dir)).select("key", "number_region", "number_type", "is_valid", "dialled_abroad")


@query(f"WITH {_CLASS} SELECT number_region, number_type, count(*) AS n, CAST(sum(CASE WHEN number_type <> 'UNKNOWN' THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM classified GROUP BY ROLLUP (number_region, number_type)")
def rollup_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rollup_by_region(O.classify(_customers(spark, sf_dir)))


@query(f"""WITH {_CLASS} SELECT key, number_type IN ('FIXED_LINE', 'FIXED_LINE_OR_MOBILE') OR (number_type = 'MOBILE' AND cc IN (52, 54, 55, 62, 86)) AS geographical FROM classified""")
def is_number_geographical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.classify(_customers(spark, sf_dir)).select("key", N.is_geographical(F.col("cc"), F.col("number_type")).alias("geographical"))


@query(f"""WITH {_CLASS}, asked AS (SELECT key, CASE key % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE region END AS asked FROM numbers)
SELECT key, asked, coalesce(t <> 'UNKNOWN', false) AS valid_for_region FROM asked LEFT JOIN typed ON typed.key = asked.key AND preg = asked""".replace("SELECT key, asked, coalesce", "SELECT asked.key, asked, coalesce"))
def valid_for_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("key") % 3 == 0, "US").when(F.col("key") % 3 == 1, "GB").otherwise(F.col("region"))
    return O.valid_for_region(_customers(spark, sf_dir).withColumn("asked", asked), "asked").select("key", "asked", "valid_for_region")


@query(f"WITH {_NUMBERS}, {Q.regions()} SELECT key, numbers.region, coalesce(plan.cc, 0) AS code, CASE WHEN plan.cc IS NOT NULL THEN replace(coalesce(national_prefix, ''), '~', '') END AS ndd FROM numbers LEFT JOIN plan ON plan.region = numbers.region AND plan.region <> '001'")
def codes_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calling code and the national prefix of each customer's region."""
    region = F.col("region")
    return _customers(spark, sf_dir).select("key", "region", N.country_code_of(region, default_plan()).alias("code"), N.national_prefix_of(region, default_plan()).alias("ndd"))


# --- formats

_FORMATS = f"{_NUMBERS}, {Q.formats()}, {Q.formatted('numbers')}"


@query(f"WITH {_FORMATS} SELECT key, e164, national_format, international_format, rfc3966_format FROM formatted")
def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.formats(_customers(spark, sf_dir)).select("key", "e164", "national_format", "international_format", "rfc3966_format")


@query(f"WITH {_FORMATS} SELECT key, known AND national_pattern IS NOT NULL AS has_format FROM formatted")
def has_formatting_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.with_plan(_customers(spark, sf_dir))
    return p.select("key", F.coalesce(N.chosen_format(F.col("nsn"), F.col("national")).isNotNull(), F.lit(False)).alias("has_format"))


@query(f"WITH {_NUMBERS}, {Q.regions()}, {Q.classified('numbers')}, {Q.formats()}, {Q.formatted('numbers')}, {Q.area_codes()} SELECT key, number_type, ndc_length, area_code_length FROM areas")
def area_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.area_codes(_customers(spark, sf_dir)).select("key", "number_type", "ndc_length", "area_code_length")


# --- comparison


@query(f"""WITH {_NUMBERS}, a AS (SELECT key AS id, cc, national_number AS n, zero, ext FROM numbers),
b AS (SELECT key AS id, CASE WHEN key % 5 = 0 THEN 0 ELSE cc END AS cc, CASE WHEN key % 4 = 0 THEN national_number % 1000000 ELSE national_number END AS n, zero, ext FROM numbers),
p AS (SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.ext <> b.ext THEN 'NO_MATCH' WHEN a.cc <> 0 AND b.cc <> 0 AND a.cc <> b.cc THEN 'NO_MATCH'
  WHEN a.n = b.n AND a.ext IS NOT DISTINCT FROM b.ext AND a.zero = b.zero THEN CASE WHEN a.cc <> 0 AND b.cc <> 0 THEN 'EXACT_MATCH' ELSE 'NSN_MATCH' END
  WHEN ends_with(CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR)) OR ends_with(CAST(b.n AS VARCHAR), CAST(a.n AS VARCHAR)) THEN 'SHORT_NSN_MATCH' ELSE 'NO_MATCH' END AS match
  FROM a, b)
SELECT a_id, b_id, match FROM p WHERE match <> 'NO_MATCH'""")
def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' numbers against all of them in altered form."""
    d = _customers(spark, sf_dir).withColumnRenamed("key", "id")
    return O.match_numbers(d, _altered(d))


def _altered(d: DataFrame) -> DataFrame:
    """Numbers without their code, or cut to six digits, by turns."""
    return d.withColumn("cc", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("cc"))).withColumn("national_number", F.when(F.col("id") % 4 == 0, F.col("national_number") % 1000000).otherwise(F.col("national_number")))


@query(f"WITH {_NUMBERS} SELECT cc, nsn, min(key) AS key, count(*) AS n FROM numbers GROUP BY 1, 2")
def dedupe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.with_nsn(_customers(spark, sf_dir)).withColumn("e164", N.e164(F.col("cc"), F.col("nsn")))
    counts = d.groupBy("e164").agg(F.count("*").alias("n"))
    return O.dedupe(d, "e164", "key").join(counts, "e164").select("cc", "nsn", "key", "n")


_EVENT_NUMBERS = synthetic.sql("events", "event_id")


@query(f"""WITH {_EVENT_NUMBERS}, e AS (SELECT user_id, ts, '+' || cc || nsn AS e164 FROM events JOIN numbers ON key = event_id)
SELECT user_id, ts, e164 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, e164 DESC) AS r FROM e) WHERE r = 1""")
def latest_number_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = synthetic.from_key(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id")
    e = O.with_nsn(e).select("user_id", "ts", N.e164(F.col("cc"), F.col("nsn")).alias("e164"))
    return O.latest_by_user(e, "user_id", "ts")


_PREFIXES = (("1", "North America"), ("1650", "Palo Alto"), ("44", "Britain"), ("4420", "London"), ("447", "British mobile"), ("549", "Argentine mobile"), ("39", "Italy"), ("262", "Indian Ocean"))


@query(f"""WITH {_NUMBERS}, pre(prefix, name) AS (VALUES {', '.join(f"('{p}', '{n}')" for p, n in _PREFIXES)}),
d AS (SELECT key, cc || nsn AS digits FROM numbers)
SELECT key, digits, max_by(name, length(prefix)) AS name FROM d LEFT JOIN pre ON starts_with(digits, prefix) GROUP BY 1, 2""")
def longest_prefix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.with_nsn(_customers(spark, sf_dir)).select("key", F.concat(F.col("cc").cast("string"), F.col("nsn")).alias("digits"))
    return O.longest_prefix(d, "digits", F.broadcast(spark.createDataFrame(list(_PREFIXES), "prefix string, name string")))


# --- plan lookups


@query(f"WITH {Q.regions()} SELECT nk AS n_nationkey, coalesce((SELECT region FROM plan WHERE cc = code AND rank = 0), 'ZZ') AS region, code FROM (SELECT n_nationkey AS nk, n_nationkey * 11 + 1 AS code FROM nation)")
def region_for_country_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 11 + 1).alias("code"))
    main = F.broadcast(tables.regions(spark, default_plan()).where("rank = 0").select(F.col("cc").alias("code"), "region"))
    return n.join(main, "code", "left").select("n_nationkey", F.coalesce("region", F.lit("ZZ")).alias("region"), "code")


@query(f"WITH {Q.regions()} SELECT cc, string_agg(region, ',' ORDER BY rank) AS regions, bool_or(region = '001') AS non_geo FROM plan GROUP BY cc")
def regions_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.regions(spark, default_plan()).groupBy("cc").agg(F.sort_array(F.collect_list(F.struct("rank", "region"))).alias("x"), F.bool_or("is_non_geo").alias("non_geo"))
    return r.select("cc", F.array_join(F.transform("x", lambda s: s["region"]), ",").alias("regions"), "non_geo")


@query(f"WITH {Q.regions()} SELECT region, cc, cc = 1 AS nanpa, replace(coalesce(national_prefix, ''), '~', '') AS ndd FROM plan WHERE region <> '001'")
def supported_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.regions(spark, default_plan()).where("not is_non_geo")
    return r.select("region", "cc", (F.col("cc") == 1).alias("nanpa"), F.regexp_replace(F.coalesce("national_prefix", F.lit("")), "~", "").alias("ndd"))


@query(f"WITH {Q.regions()} SELECT cc, min(region) = '001' AS global_network FROM plan GROUP BY cc")
def supported_calling_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.regions(spark, default_plan()).groupBy("cc").agg((F.min("region") == "001").alias("global_network"))


@query(f"WITH {Q.types()} SELECT region, cc, type FROM types WHERE example IS NOT NULL OR pattern IS NOT NULL OR lengths <> [-1]")
def supported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.type_rows(spark, default_plan()).where("has_data").select("region", "cc", "type")


@query(f"WITH {_NUMBERS} SELECT key, cc IN ({', '.join(map(str, default_plan().by_code))}) AS known FROM numbers")
def has_valid_country_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.broadcast(tables.regions(spark, default_plan()).select("cc").distinct().withColumn("known", F.lit(True)))
    return _customers(spark, sf_dir).join(known, "cc", "left").select("key", F.coalesce("known", F.lit(False)).alias("known"))


@query()
def mobile_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return c.select("key", "cc", F.when(F.col("cc") == 54, "9").alias("token"))


ORACLES["mobile_tokens"] = f"WITH {_NUMBERS} SELECT key, cc, CASE WHEN cc = 54 THEN '9' END AS token FROM numbers"


# --- vectorized: parsing and the formats that need the whole record


def _parsed(spark: SparkSession, sf_dir: str, keep_raw: bool = False) -> DataFrame:
    return O.parse_column(_texts(spark, sf_dir), "raw", "region", keep_raw=keep_raw)


_PARSED = f"{_RAW}, {Q.regions_for_parsing()}, {Q.parsed('written')}"


@query(f"WITH {_PARSED} SELECT key, cc AS country_code, n AS national_number FROM parsed WHERE origin IN ('FROM_NUMBER_WITH_PLUS_SIGN', 'FROM_NUMBER_WITH_IDD')")
def parse_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all customers that turn out to be dialled with a calling code."""
    p = F.col("parsed.phone")
    t = _parsed(spark, sf_dir, True).where(p["country_code_source"].isin("FROM_NUMBER_WITH_PLUS_SIGN", "FROM_NUMBER_WITH_IDD"))
    return t.select("key", p["country_code"].alias("country_code"), p["national_number"].alias("national_number"))


@query(f"WITH {_PARSED} SELECT key, raw, region, error IS NULL AS ok, error, error_detail, cc AS country_code, n AS national_number, ext AS extension, zero AS italian_leading_zero FROM parsed")
def parse_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("key", "raw", "region", "parsed.ok", "parsed.error", "parsed.error_detail", "parsed.phone.country_code", "parsed.phone.national_number", "parsed.phone.extension", "parsed.phone.italian_leading_zero")


@query(f"WITH {_PARSED} SELECT key, CASE WHEN error IS NULL THEN raw END AS raw_input, origin AS country_code_source, carrier AS preferred_domestic_carrier_code, zeros AS number_of_leading_zeros FROM parsed")
def parse_keep_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "parsed.phone"
    return _parsed(spark, sf_dir, True).select("key", f"{p}.raw_input", f"{p}.country_code_source", f"{p}.preferred_domestic_carrier_code", f"{p}.number_of_leading_zeros")


_PHONES = f"{_PARSED}, phones AS (SELECT * FROM parsed WHERE error IS NULL)"
_PHONE_CLASS = f"{_PHONES}, {Q.regions()}, {Q.classified('phones')}, {Q.formats()}"
_CALLER = "CASE key % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'AU' WHEN 2 THEN 'MX' WHEN 3 THEN 'UZ' ELSE 'ZZ' END"
_DIALLED = f"{_PHONE_CLASS}, dialling AS (SELECT *, {_CALLER} AS caller FROM phones), {Q.formatted('dialling')}, {Q.callers()}, {Q.abroad()}"


def _phones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """(key, p: the parsed number with its raw text) of all texts that are numbers; its caller."""
    caller = F.get(F.array(*map(F.lit, ("US", "AU", "MX", "UZ", "ZZ"))), F.pmod(F.col("key"), F.lit(5)).cast("int"))
    return _parsed(spark, sf_dir, True).select("key", F.col("parsed.phone").alias("p")).where("p is not null"), caller


@query(f"WITH {_PHONE_CLASS}, {Q.formatted('phones')} SELECT key, e164, international_format AS international, national_format AS national, rfc3966_format AS rfc3966 FROM formatted")
def parsed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _phones(spark, sf_dir)
    return p.select("key", *(V.format(F.col("p"), k).alias(k.lower()) for k in O.KINDS))


@query(f"WITH {_PHONE_CLASS}, {Q.formatted('phones')} SELECT key, by_carrier || label AS carrier, CASE WHEN formatted.carrier IS NULL THEN by_carrier || label END AS preferred FROM formatted")
def carrier_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a given carrier code, and with the number's own where it has none of its own."""
    p, _ = _phones(spark, sf_dir)
    own = F.col("p.preferred_domestic_carrier_code").isNull()
    return p.select("key", V.format_with_carrier(F.col("p"), F.lit(Q.CARRIER)).alias("carrier"), F.when(own, V.format_with_carrier(F.col("p"), F.lit(Q.CARRIER), preferred=True)).alias("preferred"))


@query(f"WITH {_DIALLED} SELECT key, caller, abroad, mobile FROM mobile")
def formats_for_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dialled from another region, and as dialled with a mobile there."""
    p, caller = _phones(spark, sf_dir)
    return p.select("key", caller.alias("caller"), V.format_abroad(F.col("p"), caller).alias("abroad"), V.format_for_mobile(F.col("p"), caller).alias("mobile"))


_OWN_FORMAT = NumberFormat(r"(\d{3})(\d{3})(\d{4})", "$1 $2-$3", national_prefix_rule="$NP ($FG)")


@query(rf"""WITH {_FORMATS}, own AS (SELECT f.*, p.national_prefix AS np, regexp_full_match(nsn, '\d{{10}}') AS fits FROM formatted f LEFT JOIN plan p ON p.cc = f.cc AND rank = 0)
SELECT key, CASE WHEN NOT known THEN nsn WHEN fits THEN CASE WHEN np IS NULL THEN regexp_replace(nsn, '(...)(...)(....)', '\1 \2-\3') ELSE np || ' ' || regexp_replace(nsn, '(...)(...)(....)', '(\1) \2-\3') END || label ELSE nsn || label END AS national,
CASE WHEN NOT known THEN nsn ELSE '+' || cc || ' ' || CASE WHEN fits THEN regexp_replace(nsn, '(...)(...)(....)', '\1 \2-\3') ELSE nsn END || label END AS international FROM own""".replace("WITH ", f"WITH {Q.regions()}, ", 1))
def formats_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' numbers by a format of the caller's."""
    p = O.phones(_customers(spark, sf_dir))
    return p.select("key", V.format_by_pattern(F.col("phone"), "NATIONAL", [_OWN_FORMAT]).alias("national"), V.format_by_pattern(F.col("phone"), "INTERNATIONAL", [_OWN_FORMAT]).alias("international"))


_BARE = "regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')"
_AGAIN = f"""ndd0 AS (SELECT p.key, mp.main AS region, substr({_BARE}, 1 + length(pre)) AS raw, mp.cc AS cc0 FROM phones p JOIN mp ON mp.cc = p.cc JOIN (SELECT cc AS pcc, replace(coalesce(national_prefix, ''), '~', '') AS pre FROM plan WHERE rank = 0 AND region <> '001') ON pcc = p.cc
  WHERE starts_with({_BARE}, pre)), {Q.parsed('ndd0', 'again0')}, again1 AS (SELECT * FROM again0 WHERE error IS NULL)"""


@query(f"WITH {_DIALLED}, {_AGAIN}, {Q.classified('again1', 'again_')}, again AS (SELECT key, number_type <> 'UNKNOWN' AS ok FROM again_classified), {Q.original()} SELECT key, original FROM original")
def original_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, caller = _phones(spark, sf_dir)
    return p.select("key", V.format_original(F.col("p"), caller).alias("original"))


@query(f"WITH {_DIALLED}, {Q.lettered()} SELECT key, abroad_letters FROM lettered")
def formats_keeping_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, caller = _phones(spark, sf_dir)
    return p.select("key", V.format_abroad_keeping_letters(F.col("p"), caller).alias("abroad_letters"))


@query(f"""WITH {_PHONE_CLASS}, {Q.formatted('phones')}, {Q.area_codes()}, us AS (SELECT key, bool_or(t <> 'UNKNOWN') AS us FROM typed WHERE preg = 'US' GROUP BY key)
SELECT key, a.number_region, a.number_type, a.number_type <> 'UNKNOWN' AS is_valid, coalesce(us, false) AS is_valid_us, area_code_length, ndc_length FROM areas a LEFT JOIN us USING (key)""")
def parsed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir).select("key", F.col("parsed.phone").alias("p")).where("p is not null")
    n = F.col("p")
    return p.select("key", V.region(n).alias("number_region"), V.number_type(n).alias("number_type"), V.is_valid(n).alias("is_valid"), V.is_valid_for_region(n, F.lit("US")).alias("is_valid_us"), V.area_code_length(n).alias("area_code_length"), V.destination_code_length(n).alias("ndc_length"))


@query(f"WITH {_PHONES}, {Q.codes()}, {Q.reason('phones', 'general')} SELECT key, coalesce(reason IN ('IS_POSSIBLE', 'IS_POSSIBLE_LOCAL_ONLY'), false) AS possible FROM written LEFT JOIN reasons USING (key)")
def possible_for_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("key", V.is_possible_text(F.col("raw"), F.col("region")).alias("possible"))


_TEMPLATES = [(cc, i, f.format, f.national_prefix_rule or "") for cc in default_plan().by_code for i, f in enumerate(default_plan().main_record(cc).formats)]


@query(rf"""WITH {Q.values('t', 'cc, place, template, rule', _TEMPLATES)} SELECT cc, place, template,
regexp_full_match(template, '[-x ()./~]*\$1[-x ()./~]*(\$[0-9][-x ()./~]*)*') AS as_you_type, regexp_full_match(rule, '(\(?\$1\)?)?') AS first_group_only FROM t""")
def format_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's national templates: fit for as-you-type formatting, rule of the first group only."""
    t = spark.createDataFrame(_TEMPLATES, "cc int, place int, template string, rule string")
    only = F.col("rule").rlike(r"^(\(?\$1\)?)?\z")
    return t.select("cc", "place", "template", F.col("template").rlike(rf"^(?:{T.AS_YOU_TYPE.pattern})\z").alias("as_you_type"), only.alias("first_group_only"))


_CUTS = "c.cc, c.zero, (c.national_number * 100 + 1) // CAST(10 ** k AS BIGINT) AS n"


@query(f"""WITH {_NUMBERS}, cuts AS (SELECT c.key * 100 + k AS key, k, c.key AS own, {_CUTS}, (CASE WHEN c.zero THEN '0' ELSE '' END) || CAST((c.national_number * 100 + 1) // CAST(10 ** k AS BIGINT) AS VARCHAR) AS nsn FROM numbers c, range(0, 18) AS r(k)),
{Q.regions()}, {Q.classified('cuts')}, {Q.codes()}, {Q.reason('cuts', 'general')},
j AS (SELECT own, k, cuts.cc, n, number_type <> 'UNKNOWN' AS ok, k > 0 AND (n = 0 OR reason = 'TOO_SHORT') AS ends FROM cuts JOIN classified USING (key) JOIN reasons USING (key)),
f AS (SELECT own, min(k) FILTER (ok) AS good, min(k) FILTER (ends) AS stop FROM j GROUP BY own)
SELECT f.own AS key, j.cc AS country_code, j.n AS national_number FROM f LEFT JOIN j ON j.own = f.own AND k = good AND good < coalesce(stop, 99)""")
def truncate_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    fields = [F.col("cc").alias("country_code"), (F.col("national_number") * 100 + 1).alias("national_number"), F.lit(None).cast("string").alias("extension"), F.col("zero").alias("italian_leading_zero"), F.col("zeros").alias("number_of_leading_zeros")]
    blank = [F.lit(None).cast("string").alias(k) for k in ("raw_input", "country_code_source", "preferred_domestic_carrier_code")]
    t = c.select("key", V.truncate(F.struct(*fields, *blank)).alias("t"))
    return t.select("key", "t.country_code", "t.national_number")


_WRITTEN_PAIRS = f"""{_RAW}, {Q.regions_for_parsing()}, p1 AS (SELECT key, raw, 'ZZ' AS region FROM written), p2 AS (SELECT key, '+' || cc || ' ' || national_number AS raw, 'ZZ' AS region FROM written),
{Q.parsed('p1', 'one')}, {Q.parsed('p2', 'two')}, p3 AS (SELECT key, one.raw, mp.main AS region FROM one JOIN two USING (key) JOIN mp ON mp.cc = two.cc), {Q.parsed('p3', 'here')},
p4 AS (SELECT key, raw, region FROM written), {Q.parsed('p4', 'own')}"""


@query(f"""WITH {_WRITTEN_PAIRS} SELECT key, CASE WHEN one.error IS NULL AND two.error IS NULL THEN {Q.match('one', 'two')}
WHEN one.error = 'INVALID_COUNTRY_CODE' AND two.error IS NULL AND here.error IS NULL THEN replace({Q.match('two', 'here')}, 'EXACT', 'NSN') END AS match
FROM one JOIN two USING (key) LEFT JOIN here USING (key)""")
def match_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _written_pairs(spark, sf_dir)
    return t.select("key", V.match_texts(F.col("raw"), F.col("other")).alias("match"))


@query(f"WITH {_WRITTEN_PAIRS} SELECT key, CASE WHEN own.error IS NULL AND two.error IS NULL THEN {Q.match('own', 'two')} END AS match FROM own JOIN two USING (key)")
def match_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed number against a text."""
    t = O.parse_column(_written_pairs(spark, sf_dir), "raw", "region")
    return t.select("key", V.match_text(F.col("parsed.phone"), F.col("other")).alias("match"))


def _written_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("other", F.concat(F.lit("+"), F.col("cc").cast("string"), F.lit(" "), F.col("national_number").cast("string")))


_EXAMPLES = f"""{Q.types()}, {Q.regions_for_parsing()}, {Q.regions()},
given AS (SELECT row_number() OVER (ORDER BY region, cc, type) AS key, region AS home, cc AS own, type, CASE WHEN region = '001' THEN '+' || cc || example ELSE example END AS raw, CASE WHEN region = '001' THEN 'ZZ' ELSE region END AS region FROM types),
{Q.parsed('given')}, ex AS (SELECT g.home, g.own, g.type, g.raw, p.* EXCLUDE (raw, region) FROM given g JOIN parsed p USING (key))"""


@query(f"""WITH {_EXAMPLES}, short AS (SELECT key * 100 + k AS key, home AS region, left(raw, k) AS raw, home, k FROM ex, range(2, 18) AS r(k) WHERE type = 'FIXED_LINE' AND home <> '001' AND k < length(raw)),
{Q.parsed('short', 'cut')}, tried AS (SELECT * FROM cut WHERE error IS NULL), {Q.classified('tried')},
bad AS (SELECT home, arg_max(n, k) AS invalid_number FROM short JOIN tried USING (key) JOIN classified c USING (key) WHERE number_type = 'UNKNOWN' GROUP BY home)
SELECT home AS region, type, cc AS country_code, n AS national_number, invalid_number FROM ex LEFT JOIN bad USING (home) WHERE home <> '001'""")
def example_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.type_rows(spark, default_plan()).where("region <> '001'").select("region", "type", V.example(F.col("region"), F.col("type")).alias("p"), V.invalid_example(F.col("region")).alias("bad"))
    return t.select("region", "type", F.col("p.country_code"), F.col("p.national_number"), F.col("bad.national_number").alias("invalid_number"))


@query(f"""WITH {_EXAMPLES} SELECT type, arg_min(cc, (CASE WHEN home = '001' THEN own::VARCHAR ELSE '' END, home)) FILTER (error IS NULL) AS country_code,
arg_min(n, (CASE WHEN home = '001' THEN own::VARCHAR ELSE '' END, home)) FILTER (error IS NULL) AS national_number FROM ex GROUP BY type""")
def example_numbers_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.type_rows(spark, default_plan()).select("type").distinct().select("type", V.example_of_type(F.col("type")).alias("p"))
    return t.select("type", F.col("p.country_code"), F.col("p.national_number"))


@query(f"""WITH {_EXAMPLES} SELECT own AS cc, arg_min(n, list_position(['MOBILE', 'TOLL_FREE', 'SHARED_COST', 'VOIP', 'VOICEMAIL', 'UAN', 'PREMIUM_RATE'], type)) FILTER (raw IS NOT NULL AND type NOT IN ('FIXED_LINE', 'PERSONAL_NUMBER', 'PAGER')) AS national_number
FROM ex WHERE home = '001' GROUP BY own""")
def example_numbers_non_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.regions(spark, default_plan()).where("is_non_geo").select("cc", V.example_non_geo(F.col("cc")).alias("p"))
    return t.select("cc", F.col("p.national_number"))
