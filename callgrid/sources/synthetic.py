"""Numbers made from whole-number keys by arithmetic that every SQL engine does alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Region, calling code, first national number, how many, leading zero?
SLOTS = (
    ("US", 1, 6502530000, 10000, False), ("US", 1, 8002530000, 10000, False), ("US", 1, 9002530000, 10000, False), ("BS", 1, 2423650000, 10000, False),
    ("CA", 1, 2046650000, 10000, False), ("GB", 44, 2070310000, 10000, False), ("GB", 44, 7912340000, 10000, False), ("GB", 44, 8431230000, 10000, False),
    ("GB", 44, 5631231000, 1000, False), ("GB", 44, 7031231000, 1000, False), ("DE", 49, 301234, 800, False), ("DE", 49, 1761234000, 1000, False),
    ("IT", 39, 236618000, 1000, True), ("IT", 39, 345678000, 1000, False), ("AR", 54, 1187654000, 1000, False), ("AR", 54, 91187654000, 1000, False),
    ("AU", 61, 236618000, 1000, False), ("AU", 61, 1800123000, 1000, False), ("NZ", 64, 33316000, 1000, False), ("NZ", 64, 21387800, 100, False),
    ("MX", 52, 2234567000, 1000, False), ("MX", 52, 13312345000, 1000, False), ("SG", 65, 65218000, 1000, False), ("CN", 86, 18912341000, 1000, False),
    ("RE", 262, 262161000, 1000, False), ("YT", 262, 269601000, 1000, False), ("YT", 262, 639012000, 1000, False), ("RE", 262, 800123000, 1000, False),
    ("001", 800, 12345000, 1000, False), ("001", 979, 123456000, 1000, False), ("US", 1, 2530000, 1000, False), ("US", 1, 253000, 100, False),
    ("US", 1, 65025300000, 1000, False), ("TA", 290, 12340, 10, False), ("ZZ", 999, 2423651000, 100, False), ("ZZ", 0, 33316000, 100, False),
    ("JP", 81, 2345, 10, False), ("KR", 82, 212345678, 1000, False), ("FR", 33, 3012345, 100, False), ("AD", 376, 123000, 1000, False),
)
ODD = 7919


def from_key(df: DataFrame, key: str) -> DataFrame:
    """df with region, cc, national_number, zero (leading zero), zeros, ext of each key."""
    slot = F.pmod(F.col(key), F.lit(len(SLOTS))).cast("int")
    pick = lambda i, kind: F.get(F.array(*(F.lit(s[i]).cast(kind) for s in SLOTS)), slot)
    number = pick(2, "bigint") + F.pmod(F.col(key) * ODD, pick(3, "bigint"))
    return df.select(
        "*", pick(0, "string").alias("region"), pick(1, "int").alias("cc"), number.alias("national_number"), pick(4, "boolean").alias("zero"),
        F.lit(None).cast("int").alias("zeros"), F.when(F.pmod(F.col(key), F.lit(11)) == 3, F.pmod(F.col(key), F.lit(1000)).cast("string")).alias("ext"),
    )


def sql(table: str, key: str) -> str:
    """The same rows in DuckDB: key, region, cc, national_number, zero, ext, nsn."""
    values = ", ".join(f"({i}, '{r}', {cc}, {base}, {n}, {str(z).lower()})" for i, (r, cc, base, n, z) in enumerate(SLOTS))
    return f"""slots(slot, region, cc, base, n, zero) AS (VALUES {values}),
numbers AS (SELECT {key} AS key, region, CAST(cc AS INTEGER) AS cc, CAST(base AS BIGINT) + ({key} * {ODD}) % n AS national_number, zero,
  CASE WHEN {key} % 11 = 3 THEN CAST({key} % 1000 AS VARCHAR) END AS ext,
  (CASE WHEN zero THEN '0' ELSE '' END) || CAST(CAST(base AS BIGINT) + ({key} * {ODD}) % n AS VARCHAR) AS nsn
  FROM {table} JOIN slots ON slot = {key} % {len(SLOTS)})"""


def written(df: DataFrame, key: str) -> DataFrame:
    """Texts as people write them, by turns: international, national with punctuation, with
    letters, with an extension, full-width digits, with junk around, or no number at all."""
    n = F.col("national_number").cast("string")
    n = F.concat(F.when(F.col("zero"), "0").otherwise(""), n)
    cc = F.col("cc").cast("string")
    spaced = F.regexp_replace(n, r"(\d{3})(?=\d)", "$1 ")
    styles: list[Column] = [
        F.concat(F.lit("+"), cc, n), F.concat(F.lit("+"), cc, F.lit(" ("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 20)), n, F.concat(F.lit("0"), spaced),
        F.concat(F.lit("tel:+"), cc, F.lit("-"), n, F.lit(";ext=12")), F.concat(F.lit("call "), spaced, F.lit(" ext. 345 now")), F.translate(F.concat(F.lit("+"), cc, n), "0123456789", "０１２３４５６７８９"),
        F.concat(F.lit("1-800-FLOWERS "), F.substring(n, 1, 1)), F.lit("no number here"), F.concat(F.lit("00"), cc, n), F.concat(F.lit("011 "), cc, F.lit(" "), spaced), F.lit(None).cast("string"),
    ]
    return df.withColumn("raw", F.get(F.array(*styles), F.pmod(F.col(key), F.lit(len(styles))).cast("int")))
