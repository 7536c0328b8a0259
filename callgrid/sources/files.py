"""Reading numbers and dimensions from files.

* text columns: numbers that stand in running text,
* prefix maps: lines ``prefix|name`` with ``#`` comments, for longest-prefix lookups,
* the ``;``-separated tables of a calling code, whose header differs from file to file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.functions import native

NORTH_AMERICAN = r"\+1 \(\d{3}\) \d{3}-\d{4}"


def numbers_in_text(text: Column, pattern: str = NORTH_AMERICAN) -> Column:
    """All matches of a number pattern in a text, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract_numbers(df: DataFrame, text: str, *keep: str, pattern: str = NORTH_AMERICAN) -> DataFrame:
    """keep, raw, e164: one row for each number in the text column."""
    raw = df.select(*keep, F.explode(numbers_in_text(F.col(text), pattern)).alias("raw"))
    return raw.withColumn("e164", F.concat(F.lit("+"), native.digits_only(F.col("raw"))))


def prefix_map(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, name) of a prefix map file or folder."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#') and instr(value, '|') > 0")
    return lines.select(F.trim(F.substring_index("value", "|", 1)).alias("prefix"), F.trim(F.expr("substr(value, instr(value, '|') + 1)")).alias("name"))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """A ``;``-separated table with quoted, space-padded cells; all columns are strings."""
    return spark.read.option("header", True).option("sep", ";").option("quote", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
