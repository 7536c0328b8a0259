"""The dial plan as small DataFrames: dimensions that queries join by broadcast.

Their size depends on the plan alone (tens of records here, a few hundred at most), never
on the numbers that are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgrid.plans.loader import SPECIAL_TYPES, TYPES, WORLD, NumberFormat, Plan, Record

#: The descriptions that classification reads.
KINDS = ("general", *SPECIAL_TYPES, "fixed_line", "mobile", "no_international_dialling")

_FORMAT = "struct<leading: string, whole: string, pattern: string, national: string, plain: string>"
CODES = (
    f"cc int, main_region string, national array<{_FORMAT}>, intl array<{_FORMAT}>, extn string, "
    "lengths map<string, array<int>>, locals map<string, array<int>>"
)
REGIONS = "region string, cc int, rank int, is_main boolean, is_non_geo boolean, national_prefix string, international_prefix string, leading_digits string"
TYPE_ROWS = "region string, cc int, type string, pattern string, lengths array<int>, local_lengths array<int>, example string, has_data boolean"


def whole(pattern: str) -> str:
    """The expression for Java that matches a whole string."""
    return f"^(?:{pattern})\\z"


def start(pattern: str | None) -> str | None:
    return None if pattern is None else f"^(?:{pattern})"


def _format(f: NumberFormat) -> tuple:
    return (start(f.leading_digits[-1]) if f.leading_digits else None, whole(f.pattern), f.pattern, f.national_template, f.format)


def codes(spark: SparkSession, plan: Plan) -> DataFrame:
    """One row for each calling code: its main region's formats and lengths."""
    rows = []
    for cc, ids in plan.by_code.items():
        main = plan.main_record(cc)
        lengths = {k: list(main.lengths(k)) for k in ("general", *TYPES)}
        local = {k: list(main.desc(k).local_lengths) for k in ("general", *TYPES)}
        rows.append((cc, ids[0], list(map(_format, main.formats)), list(map(_format, main.intl_formats or main.formats)), main.preferred_extn_prefix, lengths, local))
    return spark.createDataFrame(rows, CODES)


def regions(spark: SparkSession, plan: Plan) -> DataFrame:
    """One row for each record, with its rank among those of its calling code."""
    rows = []
    for cc, ids in plan.by_code.items():
        for rank, i in enumerate(ids):
            r = plan.record_of(cc, i)
            rows.append((i, cc, rank, rank == 0, i == WORLD, r.national_prefix, r.international_prefix, r.leading_digits))
    return spark.createDataFrame(rows, REGIONS)


def type_rows(spark: SparkSession, plan: Plan) -> DataFrame:
    """One row for each record and type."""
    rows = []
    for r in plan.records:
        for k in TYPES:
            d = r.desc(k)
            rows.append((r.id, r.country_code, k.upper(), d.pattern, list(d.lengths), list(d.local_lengths), d.example, d.has_data))
    return spark.createDataFrame(rows, TYPE_ROWS)
