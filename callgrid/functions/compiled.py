"""The dial plan compiled into expressions with literal patterns.

A pattern that comes from a joined column is compiled anew for nearly every row, since
neighbouring rows belong to different plans; literal patterns are compiled once. So plans
of up to MOST_PATTERNS patterns become one CASE over the calling code. With larger plans formats
use the joined form in `native`, whose expressions don't grow with the dial plan, and classes the
Arrow function in `vectorized`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.plans.loader import SPECIAL_TYPES, WORLD, Desc, Plan, Record
from callgrid.plans.tables import start, whole

MOST_PATTERNS = 800


def fits(plan: Plan) -> bool:
    """Whether the plan is small enough for this form."""
    return sum(1 for r in plan.records for d in r.descs.values() if d.pattern) + sum(2 * len(r.formats) + 2 * len(r.intl_formats) for r in plan.records) <= MOST_PATTERNS


def _holds(nsn: Column, d: Desc) -> Column | None:
    """None where no number can match."""
    if not d.pattern:
        return None
    match = nsn.rlike(whole(d.pattern))
    return F.length(nsn).isin(*d.lengths) & match if d.lengths else match


def _type(nsn: Column, r: Record) -> Column:
    general, mobile, fixed = (_holds(nsn, r.desc(k)) for k in ("general", "mobile", "fixed_line"))
    if general is None:
        return F.lit("UNKNOWN")
    out = F.when(~general, "UNKNOWN")
    for k in SPECIAL_TYPES:
        if (c := _holds(nsn, r.desc(k))) is not None:
            out = out.when(c, k.upper())
    if fixed is not None:
        both = F.lit("FIXED_LINE_OR_MOBILE")
        out = out.when(fixed, both if r.same_mobile_and_fixed_line_pattern else F.when(mobile, both).otherwise("FIXED_LINE") if mobile is not None else F.lit("FIXED_LINE"))
    if mobile is not None and not r.same_mobile_and_fixed_line_pattern:
        out = out.when(mobile, "MOBILE")
    return out.otherwise("UNKNOWN")


def _by_code(cc: Column, found: dict[int, Column]) -> Column:
    """The expression of the calling code, found by halving; null for codes that aren't there."""
    codes = sorted(found)
    if len(codes) == 1:
        return F.when(cc == codes[0], found[codes[0]])
    half = len(codes) // 2
    return F.when(cc < codes[half], _by_code(cc, {c: found[c] for c in codes[:half]})).otherwise(_by_code(cc, {c: found[c] for c in codes[half:]}))


def _interpreted(cc: Column, out: Column) -> Column:
    """`out`, evaluated outside whole-stage code: a higher-order function makes the projection leave
    that, and Spark splits the CASE into methods small enough to be optimized."""
    return F.when(F.exists(F.array(cc), lambda c: c.isNotNull()), out)


def _claim(nsn: Column, r: Record, only: bool) -> Column:
    """The struct of a region where it claims the number; its type is worked out once."""
    barred = _holds(nsn, r.desc("no_international_dialling")) if r.id != WORLD else None
    fields = lambda kind: F.struct(F.lit(r.id).alias("region"), kind.alias("type"), F.lit(False).alias("barred") if barred is None else barred.alias("barred"), F.lit(r.national_prefix).cast("string").alias("national_prefix"))
    if only:
        return fields(_type(nsn, r))
    lead = nsn.rlike(start(r.leading_digits)) if r.leading_digits is not None else F.lit(False)
    return F.get(F.transform(F.array(_type(nsn, r)), lambda kind: F.when(lead | (kind != "UNKNOWN"), fields(kind))), F.lit(0))


def classified(cc: Column, nsn: Column, plan: Plan) -> Column:
    """struct(region, type, barred, national_prefix): null where no region claims the number."""
    found = {code: F.coalesce(*(_claim(nsn, plan.record_of(code, i), len(ids) == 1) for i in ids)) for code, ids in plan.by_code.items()}
    return _interpreted(cc, _by_code(cc, found))


def valid_in(cc: Column, nsn: Column, region: Column, plan: Plan) -> Column:
    """Whether a number is valid in a region, be it its own or not."""

    def inside(code: int, ids: list[str]) -> Column:
        return F.coalesce(*(F.when(region == i, _type(nsn, plan.record_of(code, i)) != "UNKNOWN") for i in ids), F.lit(False))

    return F.coalesce(_interpreted(cc, _by_code(cc, {code: inside(code, ids) for code, ids in plan.by_code.items()})), F.lit(False))


def _written(nsn: Column, formats, template: str) -> Column:
    """The number by the first format that applies; as it is if none does."""
    out = F.when(F.lit(False), nsn)
    for f in formats:
        c = nsn.rlike(whole(f.pattern))
        out = out.when(nsn.rlike(start(f.leading_digits[-1])) & c if f.leading_digits else c, F.regexp_replace(nsn, f.pattern, getattr(f, template)))
    return out.otherwise(nsn)


def national_body(cc: Column, nsn: Column, plan: Plan) -> Column:
    """The number as the code's main region writes it; null for an unknown code."""
    return _interpreted(cc, _by_code(cc, {c: _written(nsn, plan.main_record(c).formats, "national_template") for c in plan.by_code}))


def plain_body(cc: Column, nsn: Column, plan: Plan) -> Column:
    """The number by the international formats, or the national ones if there are none."""
    return _interpreted(cc, _by_code(cc, {c: _written(nsn, plan.main_record(c).intl_formats or plan.main_record(c).formats, "format") for c in plan.by_code}))
