"""Vectorized functions over Arrow batches, for what native expressions can't express.

Each is one pass over the different inputs of a batch: equal inputs are worked out once. A
text that isn't a number gives an error column, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from callgrid.functions import compiled
from callgrid.functions import native as N
from callgrid.kernel import text
from callgrid.kernel.phone import Phone, PhoneError, Phones
from callgrid.plans.loader import Plan, default_plan

PHONE = (
    "struct<country_code: int, national_number: bigint, extension: string, italian_leading_zero: boolean, number_of_leading_zeros: int, "
    "raw_input: string, country_code_source: string, preferred_domestic_carrier_code: string>"
)
PARSED = f"struct<ok: boolean, error: string, error_detail: string, phone: {PHONE}>"
FIELDS = tuple(Phone.__dataclass_fields__)


@cache
def _phones(path: str | None) -> Phones:
    """One set of operations for each worker and plan; None is the packaged plan."""
    return Phones(default_plan() if path is None else Plan.load(path))


@lru_cache(maxsize=4)
def _phones_of(blob: bytes) -> Phones:
    """One set of operations for each worker and plan that was sent along."""
    return Phones(Plan(json.loads(blob)))


CLASS = "struct<region: string, type: string, barred: boolean, national_prefix: string>"


def classified(cc: Column, nsn: Column, plan: Plan) -> Column:
    """The struct CLASS of a number: null where no region claims it. For plans with more patterns
    than expressions can hold: workers compile each pattern once, the JVM would at every change."""
    blob = plan.blob

    @F.arrow_udf(CLASS)
    def run(cc: pa.Array, nsn: pa.Array) -> pa.Array:
        ops, seen, out = _phones_of(blob), {}, []
        for key in zip(cc.to_pylist(), nsn.to_pylist(), strict=True):
            if key not in seen:
                seen[key] = None if None in key else ops.claim(*key)
            out.append(seen[key])
        cols = [pa.array([None if c is None else c[k] for c in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))]
        return pa.StructArray.from_arrays(cols, names=["region", "type", "barred", "national_prefix"], mask=pa.array([c is None for c in out], pa.bool_()))

    return run(cc, nsn)


def valid_in(cc: Column, nsn: Column, region: Column, plan: Plan) -> Column:
    """Whether a number is valid in a region, for plans of many patterns."""
    blob = plan.blob

    @F.arrow_udf("boolean")
    def run(cc: pa.Array, nsn: pa.Array, region: pa.Array) -> pa.Array:
        ops = _phones_of(blob)
        return pa.array([None not in key and ops.holds(*key) for key in zip(cc.to_pylist(), nsn.to_pylist(), region.to_pylist(), strict=True)], pa.bool_())

    return run(cc, nsn, region)


def _none(x):
    return None if x is None or x is pd.NA or isinstance(x, float) and x != x else x


def as_phone(row: dict | None) -> Phone | None:
    if row is None or _none(row.get("country_code")) is None or _none(row.get("national_number")) is None:
        return None
    got = {k: _none(row.get(k)) for k in FIELDS}
    for k in ("country_code", "national_number", "number_of_leading_zeros"):
        got[k] = None if got[k] is None else int(got[k])
    return Phone(**got)


def as_dict(p: Phone | None) -> dict | None:
    return None if p is None else {k: getattr(p, k) for k in FIELDS}


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES = dict(zip(FIELDS, map(_ARROW.get, ("int", "bigint", "string", "boolean", "int", "string", "string", "string")), strict=True))


def phone_array(phones: list[Phone | None]) -> pa.StructArray:
    """Phone structs, column by column."""
    cols = [pa.array([None if p is None else getattr(p, k) for p in phones], t) for k, t in _TYPES.items()]
    return pa.StructArray.from_arrays(cols, names=list(FIELDS), mask=pa.array([p is None for p in phones], pa.bool_()))


def parsed_array(found: list[tuple[Phone | None, str | None, str | None]]) -> pa.StructArray:
    """PARSED structs of (phone, error, detail)."""
    ok = pa.array([f[0] is not None for f in found], pa.bool_())
    error, detail = (pa.array([f[k] for f in found], pa.string()) for k in (1, 2))
    return pa.StructArray.from_arrays([ok, error, detail, phone_array([f[0] for f in found])], names=["ok", "error", "error_detail", "phone"])


def _parsed(plan: str | None, keep_raw: bool, check_region: bool) -> Callable:
    @F.arrow_udf(PARSED)
    def run(raw: pa.Array, region: pa.Array) -> pa.Array:
        parse, seen, out = _phones(plan).try_parse, {}, []
        for key in zip(raw.to_pylist(), region.to_pylist(), strict=True):
            got = seen.get(key)
            if got is None:
                got = seen[key] = parse(*key, keep_raw=keep_raw, check_region=check_region)
            out.append(got)
        return parsed_array(out)

    return run


def parse(raw: Column, region: Column, keep_raw: bool = False, check_region: bool = True, plan: str | None = None) -> Column:
    """The struct PARSED of a text dialled in a region."""
    return _parsed(plan, keep_raw, check_region)(raw, region)


def _frame(phones: pd.DataFrame) -> list[Phone | None]:
    return [as_phone(r) for r in phones.to_dict("records")]


def of_phone(call: Callable, returns: str, *args: Column, plan: str | None = None) -> Callable[[Column], Column]:
    """A function of a phone struct: call(ops, phone, *args) for each row.

    Null where the phone is null; where call raises PhoneError, null too."""

    def apply(phone: Column) -> Column:
        @F.pandas_udf(returns)
        def run(phones: pd.DataFrame, *more: pd.Series) -> pd.Series:
            ops, seen, out = _phones(plan), {}, []
            for key in zip(_frame(phones), *more, strict=True):
                if key not in seen:
                    try:
                        seen[key] = None if key[0] is None else call(ops, key[0], *map(_none, key[1:]))
                    except PhoneError:
                        seen[key] = None
                out.append(seen[key])
            return pd.Series(out, dtype=object)

        return run(phone, *args)

    return apply


def to_phone(call: Callable, *args: Column, plan: str | None = None) -> Column:
    """A phone struct from columns: call(ops, *args), which gives a Phone or None."""

    @F.pandas_udf(PHONE)
    def run(*cols: pd.Series) -> pd.DataFrame:
        ops, seen, out = _phones(plan), {}, []
        for key in zip(*cols, strict=True):
            if key not in seen:
                seen[key] = as_dict(call(ops, *map(_none, key))) or dict.fromkeys(FIELDS)
            out.append(seen[key])
        return pd.DataFrame(out, columns=list(FIELDS))

    return run(*args)


def format(phone: Column, kind: str, **how) -> Column:
    return of_phone(lambda o, p: o.format(p, kind), "string", **how)(phone)


def format_abroad(phone: Column, caller: Column, **how) -> Column:
    return of_phone(lambda o, p, c: o.format_abroad(p, c), "string", caller, **how)(phone)


def format_abroad_keeping_letters(phone: Column, caller: Column, **how) -> Column:
    return of_phone(lambda o, p, c: o.format_abroad_keeping_letters(p, c), "string", caller, **how)(phone)


def format_original(phone: Column, caller: Column, **how) -> Column:
    return of_phone(lambda o, p, c: o.format_original(p, c), "string", caller, **how)(phone)


def format_for_mobile(phone: Column, caller: Column, formatting: bool = True, **how) -> Column:
    return of_phone(lambda o, p, c: o.format_for_mobile(p, c, formatting), "string", caller, **how)(phone)


def format_with_carrier(phone: Column, carrier: Column, preferred: bool = False, **how) -> Column:
    """With preferred, the number's own carrier code comes before the given one."""
    if preferred:
        return of_phone(lambda o, p, c: o.format_with_preferred_carrier(p, c or ""), "string", carrier, **how)(phone)
    return of_phone(lambda o, p, c: o.format_with_carrier(p, c or ""), "string", carrier, **how)(phone)


def format_by_pattern(phone: Column, kind: str, formats, **how) -> Column:
    return of_phone(lambda o, p: o.format_by_pattern(p, kind, formats), "string", **how)(phone)


def _native(phone: Column, plan: str | None, make: Callable, otherwise: Callable) -> Column:
    """make(cc, nsn, plan) in the JVM, null where there is no number; with plans that are too large
    for that, otherwise()."""
    loaded = default_plan() if plan is None else Plan.load(plan)
    if not compiled.fits(loaded):
        return otherwise()
    cc, number = phone["country_code"], phone["national_number"]
    return F.when(cc.isNotNull() & number.isNotNull(), make(cc, N.nsn(number, phone["italian_leading_zero"], phone["number_of_leading_zeros"]), loaded))


def number_type(phone: Column, plan: str | None = None) -> Column:
    make = lambda cc, nsn, p: F.coalesce(compiled.classified(cc, nsn, p)["type"], F.lit("UNKNOWN"))
    return _native(phone, plan, make, lambda: of_phone(lambda o, p: o.type(p), "string", plan=plan)(phone))


def region(phone: Column, plan: str | None = None) -> Column:
    make = lambda cc, nsn, p: F.coalesce(compiled.classified(cc, nsn, p)["region"], F.lit("ZZ"))
    return _native(phone, plan, make, lambda: of_phone(lambda o, p: o.region(p), "string", plan=plan)(phone))


def is_valid(phone: Column, plan: str | None = None) -> Column:
    make = lambda cc, nsn, p: F.coalesce(compiled.classified(cc, nsn, p)["type"] != "UNKNOWN", F.lit(False))
    return _native(phone, plan, make, lambda: of_phone(lambda o, p: o.is_valid(p), "boolean", plan=plan)(phone))


def is_valid_for_region(phone: Column, region: Column, plan: str | None = None) -> Column:
    make = lambda cc, nsn, p: compiled.valid_in(cc, nsn, region, p)
    return _native(phone, plan, make, lambda: of_phone(lambda o, p, r: o.is_valid_for_region(p, r), "boolean", region, plan=plan)(phone))


def area_code_length(phone: Column, **how) -> Column:
    return of_phone(lambda o, p: o.area_code_length(p), "int", **how)(phone)


def destination_code_length(phone: Column, **how) -> Column:
    return of_phone(lambda o, p: o.destination_code_length(p), "int", **how)(phone)


def truncate(phone: Column, **how) -> Column:
    """The number cut to a valid one; null where no cut is valid."""
    return to_phone_of(lambda o, p: (q := o.truncate(p))[0] and q[1] or None, phone, **how)


def to_phone_of(call: Callable, phone: Column, plan: str | None = None) -> Column:
    @F.pandas_udf(PHONE)
    def run(phones: pd.DataFrame) -> pd.DataFrame:
        ops = _phones(plan)
        found = [None if p is None else call(ops, p) for p in _frame(phones)]
        return pd.DataFrame([as_dict(p) or dict.fromkeys(FIELDS) for p in found], columns=list(FIELDS))

    return run(phone)


def is_possible_text(raw: Column, region: Column, plan: str | None = None) -> Column:
    """Whether a text is a possible number; false where it is none."""

    @F.pandas_udf("boolean")
    def run(raw: pd.Series, region: pd.Series) -> pd.Series:
        ops = _phones(plan)
        return pd.Series([ops.is_possible_text(_none(x) or "", _none(r)) for x, r in zip(raw, region, strict=True)], dtype=bool)

    return run(raw, region)


def match_texts(a: Column, b: Column, plan: str | None = None) -> Column:
    """How alike two texts are as numbers; null where one isn't a number."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ops, out = _phones(plan), []
        for x, y in zip(a, b, strict=True):
            try:
                out.append(ops.match_texts(_none(x) or "", _none(y) or ""))
            except PhoneError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(a, b)


def match_text(phone: Column, other: Column, **how) -> Column:
    """How alike a number and a text are; null where the text isn't a number."""
    return of_phone(lambda o, p, t: o.match_text(p, t or ""), "string", other, **how)(phone)


def example(region: Column, kind: Column, **how) -> Column:
    return to_phone(lambda o, r, k: o.example(r, k), region, kind, **how)


def example_of_type(kind: Column, **how) -> Column:
    return to_phone(lambda o, k: o.example_of_type(k), kind, **how)


def example_non_geo(code: Column, **how) -> Column:
    return to_phone(lambda o, c: o.example_non_geo(int(c)), code, **how)


def invalid_example(region: Column, **how) -> Column:
    return to_phone(lambda o, r: o.invalid_example(r), region, **how)


#: SQL names on (text, region) and more columns: what to call and what it returns. Null where the
#: text isn't a number.
SQL_ON_TEXTS: dict[str, tuple[Callable, str]] = {
    "phone_e164": (lambda o, p: o.format(p, "E164"), "string"),
    "phone_format": (lambda o, p, kind: o.format(p, kind), "string"),
    "phone_format_abroad": (lambda o, p, caller: o.format_abroad(p, caller), "string"),
    "phone_format_abroad_keeping_letters": (lambda o, p, caller: o.format_abroad_keeping_letters(p, caller), "string"),
    "phone_format_original": (lambda o, p, caller: o.format_original(p, caller), "string"),
    "phone_format_for_mobile": (lambda o, p, caller: o.format_for_mobile(p, caller, True), "string"),
    "phone_format_with_carrier": (lambda o, p, carrier: o.format_with_carrier(p, carrier or ""), "string"),
    "phone_format_with_preferred_carrier": (lambda o, p, carrier: o.format_with_preferred_carrier(p, carrier or ""), "string"),
    "phone_national_number": (lambda o, p: p.nsn, "string"),
    "phone_extension": (lambda o, p: p.extension, "string"),
    "phone_country_code": (lambda o, p: p.country_code, "int"),
    "phone_region": (lambda o, p: o.region(p), "string"),
    "phone_type": (lambda o, p: o.type(p), "string"),
    "phone_is_valid": (lambda o, p: o.is_valid(p), "boolean"),
    "phone_is_valid_for_region": (lambda o, p, r: o.is_valid_for_region(p, r), "boolean"),
    "phone_is_possible": (lambda o, p: o.is_possible(p), "boolean"),
    "phone_possible_reason": (lambda o, p: o.possible(p), "string"),
    "phone_possible_reason_for_type": (lambda o, p, kind: o.possible(p, kind), "string"),
    "phone_is_geographical": (lambda o, p: o.is_geographical(p), "boolean"),
    "phone_can_be_dialled_abroad": (lambda o, p: o.can_be_dialled_abroad(p), "boolean"),
    "phone_area_code_length": (lambda o, p: o.area_code_length(p), "int"),
    "phone_destination_code_length": (lambda o, p: o.destination_code_length(p), "int"),
    "phone_truncated": (lambda o, p: (q := o.truncate(p))[0] and o.format(q[1], "E164") or None, "string"),
    "phone_has_format": (lambda o, p: o.has_format(p), "boolean"),
}
#: SQL names on other columns.
SQL_ON_VALUES: dict[str, tuple[Callable, str]] = {
    "phone_match": (lambda o, a, b: o.match_texts(a or "", b or ""), "string"),
    "phone_normalize": (lambda o, s: s if s is None else text.normalize(s), "string"),
    "phone_normalize_digits": (lambda o, s: s if s is None else text.digits_only(s), "string"),
    "phone_normalize_diallable": (lambda o, s: s if s is None else text.diallable_only(s), "string"),
    "phone_keypad": (lambda o, s: s if s is None else text.keypad(s), "string"),
    "phone_is_viable": (lambda o, s: None if s is None else text.is_viable(s), "boolean"),
    "phone_is_alpha": (lambda o, s: None if s is None else text.is_alpha_number(s), "boolean"),
    "phone_code_of_region": (lambda o, r: o.plan.regions[r].country_code if r in o.plan.regions else 0, "int"),
    "phone_national_prefix_of_region": (lambda o, r: o.ndd(r), "string"),
    "phone_region_of_code": (lambda o, c: o.plan.main_region(int(c)), "string"),
    "phone_example": (lambda o, r, kind: (p := o.example(r, kind)) and o.format(p, "E164"), "string"),
}


def register(spark: SparkSession, plan: str | None = None) -> None:
    """SQL names: phone_parse(text, region) and those of SQL_ON_TEXTS and SQL_ON_VALUES."""

    def of_text(call: Callable, returns: str):
        @F.pandas_udf(returns)
        def run(*cols: pd.Series) -> pd.Series:
            ops, out = _phones(plan), []
            for raw, where, *more in zip(*cols, strict=True):
                p, _, _ = ops.try_parse(_none(raw), _none(where), keep_raw=True)
                out.append(None if p is None else call(ops, p, *map(_none, more)))
            return pd.Series(out, dtype=object)

        return run

    def of_values(call: Callable, returns: str):
        @F.pandas_udf(returns)
        def run(*cols: pd.Series) -> pd.Series:
            ops, out = _phones(plan), []
            for row in zip(*cols, strict=True):
                try:
                    out.append(call(ops, *map(_none, row)))
                except PhoneError:
                    out.append(None)
            return pd.Series(out, dtype=object)

        return run

    spark.udf.register("phone_parse", _parsed(plan, False, True))
    for make, names in ((of_text, SQL_ON_TEXTS), (of_values, SQL_ON_VALUES)):
        for name, (call, returns) in names.items():
            spark.udf.register(name, make(call, returns))
