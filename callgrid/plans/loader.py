"""Loading a dial plan from JSON and preparing it for use.

A plan is a list of records, one for each region or non-geographic calling code ("001").
The packaged plan.json is fixed data: a small test plan, as rows. Loading checks every
expression once, so that no row can fail on a bad plan later, and works out what rows would
otherwise repeat: the regions of a calling code in order, the lengths a type inherits, and for
every number format the finished national template.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cache, cached_property
from pathlib import Path

WORLD = "001"
UNKNOWN_REGION = "ZZ"

#: The types in the order in which they are tried, before fixed line and mobile.
SPECIAL_TYPES = ("premium_rate", "toll_free", "shared_cost", "voip", "personal_number", "pager", "uan", "voicemail")
TYPES = ("fixed_line", "mobile", "toll_free", "premium_rate", "shared_cost", "voip", "personal_number", "pager", "uan", "voicemail")


@dataclass(frozen=True)
class Desc:
    """The numbers of one type: a pattern for the whole number and its lengths."""

    pattern: str | None = None
    lengths: tuple[int, ...] = ()
    local_lengths: tuple[int, ...] = ()
    example: str | None = None

    @cached_property
    def regex(self) -> re.Pattern | None:
        return re.compile(self.pattern) if self.pattern else None

    @property
    def exists(self) -> bool:
        """Whether numbers of this type can exist ([-1] says that they can't)."""
        return self.lengths != (-1,)

    @property
    def has_data(self) -> bool:
        return self.example is not None or self.exists or self.pattern is not None

    def fits(self, nsn: str) -> bool:
        """The whole number matches the pattern, whatever its length."""
        return self.regex is not None and self.regex.fullmatch(nsn) is not None

    def holds(self, nsn: str) -> bool:
        """Length first, then the pattern."""
        return (not self.lengths or len(nsn) in self.lengths) and self.fits(nsn)


def python_template(template: str) -> str:
    """`$1` templates as Python's re writes them."""
    return re.sub(r"\$(\d)", r"\\g<\1>", template.replace("\\", "\\\\"))


def with_rule(template: str, rule: str) -> str:
    """template whose first group is wrapped by a prefix rule such as `0$1`."""
    found = re.search(r"\$\d", template)
    if not found:
        return template
    return template[: found.start()] + rule.replace("$1", found[0]) + template[found.end() :]


@dataclass(frozen=True)
class NumberFormat:
    """How numbers of some leading digits and shape are written."""

    pattern: str
    format: str
    leading_digits: tuple[str, ...] = ()
    national_prefix_rule: str | None = None
    carrier_rule: str | None = None
    national_prefix_optional: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)

    @cached_property
    def last_leading(self) -> re.Pattern | None:
        """Only the last, most specific expression decides."""
        return re.compile(self.leading_digits[-1]) if self.leading_digits else None

    @cached_property
    def national_template(self) -> str:
        return with_rule(self.format, self.national_prefix_rule) if self.national_prefix_rule else self.format

    def carrier_template(self, carrier: str) -> str:
        return with_rule(self.format, self.carrier_rule.replace("$CC", carrier, 1))

    def applies(self, nsn: str) -> bool:
        return (self.last_leading is None or self.last_leading.match(nsn) is not None) and self.regex.fullmatch(nsn) is not None


@dataclass(frozen=True)
class Record:
    """The plan of a region or of a code without one. None: not given."""

    id: str
    country_code: int
    descs: dict[str, Desc]
    formats: tuple[NumberFormat, ...] = ()
    intl_formats: tuple[NumberFormat, ...] = ()
    international_prefix: str = ""
    preferred_international_prefix: str | None = None
    national_prefix: str | None = None
    preferred_extn_prefix: str | None = None
    national_prefix_for_parsing: str = ""
    national_prefix_transform_rule: str = ""
    leading_digits: str | None = None
    same_mobile_and_fixed_line_pattern: bool = False
    main_country_for_code: bool = False
    mobile_number_portable_region: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def general(self) -> Desc:
        return self.descs["general"]

    def desc(self, kind: str) -> Desc:
        return self.descs.get(kind, _NOTHING)

    def lengths(self, kind: str) -> tuple[int, ...]:
        """A type's own lengths, else those of the general description."""
        return self.desc(kind).lengths or self.general.lengths

    @cached_property
    def idd_regex(self) -> re.Pattern:
        return re.compile(self.international_prefix)

    @cached_property
    def prefix_regex(self) -> re.Pattern:
        return re.compile(self.national_prefix_for_parsing)

    @cached_property
    def leading_regex(self) -> re.Pattern | None:
        return re.compile(self.leading_digits) if self.leading_digits is not None else None


_NOTHING = Desc()


class Plan:
    """All records and the indexes over them."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.records = [self._record(r) for r in rows]
        self.regions = {r.id: r for r in self.records if r.id not in (WORLD, UNKNOWN_REGION)}
        self.non_geo = {r.country_code: r for r in self.records if r.id == WORLD}
        self.by_code: dict[int, list[str]] = {}
        for r in self.records:
            ids = self.by_code.setdefault(r.country_code, [])
            ids.insert(0, r.id) if r.main_country_for_code else ids.append(r.id)
        self.nanpa = {r.id for r in self.records if r.country_code == 1}

    @cached_property
    def blob(self) -> bytes:
        """The plan's rows, to be sent to other processes."""
        return json.dumps(self.rows, sort_keys=True).encode()

    @staticmethod
    def _record(row: dict) -> Record:
        row = dict(row)
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        row["descs"] = {k: Desc(**tuples(d)) for k, d in row["descs"].items()}
        for k in ("formats", "intl_formats"):
            row[k] = tuple(NumberFormat(**tuples(f)) for f in row.get(k, ()))
        r = Record(**row)
        for pattern in (d.pattern for d in r.descs.values() if d.pattern):
            _checked(pattern)
        for f in (*r.formats, *r.intl_formats):
            for pattern in (f.pattern, *f.leading_digits):
                _checked(pattern)
        for pattern in (r.international_prefix, r.national_prefix_for_parsing, r.leading_digits or ""):
            _checked(pattern)
        return r

    @classmethod
    def load(cls, path: str) -> Plan:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def main_region(self, code: int) -> str:
        """The main region of a calling code; "001" without regions; "ZZ" if unknown."""
        return self.by_code.get(code, (UNKNOWN_REGION,))[0]

    def record_of(self, code: int, region: str) -> Record | None:
        return self.non_geo.get(code) if region == WORLD else self.regions.get(region)

    def main_record(self, code: int) -> Record | None:
        return self.record_of(code, self.main_region(code))


def _checked(pattern: str) -> None:
    if re.search(r"\s", pattern) or "|)" in pattern:
        raise ValueError(f"white space or an empty alternative in {pattern!r}")
    re.compile(pattern)


@cache
def default_plan() -> Plan:
    """The plan that comes with the package."""
    return Plan.load(str(Path(__file__).with_name("plan.json")))
