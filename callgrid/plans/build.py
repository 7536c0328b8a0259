"""Compiling a dial plan from an XML description, and thinning plans out.

`rows_from_xml` reads ``territories`` of the public numbering-plan XML and gives the rows
that `Plan` takes: attributes, formats with their rules filled in, and for every type its
pattern, lengths and example. The general lengths are those of the types; a type that has
the same ones inherits them.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from pathlib import Path

#: Type elements of a territory and the names that plans use.
ELEMENTS = {
    "fixedLine": "fixed_line", "mobile": "mobile", "tollFree": "toll_free", "premiumRate": "premium_rate", "sharedCost": "shared_cost", "personalNumber": "personal_number", "voip": "voip", "pager": "pager",
    "uan": "uan", "emergency": "emergency", "voicemail": "voicemail", "shortCode": "short_code", "standardRate": "standard_rate", "carrierSpecific": "carrier_specific", "smsServices": "sms_services",
    "noInternationalDialling": "no_international_dialling",
}
#: Types that a plan always states, if only as impossible.
ALWAYS = ("fixed_line", "mobile", "toll_free", "premium_rate", "shared_cost", "personal_number", "voip", "pager", "uan", "voicemail", "no_international_dialling")
_TEXT = {
    "internationalPrefix": "international_prefix", "preferredInternationalPrefix": "preferred_international_prefix", "nationalPrefix": "national_prefix", "preferredExtnPrefix": "preferred_extn_prefix",
    "nationalPrefixTransformRule": "national_prefix_transform_rule", "leadingDigits": "leading_digits",
}


class PlanError(ValueError):
    """The description breaks a rule of the format."""


def pattern(s: str | None) -> str:
    """An expression without white space; an empty alternative is refused."""
    s = re.sub(r"\s", "", s or "")
    if "|)" in s:
        raise PlanError(f"an empty alternative in {s}")
    re.compile(s)
    return s


def lengths(s: str) -> set[int]:
    """`[3-5],7`: numbers and ranges of three or more, ascending and without repeats."""
    out: list[int] = []
    for part in s.split(","):
        if m := re.fullmatch(r"\[(\d+)-(\d+)\]", part):
            a, b = int(m[1]), int(m[2])
            if b - a < 2:
                raise PlanError(f"{part} is no range of three or more")
            found = [*range(a, b + 1)]
        elif re.fullmatch(r"\d+", part):
            found = [int(part)]
        else:
            raise PlanError(f"{s!r} isn't a list of lengths")
        if set(found) & set(out):
            raise PlanError(f"{s} repeats a length")
        out += found
    return set(out)


def _own_lengths(e: ET.Element) -> tuple[set[int], set[int]]:
    own, local = set(), set()
    for p in e.iter("possibleLengths"):
        n, o = lengths(p.attrib["national"]), lengths(p.attrib["localOnly"]) if p.get("localOnly") else set()
        if n & o:
            raise PlanError("a length is both national and local only")
        own |= n
        local |= o
    return own, local


def _descs(t: ET.Element) -> dict:
    every, every_local, found = set(), set(), {}
    for tag, kind in ELEMENTS.items():
        e = t.find(tag)
        if e is None:
            continue
        own, local = _own_lengths(e)
        found[kind] = (e, own, local)
        if kind != "no_international_dialling":
            every |= own
            every_local |= local
    general = t.find("generalDesc")
    if general is not None and general.find("possibleLengths") is not None:
        raise PlanError("the general description takes its lengths from the types")
    out = {"general": {"pattern": pattern(general.findtext("nationalNumberPattern")) if general is not None else ""}}
    if every:
        out["general"]["lengths"] = sorted(every)
    if every_local - every:
        out["general"]["local_lengths"] = sorted(every_local - every)
    for kind in dict.fromkeys((*ALWAYS, *found)):
        if kind not in found:
            out[kind] = {"lengths": [-1]}
            continue
        e, own, local = found[kind]
        if kind != "no_international_dialling" and not own <= every | {-1}:
            raise PlanError(f"{kind} has lengths of its own")
        d = {"pattern": pattern(e.findtext("nationalNumberPattern"))}
        if own and own != every:
            d["lengths"] = sorted(own)
        if local - own:
            d["local_lengths"] = sorted(local - own)
        if e.findtext("exampleNumber"):
            d["example"] = e.findtext("exampleNumber").strip()
        out[kind] = {k: v for k, v in d.items() if v != ""}
    return out


def _rule(s: str, prefix: str) -> str:
    """`$NP` is the national prefix, `$FG` the first group."""
    return s.replace("$NP", prefix).replace("$FG", "$1")


def _formats(t: ET.Element) -> tuple[list[dict], list[dict]]:
    prefix = t.get("nationalPrefix", "")
    national, intl, explicit = [], [], False
    for e in t.iterfind("availableFormats/numberFormat"):
        f = {"pattern": pattern(e.attrib["pattern"]), "format": (e.findtext("format") or "").strip()}
        leading = [pattern(x.text) for x in e.iterfind("leadingDigits")]
        if leading:
            f["leading_digits"] = leading
        rule = e.get("nationalPrefixFormattingRule", t.get("nationalPrefixFormattingRule"))
        if rule:
            f["national_prefix_rule"] = _rule(rule, prefix)
        if (e.get("nationalPrefixOptionalWhenFormatting") or t.get("nationalPrefixOptionalWhenFormatting")) == "true":
            f["national_prefix_optional"] = True
        carrier = e.get("carrierCodeFormattingRule", t.get("carrierCodeFormattingRule"))
        if carrier:
            if "$CC" not in carrier:
                raise PlanError(f"{carrier} has no place for a carrier code")
            f["carrier_rule"] = _rule(carrier, prefix)
        national.append(f)
        own = [x.text.strip() for x in e.iterfind("intlFormat")]
        if len(own) > 1:
            raise PlanError("a format has several international forms")
        if not own:
            intl.append(f)
            continue
        explicit = True
        if own[0] != "NA":
            intl.append({k: f[k] for k in ("pattern", "leading_digits") if k in f} | {"format": own[0]})
    return national, intl if explicit else []


def _row(t: ET.Element) -> dict:
    row: dict = {"id": t.attrib["id"], "country_code": int(t.attrib["countryCode"])}
    for a, k in _TEXT.items():
        if t.get(a) is not None:
            row[k] = pattern(t.get(a)) if k in ("international_prefix", "leading_digits") else t.get(a)
    parsing = t.get("nationalPrefixForParsing", t.get("nationalPrefix"))
    if parsing is not None:
        row["national_prefix_for_parsing"] = pattern(parsing)
    for a, k in (("mainCountryForCode", "main_country_for_code"), ("mobileNumberPortableRegion", "mobile_number_portable_region")):
        if t.get(a) == "true":
            row[k] = True
    row["descs"] = _descs(t)
    if row["descs"]["fixed_line"].get("pattern") == row["descs"]["mobile"].get("pattern"):
        row["same_mobile_and_fixed_line_pattern"] = True
    national, intl = _formats(t)
    return row | ({"formats": national} if national else {}) | ({"intl_formats": intl} if intl else {})


def rows_from_xml(text: str) -> list[dict]:
    """The rows of a plan from its XML."""
    return [_row(t) for t in ET.fromstring(text).iter("territory")]


def write_json(rows: list[dict], path: str) -> None:
    """One record on each line, as `Plan.load` reads it."""
    body = ",\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    Path(path).write_text(f"[\n{body}\n]\n", encoding="utf-8")


# --- thinning out

CHILDREN = ("pattern", "lengths", "local_lengths", "example")
PARENTS = ("general", *ELEMENTS.values())
FIELDS = (*_TEXT.values(), "national_prefix_for_parsing", "main_country_for_code", "mobile_number_portable_region")


def parse_filter(spec: str) -> dict[str, set[str]]:
    """`type(child,child):type:child:field` as {type or field: children}.

    A type alone stands for all its children, a child alone for that child of all types.
    """
    out: dict[str, set[str]] = {}
    for part in spec.split(":"):
        m = re.fullmatch(r"(\w+)(?:\(([\w,]+)\))?", part)
        if not m:
            raise PlanError(f"{part!r} isn't a filter")
        name, inner = m[1], m[2]
        if name in PARENTS:
            chosen = set(inner.split(",")) if inner else set(CHILDREN)
            if not chosen <= set(CHILDREN):
                raise PlanError(f"{part}: unknown children")
            out.setdefault(name, set()).update(chosen)
        elif inner is None and name in CHILDREN:
            for p in PARENTS:
                out.setdefault(p, set()).add(name)
        elif inner is None and name in FIELDS:
            out[name] = set()
        else:
            raise PlanError(f"{part}: unknown name")
    return out


def complement(fields: dict[str, set[str]]) -> dict[str, set[str]]:
    """All that the filter doesn't name."""
    out = {p: rest for p in PARENTS if (rest := set(CHILDREN) - fields.get(p, set()))}
    return out | {f: set() for f in FIELDS if f not in fields}


def without(rows: list[dict], fields: dict[str, set[str]]) -> list[dict]:
    """The rows less what the filter names."""
    out = []
    for row in rows:
        descs = {k: {c: v for c, v in d.items() if c not in fields.get(k, ())} for k, d in row["descs"].items()}
        out.append({k: v for k, v in row.items() if k not in fields or k in PARENTS} | {"descs": descs})
    return out


def lite(rows: list[dict]) -> list[dict]:
    """The rows without example numbers."""
    return without(rows, parse_filter("example"))


def special(rows: list[dict]) -> list[dict]:
    """The rows with no type but mobile, for plans that only validate mobile numbers."""
    return without(rows, complement(parse_filter("general:mobile:national_prefix:national_prefix_for_parsing:national_prefix_transform_rule:international_prefix:leading_digits:main_country_for_code")))
