"""Column functions that stay in the JVM: text scalars and decisions over a plan row.

Functions on numbers take the columns of a number joined with its row of
``plans.tables.codes`` (a left join on the calling code; see ``operators.numbers``).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.kernel import text as T
from callgrid.kernel.phone import AREA_CODES_WITHOUT_PREFIX, GEO_MOBILE, GEO_MOBILE_WITHOUT_AREA_CODE, MOBILE_TOKENS
from callgrid.plans.loader import Plan


@cache
def _digit_table() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and their values."""
    found = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


_LETTERS, _KEYS = T.KEYPAD_LETTERS + T.KEYPAD_LETTERS.lower(), T.KEYPAD_DIGITS * 2
_WHOLE = lambda p: rf"(?iu)\A(?:{p})\z"

# --- text


def digits_only(s: Column) -> Column:
    """Decimal digits as ASCII; everything else goes."""
    return F.regexp_replace(F.translate(s, *_digit_table()), "[^0-9]", "")


def diallable_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9+*#]", "")


def keypad(s: Column) -> Column:
    """Letters as the digits of their keys; the rest stays."""
    return F.translate(s, _LETTERS, _KEYS)


def has_three_letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3


def normalize(s: Column) -> Column:
    return F.when(has_three_letters(s), F.regexp_replace(keypad(s), "[^0-9]", "")).otherwise(digits_only(s))


def grouping_only(s: Column) -> Column:
    """Upper-case letters, digits and plain separators."""
    plain = F.translate(s, T.KEYPAD_LETTERS.lower() + T.DASHES[1:] + T.SLASHES[1:] + T.SPACES[1:] + T.DOTS[1:], T.KEYPAD_LETTERS + "-" * (len(T.DASHES) - 1) + "/" + "  " + ".")
    return F.regexp_replace(plain, "[^A-Z0-9/ .-]", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{N}\p{L}#]+\z", "")


def possible_number(s: Column) -> Column:
    """From the first plus or digit on, trimmed; null without one."""
    begun = F.regexp_extract(s, rf"(?s)[{T.PLUS}\p{{Nd}}].*", 0)
    trimmed = trim_end(begun)
    second = F.regexp_extract(trimmed, r"(.*)[\\/] *x", 1)
    return F.when(begun == "", None).when(trimmed.rlike(r"[\\/] *x"), second).otherwise(trimmed)


def is_viable(s: Column) -> Column:
    return (F.octet_length(s) >= T.MIN_NSN) & s.rlike(_WHOLE(f"(?:{T.NUMBER_PATTERN.replace('()', chr(92) + '(' + chr(92) + ')')})(?:{T.extension_pattern(True)})?"))


_EXTENSION = T.extension_pattern(True)


def split_extension(s: Column) -> Column:
    """struct(number, extension): the extension at the end of a text, null where what stands before
    it isn't a viable number."""
    pattern = rf"(?iu)\A(.*?)(?:{_EXTENSION})\z"
    head = F.regexp_extract(s, pattern, 1)
    digits = F.coalesce(*(F.nullif(F.regexp_extract(s, pattern, k), F.lit("")) for k in range(2, 2 + _EXTENSION.count("(\\p{Nd}"))))
    cut = F.coalesce(digits.isNotNull() & is_viable(head), F.lit(False))
    return F.struct(F.when(cut, head).otherwise(s).alias("number"), F.when(cut, digits).alias("extension"))


def is_alpha_number(s: Column) -> Column:
    """Whether a text is a viable number with three letters or more, as 1-800-FLOWERS."""
    return is_viable(s) & has_three_letters(split_extension(s)["number"])


def country_code_of(region: Column, plan: Plan) -> Column:
    """The calling code of a region; 0 for an unknown one."""
    known = F.create_map(*(F.lit(x) for r in plan.regions.values() for x in (r.id, r.country_code)))
    return F.coalesce(F.try_element_at(known, F.coalesce(region, F.lit(""))), F.lit(0))


def national_prefix_of(region: Column, plan: Plan) -> Column:
    """The prefix that is dialled within a region, empty without one; null for an unknown region."""
    known = F.create_map(*(F.lit(x) for r in plan.regions.values() for x in (r.id, (r.national_prefix or "").replace("~", ""))))
    return F.try_element_at(known, F.coalesce(region, F.lit("")))


def phone_context(s: Column) -> Column:
    """The value of the phone-context parameter; null without one."""
    at = F.instr(s, T.PHONE_CONTEXT)
    return F.when(at > 0, F.substring_index(F.substr(s, at + len(T.PHONE_CONTEXT)), ";", 1))


def is_context_valid(s: Column) -> Column:
    return s.rlike(rf"\A(?:{T.GLOBAL_CONTEXT.pattern})\z") | s.rlike(rf"\A(?:{T.DOMAIN_CONTEXT.pattern})\z")


def leading_zeros(nsn: Column) -> Column:
    zeros = F.length(nsn) - F.length(F.ltrim(nsn, F.lit("0")))
    return F.when((F.length(nsn) >= 2) & (zeros > 0), zeros - (zeros == F.length(nsn)).cast("int"))


def strip_prefix(s: Column, prefix: Column) -> Column:
    """s without prefix; null where it doesn't begin with it."""
    return F.when(F.startswith(s, prefix), F.substr(s, F.length(prefix) + 1))


def nsn(national_number: Column, italian_zero: Column, zeros: Column) -> Column:
    """The national significant number."""
    lead = F.when(F.coalesce(italian_zero, F.lit(False)), F.repeat(F.lit("0"), F.greatest(F.coalesce(zeros, F.lit(1)), F.lit(0)))).otherwise("")
    return F.concat(lead, national_number.cast("string"))


def e164(cc: Column, nsn: Column) -> Column:
    return F.concat(F.lit("+"), cc.cast("string"), nsn)


# --- decisions over a plan row


def length_result(nsn: Column, lengths: Column, local: Column) -> Column:
    """Whether a number of this length can exist."""
    n = F.length(nsn)
    return (
        F.when(lengths.isNull(), "INVALID_COUNTRY_CODE")
        .when((F.size(lengths) == 0) | (lengths[0] == -1), "INVALID_LENGTH")
        .when(F.array_contains(local, n), "IS_POSSIBLE_LOCAL_ONLY")
        .when(n < lengths[0], "TOO_SHORT")
        .when(n > F.element_at(lengths, -1), "TOO_LONG")
        .when(F.array_contains(lengths, n), "IS_POSSIBLE")
        .otherwise("INVALID_LENGTH")
    )


def possible_for(nsn: Column, lengths: Column, local: Column, kind: str) -> Column:
    """length_result for a type; lengths, local: maps by type."""
    if kind != "FIXED_LINE_OR_MOBILE":
        k = "general" if kind == "UNKNOWN" else kind.lower()
        return length_result(nsn, lengths[k], local[k])
    exists = lambda k: (F.size(lengths[k]) > 0) & (lengths[k][0] != -1)
    both = exists("mobile")
    merged = F.when(both, F.array_sort(F.concat(lengths["fixed_line"], lengths["mobile"]))).otherwise(lengths["fixed_line"])
    locals_ = F.when(both, F.concat(local["fixed_line"], local["mobile"])).otherwise(local["fixed_line"])
    return F.when(lengths.isNull(), "INVALID_COUNTRY_CODE").when(~exists("fixed_line"), length_result(nsn, lengths["mobile"], local["mobile"])).otherwise(length_result(nsn, merged, locals_))


def chosen_format(nsn: Column, formats: Column) -> Column:
    fits = lambda f: F.coalesce(F.rlike(nsn, f["leading"]), F.lit(True)) & F.rlike(nsn, f["whole"])
    return F.get(F.filter(formats, fits), F.lit(0))


def written(nsn: Column, chosen: Column, template: str) -> Column:
    """The number by its chosen format; as it is without one."""
    return F.coalesce(F.regexp_replace(nsn, chosen["pattern"], chosen[template]), nsn)


def _extension(ext: Column, label: Column) -> Column:
    return F.when(F.coalesce(ext, F.lit("")) != "", F.concat(label, ext)).otherwise("")


def national(body: Column, nsn: Column, ext: Column, label: Column) -> Column:
    """body: the national format, null where the calling code is unknown."""
    return F.when(body.isNull(), nsn).otherwise(F.concat(body, _extension(ext, F.coalesce(label, F.lit(T.DEFAULT_EXT)))))


def international(cc: Column, body: Column, nsn: Column, ext: Column, label: Column) -> Column:
    out = F.concat(F.lit("+"), cc.cast("string"), F.lit(" "), body, _extension(ext, F.coalesce(label, F.lit(T.DEFAULT_EXT))))
    return F.when(body.isNull(), nsn).otherwise(out)


def rfc3966(cc: Column, body: Column, nsn: Column, ext: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(body, rf"^[{T.PUNCTUATION}]+", ""), rf"[{T.PUNCTUATION}]+", "-")
    return F.when(body.isNull(), nsn).otherwise(F.concat(F.lit("tel:+"), cc.cast("string"), F.lit("-"), dashed, _extension(ext, F.lit(T.RFC_EXT))))


def destination_code_length(cc: Column, type_: Column, international: Column) -> Column:
    """international: the format without an extension."""
    groups = F.regexp_extract_all(international, F.lit(r"([0-9]+)"), F.lit(1))
    out = F.when(F.size(groups) < 3, 0)
    for code, token in MOBILE_TOKENS.items():
        out = out.when((cc == code) & (type_ == "MOBILE"), F.length(groups[2]) + len(token))
    return out.otherwise(F.length(groups[1]))


def is_geographical(cc: Column, type_: Column) -> Column:
    return type_.isin("FIXED_LINE", "FIXED_LINE_OR_MOBILE") | ((type_ == "MOBILE") & cc.isin(*sorted(GEO_MOBILE)))


def area_code_length(cc: Column, region: Column, national_prefix: Column, type_: Column, italian_zero: Column, ndc: Column) -> Column:
    """region and national_prefix: of the number's region; null where there is none."""
    no_prefix = national_prefix.isNull() & ~F.coalesce(italian_zero, F.lit(False)) & ~cc.isin(*AREA_CODES_WITHOUT_PREFIX)
    mobile = (type_ == "MOBILE") & cc.isin(*GEO_MOBILE_WITHOUT_AREA_CODE)
    none = region.isNull() | (region == "001") | no_prefix | mobile | ~is_geographical(cc, type_)
    return F.when(none, 0).otherwise(ndc)


def match(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How alike two numbers are; each: cc, number, zero, zeros, ext (columns)."""
    x, y = a["number"].cast("string"), b["number"].cast("string")
    zero = lambda p: F.coalesce(p["zero"], F.lit(False))
    count = lambda p: F.when(zero(p), F.coalesce(p["zeros"], F.lit(1)))
    same = (a["number"] == b["number"]) & a["ext"].eqNullSafe(b["ext"]) & (zero(a) == zero(b)) & count(a).eqNullSafe(count(b))
    known = (a["cc"] != 0) & (b["cc"] != 0)
    return (
        F.when(F.coalesce(a["ext"] != b["ext"], F.lit(False)), "NO_MATCH")
        .when(known & (a["cc"] != b["cc"]), "NO_MATCH")
        .when(same, F.when(known, "EXACT_MATCH").otherwise("NSN_MATCH"))
        .when(F.endswith(x, y) | F.endswith(y, x), "SHORT_NSN_MATCH")
        .otherwise("NO_MATCH")
    )
