"""Characters and expressions of written phone numbers."""

from __future__ import annotations

import re
import unicodedata

import regex

# Fixed values of the number syntax.
PLUS = "+\uff0b"
PUNCTUATION = "-x\u2010-\u2015\u2212\u30fc\uff0d-\uff0f \u00a0\u00ad\u200b\u2060\u3000()\uff08\uff09\uff3b\uff3d.\\[\\]/~\u2053\u223c"
KEYPAD_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYPAD_DIGITS = "22233344455566677778889999"
DASHES = "-\uff0d\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SLASHES = "/\uff0f"
SPACES = " \u3000\u2060"
DOTS = ".\uff0e"
EXPLICIT_LABEL = "(?:e?xt(?:ensi(?:o\u0301?|\u00f3))?n?|\uff45?\uff58\uff54\uff4e?|\u0434\u043e\u0431|anexo)"
AMBIGUOUS_LABEL = "(?:[x\uff58#\uff03~\uff5e]|int|\uff49\uff4e\uff54)"
BEFORE_LABEL, AFTER_LABEL = "[ \u00a0\\t,]*", "[:\\.\uff0e]?[ \u00a0\\t,-]*"
BEFORE_COMMAS = "[ \u00a0\\t]*"
EXPLICIT_DIGITS, LIKELY_DIGITS, AMBIGUOUS_DIGITS, UNSURE_DIGITS = 20, 15, 9, 6
PHONE_CONTEXT, ISDN, TEL, RFC_EXT, DEFAULT_EXT = ";phone-context=", ";isub=", "tel:", ";ext=", " ext. "
MIN_NSN, MAX_NSN = 2, 17


def extension_pattern(parsing: bool) -> str:
    """Alternatives for an extension, each with one group for its digits."""
    digits = lambda n: rf"(\p{{Nd}}{{1,{n}}})"
    kinds = [
        RFC_EXT + digits(EXPLICIT_DIGITS),
        f"{BEFORE_LABEL}{EXPLICIT_LABEL}{AFTER_LABEL}{digits(EXPLICIT_DIGITS)}#?",
        f"{BEFORE_LABEL}{AMBIGUOUS_LABEL}{AFTER_LABEL}{digits(AMBIGUOUS_DIGITS)}#?",
        f"[- ]+{digits(UNSURE_DIGITS)}#",
    ]
    if parsing:
        kinds += [
            f"{BEFORE_COMMAS}(?:,{{2}}|;){AFTER_LABEL}{digits(LIKELY_DIGITS)}#?",
            f"{BEFORE_COMMAS},+{AFTER_LABEL}{digits(AMBIGUOUS_DIGITS)}#?",
        ]
    return "|".join(kinds)


# Fixed values of the number syntax: a number, dialling prefixes, phone contexts, templates.
NUMBER_PATTERN = rf"[{PLUS}]*(?:[{PUNCTUATION}*]*\p{{Nd}}){{3,}}[{PUNCTUATION}*\p{{Nd}}a-z]*|\p{{Nd}}{{2}}"
VIABLE = regex.compile(rf"(?i)(?:{NUMBER_PATTERN})(?:{extension_pattern(True)})?")
EXTENSION = regex.compile(rf"(?i)(?:{extension_pattern(True)})\Z")
START = regex.compile(rf"[{PLUS}\p{{Nd}}]")
PLUSES = regex.compile(rf"[{PLUS}]+")
UNWANTED_END = regex.compile(r"[^\p{N}\p{L}#]+\Z")
SECOND_NUMBER = regex.compile(r"(.*)[\\/] *x")
SEPARATORS = regex.compile(rf"[{PUNCTUATION}]+")
ALPHA = regex.compile(r"(?:.*?[A-Za-z]){3}.*")
SINGLE_IDD = regex.compile(r"\d+(?:[~\u2053\u223c\uff5e]\d+)?")
GLOBAL_CONTEXT = regex.compile(r"\+(?:[\-\.\(\)]|\p{Nd})*\p{Nd}(?:[\-\.\(\)]|\p{Nd})*")
_LABEL = r"[A-Za-z\p{Nd}]+(?:-*[A-Za-z\p{Nd}])*"
DOMAIN_CONTEXT = regex.compile(rf"(?:{_LABEL}\.)*[A-Za-z]+(?:-*[A-Za-z\p{{Nd}}])*\.?")
AS_YOU_TYPE = regex.compile(rf"[{PUNCTUATION}]*\$1[{PUNCTUATION}]*(?:\$\d[{PUNCTUATION}]*)*")

_KEYPAD = dict(zip(KEYPAD_LETTERS + KEYPAD_LETTERS.lower(), KEYPAD_DIGITS * 2, strict=True))
_ASCII = {str(d): str(d) for d in range(10)}
_ALPHA_OR_DIGIT = _KEYPAD | _ASCII
_GROUPING = (
    {c: c.upper() for c in KEYPAD_LETTERS + KEYPAD_LETTERS.lower()} | _ASCII | dict.fromkeys(DASHES, "-") | dict.fromkeys(SLASHES, "/") | dict.fromkeys(SPACES, " ") | dict.fromkeys(DOTS, ".")
)
_DIALLABLE = set("0123456789+*#")


_NOT_DIGIT = re.compile("[^0-9]+")


def digits_only(s: str) -> str:
    """Decimal digits of any script as ASCII; everything else goes."""
    if s.isascii():
        return _NOT_DIGIT.sub("", s)
    return "".join(str(unicodedata.decimal(c)) for c in s if unicodedata.decimal(c, None) is not None)


def diallable_only(s: str) -> str:
    return "".join(c for c in s if c in _DIALLABLE)


def keypad(s: str) -> str:
    """Letters as the digits of their keys; the rest stays."""
    return "".join(_ALPHA_OR_DIGIT.get(c, c) for c in s)


def grouping_only(s: str) -> str:
    """Upper-case letters, digits and plain separators; everything else goes."""
    return "".join(_GROUPING[c] for c in s if c in _GROUPING)


def normalize(s: str) -> str:
    """Digits; with three letters or more, letters count as the digits of their keys."""
    if ALPHA.search(s):
        return "".join(_ALPHA_OR_DIGIT[c] for c in s if c in _ALPHA_OR_DIGIT)
    return digits_only(s)


def is_viable(s: str) -> bool:
    return len(s.encode()) >= MIN_NSN and VIABLE.fullmatch(s) is not None


def split_extension(s: str) -> tuple[str, str | None]:
    """(number, extension) if what stands before an extension is a viable number."""
    m = EXTENSION.search(s)
    if m and is_viable(s[: m.start()]):
        digits = next((g for g in m.groups() if g), None)
        if digits:
            return s[: m.start()], digits
    return s, None


def is_alpha_number(s: str) -> bool:
    return is_viable(s) and ALPHA.fullmatch(split_extension(s)[0]) is not None


def trim_end(s: str) -> str:
    return UNWANTED_END.sub("", s)


_PLAIN = re.compile(r"[ ().\-]*(\+?(?:[ ().\-]*[0-9]){3,})[ ().\-]*")


def plain_number(s: str) -> str | None:
    """The number in a text of a plus, digits, spaces, dots, dashes and brackets alone: it
    is viable and has no extension, context or second number. None for other texts."""
    m = _PLAIN.fullmatch(s)
    return m[1] if m else None


def possible_number(s: str) -> str | None:
    """From the first plus or digit, without unwanted end characters and without a second
    number; None if there is no start."""
    m = START.search(s)
    if not m:
        return None
    s = trim_end(s[m.start() :])
    m = SECOND_NUMBER.search(s)
    return m[1] if m else s


def phone_context(s: str) -> str | None:
    """The value of the phone-context parameter; None without one."""
    at = s.find(PHONE_CONTEXT)
    return None if at < 0 else s[at + len(PHONE_CONTEXT) :].split(";", 1)[0]


def is_context_valid(context: str) -> bool:
    return context != "" and (GLOBAL_CONTEXT.fullmatch(context) is not None or DOMAIN_CONTEXT.fullmatch(context) is not None)


def leading_zeros(nsn: str) -> int | None:
    """Zeros that a number must keep in front; of all zeros the last one isn't counted."""
    if len(nsn) < 2 or nsn[0] != "0":
        return None
    zeros = len(nsn) - len(nsn.lstrip("0"))
    return zeros - (zeros == len(nsn))


def suits_as_you_type(template: str) -> bool:
    """Whether a template holds groups and punctuation only."""
    return AS_YOU_TYPE.fullmatch(template) is not None


def first_group_only(rule: str) -> bool:
    """Whether a prefix rule adds nothing but brackets to the first group."""
    return rule == "" or regex.fullmatch(r"\(?\$1\)?", rule) is not None
