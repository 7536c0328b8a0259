"""Golden cases of the number logic, on the packaged plan."""

import pytest

from callgrid.kernel import phone as K
from callgrid.kernel import text as T
from callgrid.kernel.phone import Phone, PhoneError, Phones
from callgrid.plans import default_plan
from callgrid.plans.loader import NumberFormat

P = Phones(default_plan())

PARSED = [
    ("033316005", "NZ", 64, 33316005, None, None), ("03-331 6005", "NZ", 64, 33316005, None, None),
    ("tel:331-6005;phone-context=+64-3", "NZ", 64, 33316005, None, None), ("0064 3 d331 6005", "NZ", 64, 33316005, None, None),
    ("01164 3 331 6005", "US", 64, 33316005, None, None), ("+01164 3 331 6005", "US", 64, 33316005, None, None),
    ("tel:253-0000;isub=12345;phone-context=www.google.com", "US", 1, 2530000, None, None),
    ("+64(0)64123456", "US", 64, 64123456, None, None), ("123-456-7890", "US", 1, 1234567890, None, None),
    ("+81 *2345", "JP", 81, 2345, None, None), ("0123456", "GB", 44, 123456, 1, None), ("0800 DDA 005", "NZ", 64, 800332005, None, None),
    ("0~01-650-333-6000", "PL", 1, 6503336000, None, None), ("＋１　（６５０）　３３３－６０００", "SG", 1, 6503336000, None, None),
    ("02-36618 300", "IT", 39, 236618300, 1, None), ("0343 15 555 1212", "AR", 54, 93435551212, None, None),
    ("011xx5481429712", "US", 54, 81429712, None, None), ("044 (33) 1234-5678", "MX", 52, 13312345678, None, None),
    ("tel:033316005;phone-context=+(555)", "ZZ", 55, 5033316005, None, None), ("812345", "BY", 375, 812345, None, None),
    ("8123456", "BY", 375, 123456, None, None), ("000", "AU", 61, 0, 2, None), ("0000", "AU", 61, 0, 3, None),
    ("(800) 901-3355 ,extensión 7246433", "US", 1, 8009013355, None, "7246433"),
    ("8 (423) 202-25-11 ДОБ 100", "RU", 7, 4232022511, None, "100"), ("(212)123-1234 x508/x1234", "US", 1, 2121231234, None, "508"),
    ("+1 (645) 123 1234-910#", "US", 1, 6451231234, None, "910"),
]


@pytest.mark.parametrize("raw,region,code,number,zeros,ext", PARSED)
def test_parse(raw, region, code, number, zeros, ext):
    p = P.parse(raw, region)
    assert (p.country_code, p.national_number, p.extension) == (code, number, ext)
    assert bool(p.italian_leading_zero) == (zeros is not None) and (p.number_of_leading_zeros or 1) == (zeros or 1)


def test_keep_raw():
    p = P.parse("08122123456", "KR", keep_raw=True)
    assert (p.national_number, p.preferred_domestic_carrier_code, p.country_code_source) == (22123456, "81", K.DEFAULT)
    p = P.parse("1800 six-flag", "US", keep_raw=True)
    assert (p.national_number, p.country_code_source) == (8007493524, K.WITHOUT_PLUS)
    assert P.format_abroad_keeping_letters(p, "AU") == "0011 1 800 SIX-FLAG" and P.format_abroad_keeping_letters(p, "US") == "1 800 SIX-FLAG"


@pytest.mark.parametrize(
    "raw,region,code",
    [("This is not a phone number", "NZ", "NOT_A_NUMBER"), ("1 MICROSOFT", "NZ", "NOT_A_NUMBER"), ("+---", "DE", "NOT_A_NUMBER"), ("01495 72553301873 810104", "GB", "TOO_LONG_NSN"),
     ("+49 0", "DE", "TOO_SHORT_NSN"), ("+210 3456 56789", "NZ", "INVALID_COUNTRY_CODE"), ("123 456 7890", "ZZ", "INVALID_COUNTRY_CODE"), ("0044", "GB", "TOO_SHORT_AFTER_IDD"),
     ("0119", "US", "TOO_SHORT_AFTER_IDD"), (";phone-context=", "ZZ", "NOT_A_NUMBER"), ("", "US", "NOT_A_NUMBER"), (None, None, "NOT_A_NUMBER")],
)
def test_parse_errors(raw, region, code):
    assert P.try_parse(raw, region)[1] == code


N, I, R, E = K.NATIONAL, K.INTERNATIONAL, K.RFC3966, K.E164
AR = Phone(54, 91187654321)


@pytest.mark.parametrize(
    "p,kind,want",
    [(Phone(1, 9002530000), N, "900 253 0000"), (Phone(1, 9002530000), I, "+1 900 253 0000"), (Phone(1, 9002530000), R, "tel:+1-900-253-0000"), (Phone(1, 0, raw_input="000-000-0000"), N, "000-000-0000"),
     (Phone(44, 2087389353), N, "(020) 8738 9353"), (Phone(44, 2087389353), I, "+44 20 8738 9353"), (Phone(49, 301234), N, "030/1234"), (Phone(49, 301234), I, "+49 30/1234"),
     (Phone(49, 301234), R, "tel:+49-30-1234"), (Phone(39, 236618300, italian_leading_zero=True), N, "02 3661 8300"), (Phone(39, 236618300, italian_leading_zero=True), E, "+390236618300"),
     (AR, N, "011 15 8765-4321"), (AR, I, "+54 9 11 8765 4321"), (Phone(64, 33316005, "1234"), N, "03-331 6005 ext. 1234"), (Phone(64, 33316005, "1234"), R, "tel:+64-3-331-6005;ext=1234"),
     (Phone(1, 6502530000, "4567"), N, "650 253 0000 extn. 4567")],
)
def test_format(p, kind, want):
    assert P.format(p, kind) == want


def test_formats_for_callers():
    ar = Phone(54, 91187654321, "1234")
    assert [P.format_abroad(ar, r) for r in ("US", "AU", "AR")] == ["011 54 9 11 8765 4321 ext. 1234", "0011 54 9 11 8765 4321 ext. 1234", "011 15 8765-4321 ext. 1234"]
    it = Phone(39, 236618300, italian_leading_zero=True)
    assert P.format_abroad(it, "SG") == "+39 02 3661 8300" and P.format_abroad(it, "UZ") == "8~10 39 02 3661 8300"
    ar = Phone(54, 91234125678)
    assert P.format_with_carrier(ar, "15") == "01234 15 12-5678" and P.format_with_carrier(ar, "") == "01234 12-5678"
    us = Phone(1, 8002530000)
    assert P.format_for_mobile(us, "US", True) == "800 253 0000" and P.format_for_mobile(us, "CN", True) == ""
    assert P.format_for_mobile(Phone(81, 2345), "JP", True) == "*2345"
    assert P.format_original(P.parse("0734567 8901", "US", keep_raw=True), "US") == "0734567 8901"
    assert P.format_original(P.parse("045(33)1234-5678", "MX", keep_raw=True), "MX") == "045 33 1234 5678"
    own = NumberFormat(r"(\d{3})(\d{3})(\d{4})", "($1) $2-$3")
    assert P.format_by_pattern(Phone(1, 6502530000), N, [own]) == "(650) 253-0000" and P.format_by_pattern(Phone(1, 6502530000), I, [own]) == "+1 (650) 253-0000"


def test_classify():
    bs = Phone(1, 2423232345)
    assert P.region(bs) == "BS" and P.is_valid(bs) and not P.is_valid_for_region(bs, "US")
    assert all(P.is_valid_for_region(Phone(262, 800123456), r) for r in ("RE", "YT"))
    assert P.possible(Phone(1, 2530000)) == K.LOCAL_ONLY and not P.is_valid(Phone(1, 2530000))
    assert [P.possible(Phone(c, n)) for c, n in ((1, 253000), (1, 65025300000), (0, 2530000))] == [K.TOO_SHORT, K.TOO_LONG, K.BAD_CODE]
    assert P.possible(Phone(290, 12345), K.FIXED_OR_MOBILE) == K.BAD_LENGTH
    assert [P.type(Phone(44, n)) for n in (8431231234, 5631231234, 7031231234)] == ["SHARED_COST", "VOIP", "PERSONAL_NUMBER"]
    assert P.type(Phone(1, 6502531111)) == K.FIXED_OR_MOBILE and P.type(Phone(1, 65025311111)) == K.UNKNOWN
    assert [(P.area_code_length(p), P.destination_code_length(p)) for p in (AR, Phone(65, 65218000), Phone(86, 18912341234))] == [(3, 3), (0, 4), (0, 3)]
    assert P.truncate(Phone(1, 65025300001)) == (True, Phone(1, 6502530000)) and not P.truncate(Phone(1, 123))[0]
    assert T.is_alpha_number("1800 six-flags") and not T.is_alpha_number("1800 123-1234")


def test_match():
    a = P.parse("+64 3 331 6005", "ZZ")
    assert P.match(a, a) == K.EXACT and P.match(a, Phone(0, 33316005)) == K.NSN
    assert P.match(a, Phone(64, 3316005)) == K.SHORT_NSN and P.match(a, Phone(1, 33316005)) == K.NO_MATCH
    assert P.match(Phone(64, 33316005, "12"), Phone(64, 33316005, "3")) == K.NO_MATCH
    assert P.match_texts("+64 3 331 6005", "03 331 6005") == K.NSN and P.match_texts("3 331-6005", "331 6005") == K.SHORT_NSN
    with pytest.raises(PhoneError):
        P.match_texts("abc", "+64 3 331 6005")


def test_examples_and_round_trip():
    plan = default_plan()
    for region, record in plan.regions.items():
        for kind in ("fixed_line", "mobile", "toll_free", "premium_rate"):
            d = record.desc(kind)
            if d.example and d.holds(d.example) and record.general.holds(d.example):
                p = P.example(region, kind.upper())
                if p is None:
                    assert region == "CO"  # without an IDD prefix, every national text counts as one after it
                    continue
                assert P.is_valid_for_region(p, region), (region, kind)
                assert P.parse(P.format(p, E), "ZZ") == p
                assert P.match(P.parse(P.format(p, I), region), p) == K.EXACT
        bad = P.invalid_example(region)
        assert bad is None or not P.is_valid(bad)
    assert P.example_non_geo(979) is not None and P.example_of_type("SHARED_COST") is not None and P.example("ZZ") is None
    assert plan.by_code[1][0] == "US" and set(plan.by_code[1]) == plan.nanpa == {"US", "BB", "BS", "CA"}
    assert P.supported_types(plan.regions["BR"]) and P.ndd("AO") == "00" and P.ndd("ZZ") is None


def test_plain_texts_take_the_same_way():
    import random

    r = random.Random(1)
    for _ in range(4000):
        s = "".join(r.choice("++0123456789 ().-x#~") for _ in range(r.randrange(0, 14)))
        plain = T.plain_number(s)
        if plain is not None:
            assert plain == T.possible_number(s) and T.is_viable(plain) and T.split_extension(plain) == (plain, None), s
