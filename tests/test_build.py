import pytest

from callgrid.kernel import text as T
from callgrid.kernel.phone import Phones
from callgrid.plans import Plan, build

XML = """<phoneNumberMetadata><territories>
<territory id="XA" countryCode="999" internationalPrefix="00" nationalPrefix="0" nationalPrefixFormattingRule="$NP$FG" mainCountryForCode="true" carrierCodeFormattingRule="$NP$CC $FG">
  <availableFormats>
    <numberFormat pattern="(\\d{2})(\\d{4})"><leadingDigits>
        2|
        3</leadingDigits><format>$1 $2</format></numberFormat>
    <numberFormat pattern="(\\d{3})(\\d{4})" nationalPrefixFormattingRule="($FG)"><format>$1-$2</format><intlFormat>NA</intlFormat></numberFormat>
  </availableFormats>
  <generalDesc><nationalNumberPattern>[2-9]\\d{4,6}</nationalNumberPattern></generalDesc>
  <fixedLine><possibleLengths national="[5-7]" localOnly="4"/><exampleNumber>231234</exampleNumber><nationalNumberPattern>[23]\\d{4,6}</nationalNumberPattern></fixedLine>
  <mobile><possibleLengths national="7"/><exampleNumber>7123456</exampleNumber><nationalNumberPattern>7\\d{6}</nationalNumberPattern></mobile>
</territory></territories></phoneNumberMetadata>"""


def test_rows_from_xml(tmp_path):
    (row,) = build.rows_from_xml(XML)
    assert row["descs"]["general"] == {"pattern": "[2-9]\\d{4,6}", "lengths": [5, 6, 7], "local_lengths": [4]}
    assert row["descs"]["fixed_line"] == {"pattern": "[23]\\d{4,6}", "local_lengths": [4], "example": "231234"} and row["descs"]["mobile"]["lengths"] == [7]
    assert row["descs"]["voip"] == {"lengths": [-1]} and row["national_prefix_for_parsing"] == "0" and "same_mobile_and_fixed_line_pattern" not in row
    assert row["formats"][0] == {"pattern": "(\\d{2})(\\d{4})", "format": "$1 $2", "leading_digits": ["2|3"], "national_prefix_rule": "0$1", "carrier_rule": "0$CC $1"}
    assert [f["format"] for f in row["intl_formats"]] == ["$1 $2"]
    build.write_json([row], str(tmp_path / "p.json"))
    ops = Phones(Plan.load(str(tmp_path / "p.json")))
    p = ops.parse("023 1234", "XA")
    assert (p.country_code, p.national_number) == (999, 231234) and ops.format(p, "NATIONAL") == "023 1234" and ops.format_with_carrier(p, "15") == "015 23 1234"
    assert ops.type(ops.parse("+9997123456", "ZZ")) == "MOBILE" and ops.format(ops.parse("+9997123456", "ZZ"), "NATIONAL") == "(712)-3456"


def test_lengths():
    assert build.lengths("[3-5],7") == {3, 4, 5, 7}
    for bad in ("[3-4]", "3,3", "a", "", "[5-3]", "4,[3-6]"):
        with pytest.raises(build.PlanError):
            build.lengths(bad)
    with pytest.raises(build.PlanError):
        build.pattern("(a|)")


def test_filters():
    rows = build.rows_from_xml(XML)
    assert "example" not in build.lite(rows)[0]["descs"]["mobile"]
    only = build.special(rows)[0]
    assert only["descs"]["mobile"] == rows[0]["descs"]["mobile"] and only["descs"]["fixed_line"] == {} and only["national_prefix"] == "0"
    f = build.parse_filter("mobile(pattern,example):voip:national_prefix")
    assert f == {"mobile": {"pattern", "example"}, "voip": set(build.CHILDREN), "national_prefix": set()}
    assert build.complement(build.complement(f)) == f
    for bad in ("mobile(x)", "nothing", "national_prefix(pattern)", ""):
        with pytest.raises(build.PlanError):
            build.parse_filter(bad)


def test_templates():
    assert T.suits_as_you_type("$1 $2-$3") and not T.suits_as_you_type("$1 x15 $2!") and T.first_group_only("($1)") and T.first_group_only("") and not T.first_group_only("0$1")
