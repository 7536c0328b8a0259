"""SQL for DuckDB that states the same results from the same plan, as common table
expressions built from VALUES."""

from __future__ import annotations

from callgrid.plans import default_plan
from callgrid.plans.loader import SPECIAL_TYPES, TYPES, with_rule
from callgrid.plans.tables import KINDS

#: The carrier that the queries dial with.
CARRIER = "15"


# Fixed values, written out for the oracle alone: the syntax of a number, extensions, the keypad.
_MARKS = r"-x\x{2010}-\x{2015}\x{2212}\x{30fc}\x{ff0d}-\x{ff0f} \x{a0}\x{ad}\x{200b}\x{2060}\x{3000}()\x{ff08}\x{ff09}\x{ff3b}\x{ff3d}.\[\]/~\x{2053}\x{223c}"
_NUMBER = rf"(?:[+\x{{ff0b}}]*(?:[{_MARKS}*]*\p{{Nd}}){{3,}}[{_MARKS}*\p{{Nd}}a-z]*|\p{{Nd}}{{2}})"
_EXTENSIONS = (
    r";ext=(\p{Nd}{1,20})",
    r"[ \x{a0}\t,]*(?:e?xt(?:ensi(?:o\x{301}?|\x{f3}))?n?|\x{ff45}?\x{ff58}\x{ff54}\x{ff4e}?|доб|anexo)[:.\x{ff0e}]?[ \x{a0}\t,-]*(\p{Nd}{1,20})#?",
    r"[ \x{a0}\t,]*(?:[x\x{ff58}#\x{ff03}~\x{ff5e}]|int|\x{ff49}\x{ff4e}\x{ff54})[:.\x{ff0e}]?[ \x{a0}\t,-]*(\p{Nd}{1,9})#?",
    r"[- ]+(\p{Nd}{1,6})#",
    r"[ \x{a0}\t]*(?:,{2}|;)[:.\x{ff0e}]?[ \x{a0}\t,-]*(\p{Nd}{1,15})#?",
    r"[ \x{a0}\t]*,+[:.\x{ff0e}]?[ \x{a0}\t,-]*(\p{Nd}{1,9})#?",
)
_KEYS = ("abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999")
#: A text that is a viable number.
VIABLE = f"(?i){_NUMBER}(?:{'|'.join(_EXTENSIONS)})?"
#: Values of a phone context: a number with a plus, or a domain.
CONTEXTS = (r"\+[-.()\p{Nd}]*\p{Nd}[-.()\p{Nd}]*", r"([A-Za-z\p{Nd}]+(-*[A-Za-z\p{Nd}])*\.)*[A-Za-z]+(-*[A-Za-z\p{Nd}])*\.?")
#: Letters of a keypad in both cases, and their digits.
KEYPAD = (_KEYS[0].upper() + _KEYS[0], _KEYS[1] * 2)


def quoted(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return str(s).lower()
    if isinstance(s, int):
        return str(s)
    if isinstance(s, (list, tuple)):
        return f"CAST([{', '.join(map(str, s))}] AS INTEGER[])"
    return "'" + s.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def re2(template: str) -> str:
    r"""`$1` templates with `\1`."""
    return template.replace("$", "\\")


def written(numbers: str) -> str:
    """The texts of sources.synthetic.written, from the CTEs that make numbers."""
    spaced = r"regexp_replace(regexp_replace(nsn, '(\d{3})', '\1 ', 'g'), ' $', '')"
    styles = [
        "'+' || cc || nsn", "'+' || cc || ' (' || substr(nsn, 1, 3) || ') ' || substr(nsn, 4, 20)", "nsn", f"'0' || {spaced}", "'tel:+' || cc || '-' || nsn || ';ext=12'", f"'call ' || {spaced} || ' ext. 345 now'",
        "translate('+' || cc || nsn, '0123456789', '０１２３４５６７８９')", "'1-800-FLOWERS ' || substr(nsn, 1, 1)", "'no number here'", "'00' || cc || nsn", f"'011 ' || cc || ' ' || {spaced}",
    ]
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(styles))
    return f"{numbers}, written AS (SELECT *, CASE key % {len(styles) + 1} {cases} END AS raw FROM numbers)"


def regions() -> str:
    """plan: one row for each record, with patterns and lengths of the kinds."""
    plan, rows = default_plan(), []
    for cc, ids in plan.by_code.items():
        for rank, i in enumerate(ids):
            r = plan.record_of(cc, i)
            cells = [c for k in KINDS for c in (r.desc(k).pattern, r.desc(k).lengths)]
            rows.append((cc, rank, len(ids), i, r.leading_digits, r.national_prefix, r.same_mobile_and_fixed_line_pattern, *cells))
    names = ", ".join(f"{k}_p, {k}_l" for k in KINDS)
    return values("plan", f"cc, rank, n_regions, region, lead_p, national_prefix, same, {names}", rows)


def _holds(kind: str) -> str:
    return f"coalesce((len({kind}_l) = 0 OR list_contains({kind}_l, length(nsn))) AND regexp_full_match(nsn, {kind}_p), false)"


def classified(numbers: str, pre: str = "") -> str:
    """classified: region, type and whether a number can be dialled from abroad."""
    special = " ".join(f"WHEN {_holds(k)} THEN '{k.upper()}'" for k in SPECIAL_TYPES)
    return f"""{pre}typed AS (SELECT key, {numbers}.cc AS ncc, nsn, zero, rank, n_regions, region AS preg, lead_p, national_prefix, {_holds('no_international_dialling')} AS barred,
  CASE WHEN NOT {_holds('general')} THEN 'UNKNOWN' {special}
  WHEN {_holds('fixed_line')} THEN CASE WHEN same OR {_holds('mobile')} THEN 'FIXED_LINE_OR_MOBILE' ELSE 'FIXED_LINE' END
  WHEN NOT same AND {_holds('mobile')} THEN 'MOBILE' ELSE 'UNKNOWN' END AS t
  FROM (SELECT key, cc, nsn, zero FROM {numbers}) AS {numbers} LEFT JOIN plan ON plan.cc = {numbers}.cc),
{pre}claimed AS (SELECT key, arg_min(struct_pack(r := preg, t := t, barred := barred, np := national_prefix), rank) AS x FROM {pre}typed
  WHERE preg IS NOT NULL AND (n_regions = 1 OR coalesce(regexp_matches(nsn, '^(?:' || lead_p || ')'), false) OR t <> 'UNKNOWN') GROUP BY key),
{pre}classified AS (SELECT n.key, n.cc, n.nsn, n.zero, coalesce(x.r, 'ZZ') AS number_region, coalesce(x.t, 'UNKNOWN') AS number_type,
  NOT coalesce(x.r <> '001' AND x.barred, false) AS dialled_abroad, x.np AS national_prefix FROM {numbers} n LEFT JOIN {pre}claimed USING (key))"""


def codes() -> str:
    """codes: lengths of the main record of each calling code, by type."""
    plan, rows = default_plan(), []
    kinds = ("general", *TYPES)
    for cc in plan.by_code:
        r = plan.main_record(cc)
        rows.append((cc, *(c for k in kinds for c in (r.lengths(k), r.desc(k).local_lengths))))
    return values("codes", "cc, " + ", ".join(f"{k}_l, {k}_o" for k in kinds), rows)


def _reason(lengths: str, local: str) -> str:
    return f"""CASE WHEN codes.cc IS NULL THEN 'INVALID_COUNTRY_CODE' WHEN len({lengths}) = 0 OR {lengths}[1] = -1 THEN 'INVALID_LENGTH'
  WHEN list_contains({local}, length(nsn)) THEN 'IS_POSSIBLE_LOCAL_ONLY' WHEN length(nsn) < {lengths}[1] THEN 'TOO_SHORT' WHEN length(nsn) > {lengths}[-1] THEN 'TOO_LONG'
  WHEN list_contains({lengths}, length(nsn)) THEN 'IS_POSSIBLE' ELSE 'INVALID_LENGTH' END"""


def reason(numbers: str, kind: str, name: str = "reasons") -> str:
    return f"{name} AS (SELECT key, {_reason(f'{kind}_l', f'{kind}_o')} AS reason FROM {numbers} LEFT JOIN codes ON codes.cc = {numbers}.cc)"


def reason_fixed_or_mobile(numbers: str, name: str) -> str:
    mobile = "len(mobile_l) > 0 AND mobile_l[1] <> -1"
    lengths = f"(CASE WHEN {mobile} THEN list_sort(list_concat(fixed_line_l, mobile_l)) ELSE fixed_line_l END)"
    local = f"(CASE WHEN {mobile} THEN list_concat(fixed_line_o, mobile_o) ELSE fixed_line_o END)"
    pick = f"CASE WHEN len(fixed_line_l) > 0 AND fixed_line_l[1] <> -1 THEN {_reason(lengths, local)} ELSE {_reason('mobile_l', 'mobile_o')} END"
    return f"{name} AS (SELECT key, {pick} AS reason FROM {numbers} LEFT JOIN codes ON codes.cc = {numbers}.cc)"


def formats() -> str:
    """fmt: the formats of each calling code's main record, national and international."""
    plan, rows = default_plan(), []
    for cc in plan.by_code:
        r = plan.main_record(cc)
        rows.append((cc, "-", 0, None, None, None, None, None, r.preferred_extn_prefix))
        for kind, found in (("N", r.formats), ("I", r.intl_formats or r.formats)):
            rows += [(cc, kind, i, f.leading_digits[-1] if f.leading_digits else None, f.pattern, re2(f.national_template), re2(f.format), re2(f.carrier_template(CARRIER) if f.carrier_rule else f.national_template), None) for i, f in enumerate(found)]
    return values("fmt", "cc, kind, place, lead_p, pattern, national, plain, carrier, extn", rows)


def formatted(numbers: str) -> str:
    """formatted: all four formats of each number."""
    fits = "(lead_p IS NULL OR regexp_matches(nsn, '^(?:' || lead_p || ')')) AND regexp_full_match(nsn, pattern)"
    pick = lambda k: f"(SELECT key, arg_min(struct_pack(p := pattern, n := national, f := plain, c := fmt.carrier), place) AS x{k} FROM {numbers} n JOIN fmt ON fmt.cc = n.cc AND kind = '{k}' AND {fits} GROUP BY key)"
    ext = "CASE WHEN coalesce(ext, '') <> '' THEN {} || ext ELSE '' END"
    label = ext.format("coalesce(fmt.extn, ' ext. ')")
    punct = quoted(f"[{_MARKS}]+")
    return f"""fn AS {pick('N')}, fi AS {pick('I')},
chosen AS (SELECT n.*, fmt.cc IS NOT NULL AS known, xN.p AS national_pattern, coalesce(regexp_replace(nsn, xN.p, xN.c), nsn) AS by_carrier, coalesce(regexp_replace(nsn, xN.p, xN.f), nsn) AS bare_national, coalesce(regexp_replace(nsn, xN.p, xN.n), nsn) AS nat, coalesce(regexp_replace(nsn, xI.p, xI.f), nsn) AS int_, {label} AS label
  FROM {numbers} n LEFT JOIN fn USING (key) LEFT JOIN fi USING (key) LEFT JOIN fmt ON fmt.cc = n.cc AND fmt.kind = '-'),
formatted AS (SELECT *, '+' || cc || nsn AS e164, CASE WHEN known THEN nat || label ELSE nsn END AS national_format,
  CASE WHEN known THEN '+' || cc || ' ' || int_ || label ELSE nsn END AS international_format, CASE WHEN known THEN '+' || cc || ' ' || int_ ELSE nsn END AS bare,
  CASE WHEN known THEN 'tel:+' || cc || '-' || regexp_replace(regexp_replace(int_, '^' || {punct}, ''), {punct}, '-', 'g') || {ext.format("';ext='")} ELSE nsn END AS rfc3966_format FROM chosen)"""


def area_codes() -> str:
    """areas, from classified and formatted."""
    return r"""ndc AS (SELECT c.key, c.cc, c.zero, number_region, number_type, national_prefix, regexp_extract_all(f.bare, '[0-9]+') AS g FROM classified c JOIN formatted f USING (key)),
lengths AS (SELECT *, CAST(CASE WHEN len(g) < 3 THEN 0 WHEN cc = 54 AND number_type = 'MOBILE' THEN length(g[3]) + 1 ELSE length(g[2]) END AS INTEGER) AS ndc_length FROM ndc),
areas AS (SELECT *, CASE WHEN number_region IN ('ZZ', '001') OR (national_prefix IS NULL AND NOT coalesce(zero, false) AND cc <> 52) OR (number_type = 'MOBILE' AND cc = 86)
  OR NOT (number_type IN ('FIXED_LINE', 'FIXED_LINE_OR_MOBILE') OR (number_type = 'MOBILE' AND cc IN (52, 54, 55, 62, 86))) THEN 0 ELSE ndc_length END AS area_code_length FROM lengths)"""


def extensions(source: str) -> str:
    """cuts: the texts s of `source` without the extension at their ends."""
    extension = "|".join(_EXTENSIONS)
    groups = ", ".join(f"nullif(regexp_extract(s, {quoted(f'(?i)^(?:.*?)(?:{extension})$')}, {k + 1}), '')" for k in range(len(_EXTENSIONS)))
    viable = lambda x: f"strlen({x}) >= 2 AND regexp_full_match({x}, {quoted(f'(?i){_NUMBER}(?:{extension})?')})"
    return f"""cut0 AS (SELECT *, {viable('s')} AS viable, regexp_extract(s, {quoted(f'(?i)^(.*?)(?:{extension})$')}, 1) AS head, coalesce({groups}) AS e FROM {source}),
cuts AS (SELECT *, CASE WHEN e IS NOT NULL AND {viable('head')} THEN head ELSE s END AS number, CASE WHEN {viable('head')} THEN e END AS extension FROM cut0)"""


def match(a: str, b: str) -> str:
    """How alike two parsed numbers with known codes are."""
    zeros = lambda x: f"CASE WHEN coalesce({x}.zero, false) THEN coalesce({x}.zeros, 1) ELSE 0 END"
    return f"""CASE WHEN {a}.ext <> {b}.ext OR {a}.cc <> {b}.cc THEN 'NO_MATCH' WHEN {a}.n = {b}.n AND {a}.ext IS NOT DISTINCT FROM {b}.ext AND {zeros(a)} = {zeros(b)} THEN 'EXACT_MATCH'
  WHEN ends_with({a}.n::VARCHAR, {b}.n::VARCHAR) OR ends_with({b}.n::VARCHAR, {a}.n::VARCHAR) THEN 'SHORT_NSN_MATCH' ELSE 'NO_MATCH' END"""


def regions_for_parsing() -> str:
    """rp: what a parser reads of each region; mp: the same of each code's main record."""
    plan = default_plan()
    cells = lambda r: (r.international_prefix, r.national_prefix_for_parsing, re2(r.national_prefix_transform_rule), r.general.pattern, r.lengths("general"), r.general.local_lengths)
    names = "idd, np, rule, gen_p, gen_l, gen_o"
    return ",\n".join((
        values("rp", f"region, cc, {names}", [(i, r.country_code, *cells(r)) for i, r in plan.regions.items()]),
        values("mp", f"cc, main, {names}", [(c, plan.main_region(c), *cells(plan.main_record(c))) for c in plan.by_code]),
    ))


def _digits(s: str) -> str:
    """The digits of a text; letters by their keys where there are three or more."""
    plain = f"translate({s}, '０１２３４５６７８９', '0123456789')"
    return f"CASE WHEN length(regexp_replace({s}, '[^A-Za-z]', '', 'g')) >= 3 THEN regexp_replace(translate(lower({s}), '{_KEYS[0]}', '{_KEYS[1]}'), '[^0-9]', '', 'g') ELSE regexp_replace({plain}, '[^0-9]', '', 'g') END"


def _length(n: str, lengths: str, local: str) -> str:
    return f"""CASE WHEN len({lengths}) = 0 OR {lengths}[1] = -1 THEN 'INVALID_LENGTH' WHEN list_contains({local}, length({n})) THEN 'IS_POSSIBLE_LOCAL_ONLY'
  WHEN length({n}) < {lengths}[1] THEN 'TOO_SHORT' WHEN length({n}) > {lengths}[-1] THEN 'TOO_LONG' WHEN list_contains({lengths}, length({n})) THEN 'IS_POSSIBLE' ELSE 'INVALID_LENGTH' END"""


def parsed(source: str, name: str = "parsed") -> str:
    """`name`: the texts (key, raw, region) of `source`, parsed; needs regions_for_parsing. For texts
    without a phone context, isub or a second number. A row: error and error_detail, or else cc, n,
    nsn, ext, zero, zeros, origin and carrier."""
    x = name
    extension = "|".join(_EXTENSIONS)
    groups = ", ".join(f"nullif(regexp_extract(t, {quoted(f'(?i)^(?:.*?)(?:{extension})$')}, {k + 1}), '')" for k in range(len(_EXTENSIONS)))
    return f"""{x}_a AS (SELECT key, raw, region, regexp_replace(regexp_extract(coalesce(raw, ''), '(?s)[+＋\\p{{Nd}}].*'), '[^\\p{{N}}\\p{{L}}#]+$', '') AS t FROM {source}),
{x}_b AS (SELECT *, t = '' AS none, strlen(t) >= 2 AND regexp_full_match(t, {quoted(f'(?i){_NUMBER}(?:{extension})?')}) AS viable,
  regexp_extract(t, {quoted(f'(?i)^(.*?)(?:{extension})$')}, 1) AS body, coalesce({groups}) AS e FROM {x}_a),
{x}_c AS (SELECT b.*, rp.* EXCLUDE (region), e IS NOT NULL AND strlen(body) >= 2 AND regexp_full_match(body, {quoted(f'(?i){_NUMBER}(?:{extension})?')}) AS cut,
  CASE WHEN e IS NOT NULL AND strlen(body) >= 2 AND regexp_full_match(body, {quoted(f'(?i){_NUMBER}(?:{extension})?')}) THEN body ELSE t END AS num FROM {x}_b b LEFT JOIN rp ON rp.region = b.region),
{x}_d AS (SELECT *, regexp_matches(num, '^[+＋]') AS plus FROM {x}_c),
{x}_e AS (SELECT *, 1 AS try, plus AS signed, regexp_replace(num, '^[+＋]+', '') AS rest FROM {x}_d WHERE viable UNION ALL SELECT *, 2, false, regexp_replace(num, '^[+＋]+', '') FROM {x}_d WHERE viable AND plus),
{x}_f AS (SELECT *, {_digits('rest')} AS digits FROM {x}_e),
{x}_g AS (SELECT *, regexp_replace(digits, '^(?:' || idd || ')', '') AS after, regexp_matches(digits, '^(?:' || idd || ')') AS dialled FROM {x}_f),
{x}_h AS (SELECT *, CASE WHEN signed THEN 'FROM_NUMBER_WITH_PLUS_SIGN' WHEN dialled AND left(after, 1) <> '0' THEN 'FROM_NUMBER_WITH_IDD' END AS via FROM {x}_g),
{x}_i AS (SELECT *, CASE WHEN via = 'FROM_NUMBER_WITH_IDD' THEN after ELSE digits END AS d,
  via IS NULL AND starts_with(digits, cc::VARCHAR) AND ((NOT regexp_full_match(digits, gen_p) AND regexp_full_match(substr(digits, 1 + length(cc::VARCHAR)), gen_p)) OR {_length('digits', 'gen_l', 'gen_o')} = 'TOO_LONG') AS own FROM {x}_h),
{x}_j AS (SELECT i.*, (SELECT min(length(mp.cc::VARCHAR)) FROM mp WHERE via IS NOT NULL AND starts_with(d, mp.cc::VARCHAR)) AS k FROM {x}_i i),
{x}_k AS (SELECT *, CASE WHEN via IS NOT NULL AND length(d) <= 2 THEN 'TOO_SHORT_AFTER_IDD' WHEN via IS NOT NULL AND k IS NULL THEN 'INVALID_COUNTRY_CODE' END AS bad,
  CASE WHEN via IS NOT NULL THEN substr(d, 1, k)::INTEGER WHEN own THEN cc ELSE 0 END AS code,
  CASE WHEN via IS NOT NULL THEN substr(d, k + 1) WHEN own THEN substr(d, 1 + length(cc::VARCHAR)) ELSE d END AS national,
  coalesce(via, CASE WHEN own THEN 'FROM_NUMBER_WITHOUT_PLUS_SIGN' ELSE 'FROM_DEFAULT_COUNTRY' END) AS origin FROM {x}_j),
{x}_l AS (SELECT a.key, CASE WHEN a.bad = 'INVALID_COUNTRY_CODE' AND b.key IS NOT NULL THEN struct_pack(bad := CASE WHEN b.bad IS NULL AND b.code = 0 THEN 'INVALID_COUNTRY_CODE' ELSE b.bad END, code := b.code, n := b.national, origin := b.origin)
  ELSE struct_pack(bad := a.bad, code := a.code, n := a.national, origin := a.origin) END AS x FROM {x}_k a LEFT JOIN {x}_k b ON b.key = a.key AND b.try = 2 WHERE a.try = 1),
{x}_m AS (SELECT d.key, d.raw, d.region, CASE WHEN cut THEN e END AS e, x.origin, x.n AS n0, CASE WHEN x.code = 0 THEN d.cc ELSE x.code END AS cc,
  CASE WHEN none THEN 'NOT_A_NUMBER' WHEN NOT viable THEN 'NOT_A_NUMBER' WHEN d.cc IS NULL AND NOT plus THEN 'INVALID_COUNTRY_CODE' ELSE x.bad END AS bad,
  CASE WHEN none THEN 'NO_VALID_START_CHARACTER' WHEN NOT viable THEN 'NOT_MATCHED_VALID_NUMBER_PATTERN' END AS detail,
  CASE WHEN x.code <> 0 AND mp.main IS DISTINCT FROM d.region THEN struct_pack(np := mp.np, rule := mp.rule, p := mp.gen_p, l := mp.gen_l, o := mp.gen_o) WHEN d.cc IS NOT NULL THEN struct_pack(np := d.np, rule := d.rule, p := d.gen_p, l := d.gen_l, o := d.gen_o) END AS r
  FROM {x}_d d LEFT JOIN {x}_l USING (key) LEFT JOIN mp ON mp.cc = x.code),
{x}_n AS (SELECT *, coalesce(r.np, '') <> '' AND regexp_matches(n0, '^(?:' || r.np || ')') AS prefixed, regexp_extract(n0, '^(?:' || r.np || ')()', 1) AS g FROM {x}_m),
{x}_o AS (SELECT *, CASE WHEN NOT prefixed THEN n0 WHEN r.rule <> '' AND g <> '' THEN regexp_replace(n0, '^(?:' || r.np || ')', r.rule) ELSE regexp_replace(n0, '^(?:' || r.np || ')', '') END AS changed,
  CASE WHEN prefixed AND NOT (r.rule <> '' AND g <> '') THEN nullif(g, '') END AS c FROM {x}_n),
{x}_p AS (SELECT *, coalesce(prefixed AND NOT (regexp_full_match(n0, r.p) AND NOT regexp_full_match(changed, r.p)) AND {_length('changed', 'r.l', 'r.o')} NOT IN ('IS_POSSIBLE_LOCAL_ONLY', 'TOO_SHORT', 'INVALID_LENGTH'), false) AS strip FROM {x}_o),
{x}_q AS (SELECT *, CASE WHEN strip THEN changed ELSE n0 END AS nsn0, CASE WHEN strip THEN c END AS carrier0 FROM {x}_p),
{x}_r AS (SELECT *, coalesce(bad, CASE WHEN length(n0) < 2 OR length(nsn0) < 2 THEN 'TOO_SHORT_NSN' WHEN length(nsn0) > 17 THEN 'TOO_LONG_NSN' END) AS error,
  CASE WHEN length(nsn0) >= 2 AND starts_with(nsn0, '0') THEN length(nsn0) - length(ltrim(nsn0, '0')) - CASE WHEN ltrim(nsn0, '0') = '' THEN 1 ELSE 0 END END AS z FROM {x}_q),
{x} AS (SELECT key, raw, region, error, CASE WHEN bad = 'NOT_A_NUMBER' THEN detail END AS error_detail, CASE WHEN error IS NULL THEN cc END AS cc, CASE WHEN error IS NULL THEN nsn0::BIGINT END AS n,
  CASE WHEN error IS NULL THEN repeat('0', coalesce(z, 0)) || nsn0::BIGINT END AS nsn, CASE WHEN error IS NULL THEN e END AS ext, CASE WHEN error IS NULL AND z IS NOT NULL THEN true END AS zero,
  CASE WHEN error IS NULL AND z > 1 THEN z::INTEGER END AS zeros, CASE WHEN error IS NULL THEN origin END AS origin, CASE WHEN error IS NULL THEN carrier0 END AS carrier FROM {x}_r)"""


def callers() -> str:
    """callers: how the regions of the queries dial abroad."""
    plan, rows = default_plan(), []
    for i in ("US", "AU", "MX", "UZ"):
        r = plan.regions[i]
        rows.append((i, r.country_code, r.preferred_international_prefix or (r.international_prefix if r.international_prefix.isdigit() else "")))
    return values("callers", "caller, here, idd", rows)


def abroad(classified: str = "classified", formatted: str = "formatted") -> str:
    """abroad: each of `formatted` as dialled from its caller, and for a mobile; needs callers, mp."""
    return f"""abroad AS (SELECT f.*, CASE WHEN here IS NULL THEN international_format WHEN NOT known THEN nsn WHEN f.cc = 1 AND here = 1 THEN '1 ' || national_format WHEN f.cc <> 1 AND f.cc = here THEN national_format
  WHEN idd <> '' THEN idd || ' ' || f.cc || ' ' || int_ || label ELSE international_format END AS abroad FROM {formatted} f LEFT JOIN callers USING (caller)),
mobile AS (SELECT a.*, c.number_type, CASE WHEN mp.cc IS NULL THEN coalesce(raw, '') WHEN caller = mp.main THEN
    CASE WHEN CASE WHEN a.cc = 1 THEN c.dialled_abroad AND {_length('a.nsn', 'mp.gen_l', 'mp.gen_o')} <> 'TOO_SHORT' ELSE c.dialled_abroad AND mp.main IN ('MX', 'CL', 'UZ') AND c.number_type IN ('FIXED_LINE', 'MOBILE', 'FIXED_LINE_OR_MOBILE') END THEN bare ELSE nat END
  WHEN c.number_type <> 'UNKNOWN' AND c.dialled_abroad THEN bare ELSE '' END AS mobile FROM abroad a JOIN {classified} c ON c.key = a.key LEFT JOIN mp ON mp.cc = a.cc)"""


def original() -> str:
    """original: each of `mobile` as it was written; needs the CTE `again` (key, ok): whether what is
    left of the text without a national prefix is a valid number."""
    diallable = "regexp_replace({}, '[^0-9+*#]', '', 'g')"
    ndd = values("ndd", "main, prefix, no_rule", [(i, (r.national_prefix or "").replace("~", ""), False) for i, r in default_plan().regions.items()])
    plain = values("ruled", "cc, p, has", [(c, f.pattern, bool(f.national_prefix_rule) and "$1" in f.national_prefix_rule and any(x.isdigit() for x in f.national_prefix_rule.split("$1")[0])) for c in default_plan().by_code for f in default_plan().main_record(c).formats])
    return f"""{ndd}, {plain},
national_only AS (SELECT m.key, CASE WHEN ndd.main IS NULL OR coalesce(again.ok, false) OR NOT coalesce(bool_or(ruled.has), false) THEN any_value(national_format) ELSE any_value(bare_national || label) END AS s
  FROM mobile m LEFT JOIN mp ON mp.cc = m.cc LEFT JOIN ndd ON ndd.main = mp.main LEFT JOIN again ON again.key = m.key LEFT JOIN ruled ON ruled.cc = m.cc AND ruled.p = national_pattern GROUP BY m.key, ndd.main, again.ok),
worded AS (SELECT m.*, CASE origin WHEN 'FROM_NUMBER_WITH_PLUS_SIGN' THEN international_format WHEN 'FROM_NUMBER_WITH_IDD' THEN abroad WHEN 'FROM_NUMBER_WITHOUT_PLUS_SIGN' THEN substr(international_format, 2) ELSE s END AS w FROM mobile m JOIN national_only USING (key)),
original AS (SELECT *, CASE WHEN national_pattern IS NULL OR (w <> '' AND {diallable.format('w')} <> {diallable.format('raw')}) THEN raw ELSE w END AS original FROM worded)"""


def lettered() -> str:
    """lettered: each of `dialling` as dialled from its caller, with its letters; needs fn, fmt, mp."""
    plan, rows = default_plan(), []
    for i, idd in (("US", "011"), ("AU", "0011"), ("MX", "00"), ("UZ", "810")):
        rows.append((i, plan.regions[i].country_code, idd))
    rules = {(c, f.pattern, f.national_template): re2(with_rule("$1$2", f.national_prefix_rule) if f.national_prefix_rule else "$1$2") for c in (61, 52, 998) for f in plan.main_record(c).formats}
    ruled = values("letter_rules", "cc, p, n, t", [(c, p, re2(n), t) for (c, p, n), t in rules.items()])
    kept = "regexp_replace(upper(raw), '[^A-Z0-9/ .-]', '', 'g')"
    cut = f"CASE WHEN length(nsn) > 3 THEN substr({kept}, greatest(1, strpos({kept}, left(nsn, 3)))) ELSE {kept} END"
    return f"""{values("from_here", "caller, here, idd", rows)}, {ruled},
g AS (SELECT f.*, {cut} AS g, here, h.idd AS way FROM formatted f LEFT JOIN from_here h USING (caller)),
far AS (SELECT key, CASE WHEN here IS NULL THEN '+' || cc || ' ' || g ELSE way || ' ' || cc || ' ' || g END AS s FROM g), {extensions('far')},
lettered AS (SELECT g.key, CASE WHEN g.cc = 1 AND here = 1 THEN '1 ' || g WHEN g.cc <> 1 AND here = g.cc THEN CASE WHEN t IS NULL THEN g ELSE regexp_replace(g, '([0-9]+)(.*)', t) END ELSE number || label END AS abroad_letters
  FROM g JOIN cuts ON cuts.key = g.key LEFT JOIN fn ON fn.key = g.key LEFT JOIN letter_rules r ON r.cc = g.cc AND r.p = fn.xN.p AND r.n = fn.xN.n)"""


def types() -> str:
    """types: one row for each record and type."""
    rows = [(r.id, r.country_code, k.upper(), r.desc(k).pattern, r.desc(k).lengths, r.desc(k).example) for r in default_plan().records for k in TYPES]
    return values("types", "region, cc, type, pattern, lengths, example", rows)
