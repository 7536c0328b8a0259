import hashlib
import random
import re

from callgrid.llm import secrets
from callgrid.llm.automaton import Automaton, mirrored, parse

BASE = [
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
]


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in p.finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts(n, seed=3):
    r = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAB2", "0a1b2c3d", "deadbeef", "é", "ſecret", "\n", "Z9", "-", "x", "token=secret", "/", "AKIA" + "Q7" * 9, "ab" * 13, "日本"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(3000))] + [(-1, None), (None, "token=abcdefgh"), (7, "token=abcdefgh")]
    got = {(r.doc_id, r.n): r for r in spark.createDataFrame(rows, "doc_id long, text string").transform(secrets.find_secrets).selectExpr("*", "0 as n").collect() if r.doc_id != 7}
    for i, t in rows[:3000]:
        if i == 7:
            continue
        want = brute(t)
        r = got[i, 0]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), t
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
    assert got[-1, 0].spans == "" and got[None, 0].spans == "assign:0:14"


def test_other_kinds_and_redaction(spark):
    key = "ghp_" + "aB3" * 12
    text = f"é see {key} and -----BEGIN RSA PRIVATE KEY----- or https://me:pa55@host"
    df = spark.createDataFrame([(1, text, 5, "z"), (2, None, None, "q")], "doc_id long, text string, n_chars long, spans string")
    spans = df.transform(secrets.find_secrets).where("doc_id = 1").first().spans
    assert [s.split(":")[0] for s in spans.split(",")] == ["github", "private_key", "url_login"]
    out = df.transform(secrets.redact_documents).orderBy("doc_id").collect()
    assert out[0].text == "é see [github] and [private_key] or https[url_login]host" and out[0].n_chars == len(out[0].text)
    assert out[1].text is None and out[1].spans == "q"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert df.transform(secrets.find_secrets).count() == 0


def test_long_text(spark):
    text = "word " * 600_000 + "AKIA" + "A1" * 10
    r = spark.createDataFrame([(1, text)], "doc_id long, text string").transform(secrets.find_secrets).first()
    assert r.spans == f"access:3000000:{len(text)}"


def test_minimal_automaton_equals_re():
    r = random.Random(1)
    for p in ["a(b|c)*d", "[ab]{2,3}c?", "(ab|a)+", "a?b+", "[^a]b{2}"]:
        a = Automaton([mirrored(parse(p))])
        for _ in range(200):
            s = "".join(r.choice("abcd") for _ in range(12))
            want = [i for i in range(13) if re.compile(p).match(s, i) or any(re.compile(p).fullmatch(s, i, j) for j in range(i, 13))]
            want = [i for i in want if i < 12 and any(re.compile(p).fullmatch(s, i, j) for j in range(i + 1, 13))]
            assert [i for i, _ in a.backward(s.encode())] == want


def test_ends_equal_re():
    """The longest match of each rule from a place, and whether its group 2 is long enough."""
    r = random.Random(2)
    rules = ["a(b|c)*d", "(a)b*([cd]+)", "[ab]{2,3}c?", "(ab|a)+"]
    both = [parse(p, held=held) for held in (0, 3) for p in rules]
    f = Automaton(both, search=False)
    for _ in range(400):
        s = "".join(r.choice("abcd") for _ in range(14))
        kinds = s.encode().translate(f.kind)
        for i in range(14):
            want = {}
            for k, p in enumerate(rules):
                if ends := [j for j in range(i + 1, 15) if re.compile(p).fullmatch(s, i, j)]:
                    want[k] = ends[-1]
            got = f.ends(kinds, i)
            assert {k: e for k, (e, _) in got.items() if k < 4} == want
            if 1 in want:
                assert bool(got[1][1] >> 5 & 1) == (len(re.compile(rules[1]).fullmatch(s, i, want[1])[2]) >= 3)


def test_texts_stay_apart(spark):
    """A match never runs on into the next text of a batch."""
    rows = [(1, "token="), (2, "abcdefgh"), (3, "AKIA" + "B" * 10), (4, "C" * 10), (5, None), (6, "0" * 20), (7, "0" * 20)]
    got = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).transform(secrets.find_secrets).collect()
    assert all(r.spans == "" for r in got)
