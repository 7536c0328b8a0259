import random
import time

import numpy as np

from callgrid.llm import linededup

R, S = 50, 25


def dedup(df, **more):
    return linededup.dedup_lines(df, run_words=R, span_words=S, **more)


def picked(h, w, run=R, span=S):
    """The selected spans by plain loops: of every window the span with the least hash."""

    def reach(i, words):
        n, j = 0, i
        while n < words and j < len(w):
            n += w[j]
            j += 1
        return j if n >= words else None

    spans = [(i, e) for i in range(len(w)) if (e := reach(i, span)) is not None]
    keys = {i: int(linededup._range_keys(h, np.array([i]), np.array([e]))[0]) for i, e in spans}
    out = set()
    for i, _ in spans:
        end = reach(i, run)
        if end is None and i:
            break
        inside = [j for j, e in spans if j >= i and (end is None or e <= end)]
        out.add(min(inside, key=lambda j: (keys[j], j)))
    return sorted(out)


def corpus(seed, docs=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(r.choice([3, 8, 20, 30, 60])) for _ in range(25)]
    out = []
    for i in range(docs):
        k = r.randrange(0, 12)
        lines = []
        for _ in range(k):
            c = r.random()
            if c < 0.3:
                a = r.randrange(len(shared) - 3)
                lines += shared[a : a + r.randint(1, 4)]
            elif c < 0.4:
                lines.append(r.choice(["", "  ", "\t"]))
            else:
                lines.append(line(r.choice([2, 9, 15, 40])))
        out.append((i, "\n".join(lines)))
    out += [(docs + i, out[i * 3][1]) for i in range(10)]
    return out


def brute(rows):
    """The same definition over plain lists of lines: spans, windows, first places, runs."""
    docs = [(i, [x.strip() for x in (t or "").split("\n") if x.strip()]) for i, t in rows]
    picks = {}
    where = {}
    for i, lines in docs:
        h, w, *_ = linededup._line_table(*_flat("\n".join(lines)))
        assert len(h) == len(lines) and [len(x.split()) for x in lines] == w.tolist()
        found = linededup.selected(h, w, S, R)
        assert [p for _, p in found] == picked(h, w)
        # the guarantee: every run of R words holds a selected span
        at = {p for _, p in found}
        for a in range(len(lines)):
            b, n = a, 0
            while b < len(lines) and n < R:
                n += len(lines[b].split())
                b += 1
            if n >= R:
                assert any(a <= p and _stop(lines, p) <= b for p in at), (lines, at)
        for _, p in found:
            span = tuple(lines[p : _stop(lines, p)])
            picks.setdefault(i, []).append((span, p))
            where.setdefault(span, []).append((i, p))
    first = {s: min(v) for s, v in where.items()}
    text = dict(docs)
    gone = {}
    for i, lines in docs:
        meets = {(first[s][0], p - first[s][1]) for s, p in picks.get(i, []) if first[s] != (i, p)}
        for src, off in meets:
            x = 0
            while x < len(lines):
                y = x
                while y < len(lines) and 0 <= y - off < len(text[src]) and lines[y] == text[src][y - off]:
                    y += 1
                if sum(len(z.split()) for z in lines[x:y]) >= S:
                    gone.setdefault(i, set()).update(range(x, y))
                x = max(y, x + 1)
    return gone


def _stop(lines, p):
    n = 0
    while n < S:
        n += len(lines[p].split())
        p += 1
    return p


def _flat(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        gone = brute(rows)
        got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(got) == len(rows) and gone
        for i, t in rows:
            want, _, _ = linededup._without(t, sorted(gone.get(i, ())))
            assert got[i].text == want and got[i].n_lines_removed == len(gone.get(i, ())), i


def test_long_repeated_lines_stay_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own line {i} here\n{passage}\nend {i}") for i in range(30)] + [(40, f"{passage}\n{passage}")]
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if passage in got[i]] == [0] and got[7] == "own line 7 here\nend 7" and got[40] == ""


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage, "a"), (1, None, "b"), (2, "", None), (3, passage, "c"), (3, passage, "c"), (4, " \n\t\n", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = sorted((str(r.doc_id), r.text, r.gone, r.n_lines_removed) for r in dedup(df).collect())
    want = [("None", passage, "a", 0), ("1", None, "b", 0), ("2", "", None, 0), ("3", "", "c", 1), ("3", "", "c", 1), ("4", " \n\t\n", "d", 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert linededup.clean_documents(df).count() == 4
    assert dedup(df.limit(0)).count() == 0


def whole(rows):
    """Lines of later copies of all runs of R words or more."""
    seen, gone = set(), {}
    for i, t in sorted(rows):
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= R and (run := tuple(lines[a : b + 1])) in seen:
                    gone.setdefault(i, set()).update(range(a, b + 1))
                elif n >= R:
                    seen.add(run)
    return gone


def test_whole_runs(spark):
    """A passage of which one line also stands earlier goes in full from its later copies."""
    rows, n = corpus(2), 100
    for k in range(20):
        line = lambda j, m: " ".join(f"p{k}x{j}x{i}" for i in range(m))  # noqa: E731, B023
        passage = "\n".join(line(j, m) for j, m in enumerate((15, 15, 15, 30, 15, 15, 15)))
        rows += [(n, line(3, 30)), (n + 1, passage), (n + 2, f"own {n}\n{passage}\nend")]
        n += 3
    part, full = brute(rows), whole(rows)
    assert any(full[i] - part.get(i, set()) for i in full if i >= 100)
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole_runs=True).collect()}
    for i, t in rows:
        want, _, _ = linededup._without(t, sorted(part.get(i, set()) | full.get(i, set())))
        assert got[i].text == want, i
    assert all(got[i].text == f"own {i - 2}\nend" for i in range(102, n, 3))


def test_no_repeated_line_or_run_stays(spark):
    """With the production lengths: after the query no line, and no run of lines, of RUN_WORDS words
    occurs twice; every line that goes is still there at its first place."""
    run, rows = linededup.RUN_WORDS, corpus(7, 120)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), whole_runs=True).collect()}
    seen, every = set(), set()
    for i, t in rows:
        lines = [x.strip() for x in got[i].split("\n") if x.strip()]
        every |= set(lines)
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= run:
                    assert (x := tuple(lines[a : b + 1])) not in seen, x
                    seen.add(x)
                    break
    assert every == {x.strip() for _, t in rows for x in t.split("\n") if x.strip()}


def test_very_many_repeats_in_one_text(spark):
    """20,000 times one line, and lines of their own between repeated ones, in seconds."""
    line = "one line of more than eight words that stands here again and again, and again."
    other = "\n".join(f"{line}\n{'x' * (i % 7 + 1)} {i} own words of this line, nine of them." for i in range(5_000))
    df = spark.createDataFrame([(1, "\n".join([line] * 20_000)), (2, other), (3, other)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, whole_runs=True).collect()}
    assert got[1] == line and got[3] == "" and got[2].count("\n") == 4_999 and line not in got[2]
    assert time.time() - began < 60


def test_lines_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " and fourteen more words of a line so that it is a run on its own"
    rows = [(1, a + tail), (2, b + tail), (3, a[:1024] + tail), (4, b[:1024] + tail)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), whole_runs=True).collect()
    assert {(r.doc_id, r.text) for r in got} == set(rows)
