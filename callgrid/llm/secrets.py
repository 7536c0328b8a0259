"""Secret scan (operator 5): all rules in one deterministic automaton.

The rules' expressions are reversed, joined, made deterministic by subset construction and
minimised (see automaton). One pass over a text from its end then marks every position
where a match of some rule begins; the marks of a rule, from the left, give its leftmost
non-overlapping matches. A second automaton, of the rules as they stand, runs from each of these
marks to the longest match's end and tells there whether group 2 is long enough. Texts of a
batch are scanned together, parted by a byte that UTF-8 never holds. ASCII only: no letter of
another script folds into a rule.

Spans are in code points, end exclusive. The base kinds are assign, access and hex; the
other kinds only add spans.

Defined results: a null or empty text has no spans (its base_sha256 is that of the empty
string); repeated rows are scanned alike, one row each; a null doc_id is passed on; an
empty table gives an empty result; columns other than the id and the text are not read by
the scan and are passed on by the redaction. Memory is bounded by about 1 MB of text at a
time (or one longer text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.automaton import Automaton, mirrored, parse
from callgrid.llm.common import flat_text, slices

#: Kind, expression, either case?, least length of group 2 or else of the whole match.
RULES = (
    # fixed values of the contract
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    # further kinds
    ("private_key", r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY-----", False, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 16),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 30),
    ("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", False, 24),
    ("url_login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@", False, 0),
)
BASE = 3


@cache
def compiled(rules=RULES) -> tuple[Automaton, Automaton]:
    """The automata of the reversed rules, for beginnings, and of the rules, for ends. The latter
    also has, from bit len(rules) on, each rule with the least length of its group 2."""
    back = Automaton([mirrored(parse(p, fold)) for _, p, fold, _ in rules])
    return back, Automaton([parse(p, fold, held) for least in (False, True) for _, p, fold, n in rules for held in (n if least else 0,)], search=False)


Span = tuple[int, int, int]


def scan(data: bytes, rules=RULES) -> list[Span]:
    """(start, rule number, end) in bytes, sorted, of all matches in data."""
    back, forth = compiled(rules)
    grouped = [parse(p, fold) != parse(p, fold, n) for _, p, fold, n in rules]
    kinds = data.translate(forth.kind)
    out: list[Span] = []
    free = [0] * len(rules)
    for at, bits in back.backward(data):
        mine = [k for k in range(len(rules)) if bits >> k & 1 and at >= free[k]]
        ends = forth.ends(kinds, at) if mine else {}
        for k in mine:
            end, there = ends[k]
            free[k] = end
            if there >> len(rules) + k & 1 if grouped[k] else end - at >= rules[k][3]:
                out.append((at, k, end))
    return sorted(out)


def scan_texts(flat: np.ndarray, offsets: np.ndarray, rules=RULES) -> list[list[Span]]:
    """The spans of each text, in code points."""
    raw = flat[offsets[0] : offsets[-1]].tobytes()
    offs = (offsets - offsets[0]).tolist()
    parts = [raw[a:b] for a, b in zip(offs, offs[1:], strict=False)]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    out: list[list[Span]] = [[] for _ in parts]
    for a, k, b in scan(b"\xff".join(parts), rules):
        i = int(np.searchsorted(begins, a, side="right")) - 1
        out[i].append((a - int(begins[i]), k, b - int(begins[i])))
    for part, spans in zip(parts, out, strict=True):
        if spans and not part.isascii():
            points = np.concatenate(([0], np.cumsum((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)))
            spans[:] = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
    return out


def shown(spans: list[Span], rules=RULES) -> str:
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = flat_text(batch.column(1))
        for i, j in slices(offsets):
            found = scan_texts(flat, offsets[i : j + 1])
            counts = [[sum(k == n for _, k, _ in s) for s in found] for n in range(BASE)]
            base = [hashlib.sha256(shown([x for x in s if x[1] < BASE]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(list(map(shown, found)), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans for each row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found, SCHEMA)


def redacted(text: str, spans: list[Span], rules=RULES) -> str:
    """text with each span, or union of overlapping spans, replaced by its kinds."""
    out, at = [], 0
    groups: list[list] = []
    for a, k, b in spans:
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], b)
            groups[-1][2].append(k)
        else:
            groups.append([a, b, [k]])
    for a, b, kinds in groups:
        out += [text[at:a], "[", "+".join(dict.fromkeys(rules[k][0] for k in kinds)), "]"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with secrets replaced; n_chars, where present, is set anew."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column(at))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                found = scan_texts(flat, offsets[i : j + 1])
                if any(found):
                    texts = [redacted(t, s) if s else t for t, s in zip(part.column(at).to_pylist(), found, strict=True)]
                    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns)], names=names)
                yield part

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
