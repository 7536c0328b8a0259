"""Quality rules, line first (operator 10).

Every line is judged by itself; lines that fail are removed, and a document is rejected
when the base counts fail it or when its failing lines held too many of its words.

Line rules, for a line with w words (characters counted over the whole line):

* navigation: at least 3 ``|`` and 4 * bars >= w
* symbols: w >= 3 and 2 * symbols of ``#*$%&|<>`` >= w
* shouting: w >= 3 and 2 * ``!`` >= w
* punctuation: w >= 40 and none of ``.?!``
* boilerplate: one of BOILERPLATE, in any ASCII case

A document is kept when base_failed is false and at most MAX_LOST_PERCENT of its words
stand in failing lines.

Defined results: a null or empty text has no words, so base_failed is true and kept is
false; a null doc_id is passed on; repeated rows are judged alike, one row each; an empty
table gives an empty result; other columns are neither read nor changed. Memory is
bounded by about 1 MB of text at a time (or one longer text).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import code_point_counts, flat_text, mix64, run_hashes, same_runs, slices, word_runs

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "licensed under the", "click here to")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_lost_words long"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _ENDERS, _SPACES = _table(b"#*$%&|<>"), _table(b".?!"), _table(b" \t\n\v\f\r")


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeated(keys: np.ndarray, same) -> np.ndarray | None:
    """Places of keys that stand twice, pairs of neighbours (earlier, later) in columns; None if
    equal keys stand for unlike things by same(earlier, later)."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    earlier, later = order[at], order[at + 1]
    return np.stack((earlier, later)) if same(earlier, later).all() else None


def _repeat_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document inside a 3-word window that the document holds twice."""
    n, docs = len(starts), len(first) - 1
    if n < 3:
        return np.zeros(docs, np.int64)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(first))
    hashes, size = run_hashes(text, starts, ends), ends - starts
    c = np.uint64(0x9E3779B97F4A7C15)
    key = mix64(((hashes[:-2] * c + hashes[1:-1]) * c + hashes[2:]) ^ mix64(owner[:-2] + np.uint64(1)))
    whole = np.flatnonzero(owner[:-2] == owner[2:])

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = whole[a], whole[b]
        like = owner[a] == owner[b]
        for k in range(3):
            alike = size[a + k] == size[b + k]
            like &= alike & same_runs(text, starts[a + k], starts[b + k], np.where(alike, size[a + k], 0))
        return like

    found = _repeated(key[whole], same)
    twice = np.zeros(n - 2, bool)
    if found is not None:
        twice[whole[found.ravel()]] = True
    else:
        raw = text.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        often = Counter(zip(owner[whole].tolist(), *([words[i + k] for i in whole] for k in range(3)), strict=True))
        twice[whole] = [often[int(owner[i]), words[i], words[i + 1], words[i + 2]] > 1 for i in whole]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return np.diff(_sums(covered)[first])


def _dup_lines(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each line equals an earlier one of its document."""
    key = mix64(run_hashes(text, starts, ends) ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    size = ends - starts

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = (owner[a] == owner[b]) & (size[a] == size[b])
        return alike & same_runs(text, starts[a], starts[b], np.where(alike, size[a], 0))

    found = _repeated(key, same)
    again = np.zeros(len(starts), bool)
    if found is not None:
        again[found[1]] = True
        return again
    raw, seen = text.tobytes(), set()
    for i, x in enumerate(zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        line = x[0], raw[x[1] : x[2]]
        again[i] = line in seen
        seen.add(line)
    return again


def _judge(flat: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each document, and (start, end, failed) of each line."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text, offs = flat[lo:hi], offsets - lo
    docs = len(offs) - 1
    begin, stop, first = word_runs(text, offs)
    out = {"n_words": np.diff(first), "n_repeat_words": _repeat_words(text, begin, stop, first)}
    spaces = _SPACES[text]
    out["word_chars"] = code_point_counts(text, offs) - np.diff(_sums(spaces)[offs])
    symbols = _sums(_SYMBOLS[text])
    out["n_symbols"] = np.diff(symbols[offs])
    # lines: each document has one more than it has newlines
    breaks = np.flatnonzero(text == 10)
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")
    owner = np.repeat(np.arange(docs), np.diff(np.searchsorted(breaks, offs)) + 1)
    word = ~spaces
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[offs[:-1][offs[:-1] < len(text)]] = word[offs[:-1][offs[:-1] < len(text)]]
    words = _sums(begins)
    w = words[ends] - words[starts]
    full = np.flatnonzero(w > 0)
    again = _dup_lines(text, starts[full], ends[full], owner[full])
    out["n_dup_lines"] = np.bincount(owner[full][again], minlength=docs)

    count = lambda mask: (s := _sums(mask))[ends] - s[starts]
    bars, syms = count(text == ord("|")), symbols[ends] - symbols[starts]
    bangs, enders = count(text == ord("!")), count(_ENDERS[text])
    failed = (bars >= 3) & (4 * bars >= w) | (w >= 3) & (2 * syms >= w) | (w >= 3) & (2 * bangs >= w) | (w >= 40) & (enders == 0)
    lowered = text.tobytes().lower()
    for phrase in BOILERPLATE:
        at = lowered.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(starts, at, side="right")) - 1
            if at + len(phrase) <= ends[line]:
                failed[line] = True
            at = lowered.find(phrase.encode(), at + 1)
    failed &= w > 0
    out["n_lines"] = np.bincount(owner[full], minlength=docs)
    out["n_failed_lines"] = np.bincount(owner[failed], minlength=docs)
    out["n_lost_words"] = np.bincount(owner[failed], weights=w[failed], minlength=docs).astype(np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_lost_words"] <= MAX_LOST_PERCENT * out["n_words"])
    return out, starts, ends, failed


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        flat, offsets = flat_text(batch.column(1))
        for i, j in slices(offsets):
            counts = _judge(flat, offsets[i : j + 1])[0]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(counts[n]) for n in names[1:])], names=names)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the base counts, the line counts and the verdict."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_judged, SCHEMA)


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents, with all their columns, without the lines that fail.

    n_chars, where docs has it, becomes the length of the new text.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column(at))
            for i, j in slices(offsets):
                offs = offsets[i : j + 1]
                counts, starts, ends, failed = _judge(flat, offs)
                text = flat[offs[0] : offs[-1]].tobytes()
                rows = np.flatnonzero(counts["kept"])
                owner = np.searchsorted(starts, offs - offs[0])
                owner[-1] = len(starts)
                out = []
                for r in rows:
                    a, b = int(offs[r] - offs[0]), int(offs[r + 1] - offs[0])
                    if counts["n_failed_lines"][r]:
                        lines = range(owner[r], owner[r] + 1 + text.count(b"\n", a, b))
                        out.append(b"\n".join(text[starts[x] : ends[x]] for x in lines if not failed[x]).decode())
                    else:
                        out.append(text[a:b].decode())
                part = batch.slice(i, j - i).take(pa.array(rows))
                arrays = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = docs.mapInArrow(cleaned, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


_W = r"[^ \t\n\v\f\r]+"
#: The same counts and rules, for DuckDB.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\x0C\r]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^ \t\n\x0B\x0C\r]+')) AS w,
  len(regexp_replace(line, '[^|]', '', 'g')) AS bars, len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms,
  len(regexp_replace(line, '[^!]', '', 'g')) AS bangs, len(regexp_replace(line, '[^.?!]', '', 'g')) AS enders FROM lines),
g AS (SELECT *, (bars >= 3 AND 4 * bars >= w) OR (w >= 3 AND 2 * syms >= w) OR (w >= 3 AND 2 * bangs >= w) OR (w >= 40 AND enders = 0)
  OR regexp_matches(line, '(?i)({"|".join(BOILERPLATE)})') AS failed FROM f WHERE w > 0),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
  coalesce(sum(w) FILTER (failed), 0) AS n_lost_words FROM g GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept, n_lines, n_failed_lines, n_lost_words FROM b
"""
