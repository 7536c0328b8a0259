"""Line dedup (operator 6): winnowing over line hashes.

A document is the sequence of its lines that hold a word, each hashed without the white
space at its ends. The span of a line is the fewest lines from there on that hold span_words
words; its hash is the line's k-gram. A window of a line is the fewest following spans that
together hold run_words words; of every window the span with the least hash is selected (the
leftmost of equals). So any run of run_words words that two documents share holds, in both,
one selected span with the same hash: a guaranteed fingerprint. A line of run_words words is a
window of its own and always selected.

Selected spans are joined with the first occurrence of their hash, first by (doc_id, hash of
the text, position). A document then meets each earlier document at offsets between their lines;
along an offset the match is extended both ways as far as lines are equal, and every run
of at least span_words words is deleted from the later place. The first occurrence stays.
So of any run of run_words words that occurs more than once, a later copy loses at least
the spans that the selection guarantees and whatever else it shares with the place where
those occurred first.

With whole_runs, as op6_line_dedup and the pipeline run it, nothing of a repeated run stays
behind, whatever other documents hold single lines of it: at each line begins, and ends, a run of
the fewest whole lines that hold run_words words; every such run of several lines is joined with
its first occurrence as well, and all its later places are deleted too. So no line, and no run of
lines, of run_words words or more stays anywhere but at its first place. What is deleted stands at
an earlier place that stays. Both lengths are parameters; lines and runs of fewer words than
span_words are left alone.

Frequent lines: hashes are counted before the shuffle and joined with one first occurrence
each, never with one another, so the rows grow with the input. Two documents meet in one row with
all their offsets, and of the earlier document only the lines that can face the later one are
carried; a text that repeats one line very often meets itself in one row.

Defined results: a null text stays null, an empty one empty; lines without words are never
matched or deleted; rows with the same doc_id and text are one document and get the same
result; a null doc_id comes first in the order; an empty table gives an empty result; all
other columns are passed on. A very long text is held as a whole, with its lines' hashes, by the
tasks that read it. Lines are compared as 64-bit hashes, in which every byte counts by its place:
two different ones are equal with a chance of 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import Scratch, flat_text, mix64, run_hashes, slices

#: Words of the shortest span that is matched, and of the shortest run that always goes.
SPAN_WORDS, RUN_WORDS = 8, 15

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _line_table(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, line number, first) of the lines with words; text i: first[i]:first[i + 1]."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text, offs = flat[lo:hi], offsets - lo
    n = hi - lo
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[text]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    words = np.concatenate(([0], np.cumsum(begin)))
    breaks = np.flatnonzero(text == 10)
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")
    per = np.diff(np.searchsorted(breaks, offs)) + 1
    number = np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
    owner = np.repeat(np.arange(len(per)), per)
    w = words[ends] - words[starts]
    full = w > 0
    # first and last byte of a word in each line
    at = np.flatnonzero(word)
    a = at[np.searchsorted(at, starts[full])]
    b = at[np.searchsorted(at, ends[full]) - 1] + 1
    return run_hashes(text, a, b), w[full], number[full], np.searchsorted(owner[full], np.arange(len(per) + 1))


def _range_keys(h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the ranges of lines begin:stop."""
    up = np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(len(begin), np.uint64)
    length = stop - begin
    for k in range(int(length.max()) if len(begin) else 0):
        on = np.flatnonzero(length > k)
        key[on] = mix64(key[on] * up + h[begin[on] + k])
    return mix64(key ^ length.astype(np.uint64))


def _whole_runs(w: np.ndarray, words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of fewest lines with so many words that begin or end at a line:
    together they cover every longer run. Single lines are left out: they are selected spans."""
    n = len(w)
    total = np.concatenate(([0], np.cumsum(w)))
    stop = np.searchsorted(total, total[:-1] + words)
    a = np.flatnonzero(stop <= n)
    b = np.flatnonzero(total >= words)
    begin = np.searchsorted(total, total[b] - words, side="right") - 1
    both = np.unique(np.concatenate((a * (n + 1) + stop[a], begin * (n + 1) + b)))
    begin, stop = both // (n + 1), both % (n + 1)
    return begin[stop > begin + 1], stop[stop > begin + 1]


def selected(h: np.ndarray, w: np.ndarray, span_words: int = SPAN_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(hash, position) of the selected spans of one document's lines."""
    n = len(h)
    total = np.concatenate(([0], np.cumsum(w)))
    stop = np.searchsorted(total, total[:-1] + span_words)  # the span of i is i:stop[i]
    m = int((stop <= n).sum())  # the spans that are whole
    if not m:
        return []
    stop = stop[:m]
    key = _range_keys(h, np.arange(m), stop)
    picks: set[int] = set()
    # the window of i holds the spans i..last[i] that lie in the fewest lines with enough words
    end = np.searchsorted(total, total[:m] + run_words)
    last = np.searchsorted(stop, end, side="right") - 1
    keys, best, reach = key.tolist(), -1, -1
    for i in range(m):
        if end[i] > n and i:
            break  # too few words are left for another window
        j = int(last[i])
        if best < i:
            best = min(range(i, j + 1), key=lambda x: (keys[x], x))
            reach = j
        else:
            for x in range(reach + 1, j + 1):
                if keys[x] < keys[best]:
                    best = x
            reach = max(reach, j)
        picks.add(best)
    signed = key.view(np.int64)
    return [(int(signed[p]), p) for p in sorted(picks)]


LINES = "doc_id long, th long, h array<long>, w array<int>, keys array<long>, at array<int>"


def _lined(span_words: int, run_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = flat_text(batch.column(2))
        for i, j in slices(offsets):
            h, w, _, first = _line_table(flat, offsets[i : j + 1])
            keys, at = [], []
            for a, b in zip(first, first[1:], strict=False):
                found = selected(h[a:b], w[a:b], span_words, run_words)
                keys.append([k for k, _ in found])
                at.append([p for _, p in found])
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v, t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], lists(h.view(np.int64), pa.int64()), lists(w, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "th", "h", "w", "keys", "at"],
            )


def _whole(run_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of run_words words that begin or end at each line, of rows of LINES."""
    for batch in batches:
        hs, ws, row, keys, at, ends = batch.column(2), batch.column(3), [], [], [], []
        for k in range(batch.num_rows):
            begin, stop = _whole_runs(ws[k].values.to_numpy().astype(np.int64), run_words)
            if len(begin):
                row.append(np.full(len(begin), k))
                keys.append(_range_keys(hs[k].values.to_numpy().view(np.uint64), begin, stop).view(np.int64))
                at.append(begin)
                ends.append(stop)
        if row:
            rows = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(ends), pa.int32())],
                names=["doc_id", "th", "key", "at", "stop"],
            )


def _runs(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, begin: int, offs: np.ndarray, least: int) -> np.ndarray:
    """The lines of `later` that stand, at one of the offsets, in a run of `least` words that is
    equal in `earlier`: line x faces line x - offset, of which `earlier` has those from begin on."""
    n, total = len(later), np.concatenate(([0], np.cumsum(words)))
    left = np.arange(n)  # lines not yet in such a run
    gone = np.zeros(n, bool)
    for off in sorted(np.asarray(offs).tolist(), key=abs):
        a, b = max(0, begin + off), min(n, begin + len(earlier) + off)
        x = left[np.searchsorted(left, a) : np.searchsorted(left, b)]
        if not (later[x] == earlier[x - off - begin]).any():
            continue
        same = later[a:b] == earlier[a - off - begin : b - off - begin]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])))) + a
        start, stop = edge[::2], edge[1::2]
        whole = total[stop] - total[start] >= least
        mark = np.zeros(n + 1, np.int64)
        mark[start[whole]] += 1
        mark[stop[whole]] -= 1
        gone |= np.cumsum(mark[:-1]) > 0
        left = np.flatnonzero(~gone)
    return np.flatnonzero(gone)


def deletions(docs: DataFrame, scratch: Scratch, whole_runs: bool = False, run_words: int = RUN_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, th, gone): the positions, among lines with words, that each document loses.

    docs: doc_id, th (a hash of the text), text."""
    if not 0 < span_words <= run_words:
        raise ValueError("0 < span_words <= run_words is asked for")
    place = F.struct("doc_id", "th", "at")
    lines = scratch.keep(docs.mapInArrow(partial(_lined, span_words, run_words), LINES), "lines")
    picks = lines.select("doc_id", "th", F.size("h").alias("n"), F.explode(F.arrays_zip("keys", "at")).alias("p")).select("doc_id", "th", "n", F.col("p.keys").alias("key"), F.col("p.at").alias("at"))
    firsts = picks.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("key", "f")
    # kept apart, so that Spark can split a frequent hash in the join
    firsts = scratch.keep(firsts, "firsts")
    met = picks.join(firsts, "key").where("struct(doc_id, th, at) > f")
    # documents that meet: line x of the later one faces line x - off of the earlier
    met = met.select("doc_id", "th", "n", F.col("f.doc_id").alias("src"), F.col("f.th").alias("src_th"), (F.col("at") - F.col("f.at")).alias("off"))
    met = met.groupBy("doc_id", "th", "n", "src", "src_th").agg(F.collect_set("off").alias("offs"))
    source = lines.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), F.col("h").alias("s_h")).dropDuplicates(["s_id", "s_th"])
    met = met.join(source, F.col("src").eqNullSafe(F.col("s_id")) & (F.col("src_th") == F.col("s_th")))
    begin = F.greatest(F.lit(0), -F.array_max("offs"))
    facing = F.slice("s_h", begin + 1, F.greatest(F.lit(0), F.least(F.size("s_h"), F.col("n") - F.array_min("offs")) - begin))
    met = met.select("doc_id", "th", facing.alias("facing"), begin.alias("begin"), "offs")
    own = lines.select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), "h", "w").dropDuplicates(["o_id", "o_th"])
    met = met.join(own, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th"))).select("doc_id", "th", "h", "w", "facing", "begin", "offs")

    @F.pandas_udf("array<int>")
    def runs(h: pd.Series, w: pd.Series, facing: pd.Series, begin: pd.Series, offs: pd.Series) -> pd.Series:
        return pd.Series([_runs(*x, span_words).astype(np.int32) for x in zip(h, w, facing, begin, offs, strict=True)])

    cut = met.select("doc_id", "th", F.explode(runs("h", "w", "facing", "begin", "offs")).alias("line"))
    if whole_runs:
        whole = scratch.keep(lines.select("doc_id", "th", "h", "w").mapInArrow(partial(_whole, run_words), "doc_id long, th long, key long, at int, stop int"), "whole")
        firsts = whole.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("key", "f")
        later = whole.join(scratch.keep(firsts, "whole_firsts"), "key").where("struct(doc_id, th, at) > f")
        cut = cut.union(later.select("doc_id", "th", F.explode(F.sequence("at", F.col("stop") - 1)).alias("line")))
    return cut.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _without(text: str | None, gone) -> tuple[str | None, int, int]:
    """text without those of its lines with words; and the lines and words it loses."""
    if text is None or gone is None or not len(gone):
        return text, 0, 0
    drop, out, at, words = set(map(int, gone)), [], 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if at in drop:
                words += len([x for x in line.translate(_BLANKS).split(" ") if x])
                at += 1
                continue
            at += 1
        out.append(line)
    return "\n".join(out), len(drop), words


_BLANKS = {c: " " for c in (*range(0x09, 0x0E), 0x20)}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_runs: bool = False, run_words: int = RUN_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """docs, all columns, with text_col rewritten, and the columns n_lines_removed and
    n_words_removed (which replace columns of these names)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines_removed", "n_words_removed")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    gone = scratch.keep(deletions(docs.select(F.col(id_col).cast("long").alias("doc_id"), th.alias("th"), F.col(text_col).alias("text")), scratch, whole_runs, run_words, span_words), "gone")
    scratch.keep_only(gone)
    # names that no caller's column has
    own = {k: f"__line_dedup_{k}" for k in ("hash", "id", "th", "gone")}
    gone = gone.select(F.col("doc_id").alias(own["id"]), F.col("th").alias(own["th"]), F.col("gone").alias(own["gone"]))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own["id"])) & (F.col(own["hash"]) == F.col(own["th"]))
    # a merge join at every size: the deletions grow with the documents
    found = docs.withColumn(own["hash"], th).join(gone.hint("merge"), same, "left").drop(own["hash"], own["id"], own["th"])
    names, at = docs.columns, docs.columns.index(text_col)
    schema = docs.schema.add("n_lines_removed", "long").add("n_words_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # about 1 MB of text at a time
            for i, j in slices(flat_text(whole.column(at))[1]):
                batch = whole.slice(i, j - i)
                cells = batch.columns
                new = [_without(t, g) for t, g in zip(cells[at].to_pylist(), cells[-1].to_pylist(), strict=True)]
                cells[at] = pa.array([x[0] for x in new], pa.string())
                yield pa.RecordBatch.from_arrays([*cells[:-1], *(pa.array([x[k] for x in new], pa.int64()) for k in (1, 2))], names=[*names, "n_lines_removed", "n_words_removed"])

    return found.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, run_words: int = RUN_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """docs with repeated runs deleted; rows that lose lines and have fewer than least_words
    words left are dropped, and n_chars, where present, is set anew."""
    out = dedup_lines(docs, id_col, text_col, True, run_words, span_words)
    out = out.where((F.col("n_lines_removed") == 0) | (F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")) >= least_words)).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
