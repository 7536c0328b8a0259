"""Language ID (operator 8): scripts narrow, words score, Viterbi labels spans.

Training counts, for each label, hashed character grams (GRAMS letters, with word edges) of
all labelled training documents, and letters by script. Counts are exact sums over all
data; the model is one table of BUCKETS rows for each label, however large the input. More than
MOST_LABELS labels are an error: the model would no longer be small. A task holds the counts of
TASK_LABELS labels at a time.

A word's candidates are the labels that have at least SCRIPT_SHARE of their letters in the
word's script (all labels, where there is none). Its score for a label is the mean
over gram lengths of the summed log probabilities. Viterbi with the penalty SWITCH for every change of
label between neighbouring words gives the spans; texts of a batch advance together. The
prediction is the label with the most letters, its score its share of the letters.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
spans, and so is every text when no document could be learned from; a null doc_id is
neither held out nor learned from; a null label is not learned from; of labels that tie,
the first in order wins; repeated rows count, and are labelled, as often as they occur; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgrid.llm.common import flat_text, slices
from callgrid.llm.pretoken import LETTER, classes, span_hashes

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
SMOOTH = 0.5
SWITCH = 8.0
SCRIPT_SHARE = 0.01
MOST_LABELS, TASK_LABELS = 500, 64
UNKNOWN = "und"

#: Script ranges: name, first and last code point.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF), ("burmese", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)
NAMES = ("other", *dict.fromkeys(n for n, _, _ in SCRIPTS))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, script) of every code point."""
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = NAMES.index(name)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        x = chr(c).lower()
        if len(x) == 1:
            lower[c] = ord(x)
    return lower, script


class Words:
    """The words (runs of letters) of several texts: starts, ends, text, script, grams."""

    def __init__(self, texts: list[str]):
        lower, script = _tables()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.stops = np.cumsum([0, *map(len, texts)])
        n = len(points)
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = classes()[points] == LETTER
        cut = np.zeros(n + 1, bool)
        cut[self.stops] = True
        self.starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.stops)
        self.size = self.ends - self.starts
        self.script = script[points[self.starts]]
        # different words once each, between two edge marks
        lowered = lower[points]
        _, at, self.back, self.count = np.unique(span_hashes(lowered, self.starts, self.ends), return_index=True, return_inverse=True, return_counts=True)
        size, m = self.size[at], len(at)
        self.owner = np.repeat(np.arange(m), size + 2)
        begin = np.cumsum(size + 2) - size - 2
        place = np.arange(len(self.owner)) - begin[self.owner] - 1
        inner = (place >= 0) & (place < size[self.owner])
        self.seq = np.full(len(self.owner), 2, np.uint64)
        self.seq[begin] = 1
        self.seq[inner] = lowered[(self.starts[at][self.owner] + place)[inner]]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each gram length: (buckets, their words, among the different words)."""
        s, c = self.seq, np.uint64(0x9E3779B97F4A7C15)
        for k in GRAMS:
            if len(s) < k:
                continue
            h = s[: len(s) - k + 1].copy()
            for j in range(1, k):
                h *= c
                h += s[j : len(s) - k + 1 + j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            b = (h >> np.uint64(64 - 15)).astype(np.int64)
            inside = np.flatnonzero(self.owner[: len(s) - k + 1] == self.owner[k - 1 :])
            yield b[inside], self.owner[inside]


COUNTS = "label string, bucket int, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, text): counts by label and bucket; scripts follow the gram buckets."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_pylist()
        _, offsets = flat_text(batch.column(1))
        for i, j in slices(offsets):
            part, texts = labels[i:j], batch.column(1)[i:j].to_pylist()
            for label in dict.fromkeys(part):
                words = Words([t or "" for t, x in zip(texts, part, strict=True) if x == label])
                mine = total.setdefault(label, np.zeros(BUCKETS + len(NAMES), np.int64))
                for b, owner in words.grams():
                    mine[:BUCKETS] += np.bincount(b, weights=words.count[owner], minlength=BUCKETS).astype(np.int64)
                mine[BUCKETS:] += np.bincount(words.script, weights=words.size, minlength=len(NAMES)).astype(np.int64)
                if len(total) >= TASK_LABELS:
                    yield from _rows(total)
                    total = {}
    yield from _rows(total)


def _rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for label, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["label", "bucket", "n"])


class Model:
    """Labels, their log probabilities by bucket and the labels of each script."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = labels
        grams = counts[:, :BUCKETS] + SMOOTH
        self.scores = (np.log(grams / grams.sum(axis=1, keepdims=True)) / len(GRAMS)).T.astype(np.float32).copy()
        letters = counts[:, BUCKETS:]
        share = letters / np.maximum(1, letters.sum(axis=1, keepdims=True))
        allowed = (share >= SCRIPT_SHARE).T
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -1e6).astype(np.float32)

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.count), len(self.labels)), np.float32)
        for b, owner in words.grams():
            if len(b):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[owner[first]] += np.add.reduceat(self.scores[b], first, axis=0)
        return out[words.back] + self.barred[words.script]

    def paths(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of every word, text by text."""
        n, labels = np.diff(first), np.arange(scores.shape[1])
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        out = np.zeros(len(scores), np.int64)
        if not len(order):
            return out
        at, size = first[order], n[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
        back = np.zeros(scores.shape, np.uint8 if len(labels) < 256 else np.int32)
        v = scores[at].astype(np.float64)
        for t in range(1, int(size[0])):
            k = int(active[t])
            now = v[:k]
            arg = now.argmax(axis=1)
            change = now[np.arange(k), arg][:, None] - SWITCH
            stay = now >= change
            back[at[:k] + t] = np.where(stay, labels, arg[:, None])
            v[:k] = np.where(stay, now, change) + scores[at[:k] + t]
        state = v.argmax(axis=1)
        out[at + size - 1] = state
        for t in range(int(size[0]) - 1, 0, -1):
            k = int(active[t])
            state[:k] = back[at[:k] + t, state[:k]]
            out[at[:k] + t - 1] = state[:k]
        return out

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(label, score, spans) of each text; a span is (start, end, label) in code points."""
        words = Words(texts)
        if not self.labels:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        path = self.paths(self.word_scores(words), words.first)
        out = []
        for i, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
            if a == b:
                out.append((UNKNOWN, 0.0, []))
                continue
            letters = np.bincount(path[a:b], weights=words.size[a:b], minlength=len(self.labels))
            k = int(letters.argmax())
            turn = np.flatnonzero(np.diff(path[a:b])) + a + 1
            edges = [a, *turn.tolist(), b]
            spans = [(int(words.starts[x] - words.stops[i]), int(words.ends[y - 1] - words.stops[i]), self.labels[path[x]]) for x, y in zip(edges, edges[1:], strict=False)]
            out.append((self.labels[k], float(letters[k] / letters.sum()), spans))
        return out


def fit(train: DataFrame) -> Model:
    """The model of (label, text) rows. The driver gets BUCKETS counts for each label."""
    train = train.where("label is not null and text is not null")
    found = train.select("label").distinct().limit(MOST_LABELS + 1).count()
    if found > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    counts = train.mapInArrow(_counted, COUNTS).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts["label"].to_pylist()
    labels = sorted(set(names))
    number = {x: i for i, x in enumerate(labels)}
    table = np.zeros((len(labels), BUCKETS + len(NAMES)), np.float64)
    table[[number[x] for x in names], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return Model(labels, table)


def label_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' other columns with lang_pred, score and spans in place of the text."""
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "spans")]
    picked = docs.select(*others, F.col(text_col).alias("_text"))
    more = StructType.fromDDL("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    schema = StructType([*docs.select(*others).schema.fields, *more.fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others))
            _, offsets = flat_text(texts)
            for i, j in slices(offsets):
                found = shared.value.label([t or "" for t in texts[i:j].to_pylist()])
                spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found], span)
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[: len(others)]), *new], names=[*others, "lang_pred", "score", "spans"])

    return picked.mapInArrow(run, schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def predict_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out; label all of them."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    model = fit(picked.where(remainder(F.col("doc_id")) != 1).select("label", "text"))
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return label_documents(picked.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "spans")
