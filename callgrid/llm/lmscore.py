"""LM scoring (operator 7): masked pseudo-likelihood with a bidirectional window network.

A token is a word, lower-cased, and its class: one of the FREQUENT words of the corpus, or
else one of the ENDINGS buckets of its last two bytes. The network sees WINDOW classes on
either side of a token, never the token itself; each place has its own table of hidden
contributions, their sum passes tanh, and a softmax over all classes predicts the class. A
word's probability is that of its class, times its share of the class's tokens in the corpus
(a softmax in two levels; the frequent words are alone in their classes). The score of a
document is the sum of the log probabilities of all its tokens.

What is learned comes from all documents. Word counts: exact, by hash, summed over the
corpus, for every word; the table stays with the executors. The driver gets the FREQUENT most
frequent, a total for each bucket and the counts of at most TOP words, those above a bound;
the tokens of all other words are joined with the table. Weights: each task trains the network,
in numpy, on every token of its part of the corpus from one common start; the weights are
then averaged over the tasks, by their tokens, as one aggregation, and the driver gets that
one network. A task's part is one file split or several, so a lost task is trained again on the
same rows and gives the same weights.

Defined results: a null or empty text has no tokens and the score 0.0 (mean null); repeated
rows are learned from, and scored, as often as they occur; a null doc_id is passed on; an
empty table gives an empty result; other columns are not read. Memory is bounded by about
1 MB of text at a time (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import SLICE_BYTES, _SPACE, Scratch, flat_text, slices, word_hashes

FREQUENT = 95
ENDINGS = 96
EDGE = FREQUENT + ENDINGS
CLASSES = EDGE + 1
#: The low bits of a word's key hold its bucket.
ENDING_BITS = 127
#: Words whose counts are broadcast; those of all others are joined.
TOP = 1 << 17
WINDOW = 2
HIDDEN = 32
BATCH = 1024
LIMIT = 80.0
RATE = 0.1
SEED = 7
#: Tokens that a training task sees, on average, at least.
PART_TOKENS = 1 << 21


def start_weights() -> list[np.ndarray]:
    """[places x classes x hidden, hidden, hidden x classes, classes]"""
    r = np.random.default_rng(SEED)
    return [r.normal(0, 0.3, (2 * WINDOW, CLASSES, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32)]


_FOLD = np.arange(256)
_FOLD[65:91] += 32


def word_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): a hash of each lower-cased word with its bucket in the low bits; text i
    has the keys first[i]:first[i + 1]."""
    h, first = word_hashes(flat, offsets, lower=True)
    lo, hi = int(offsets[0]), int(offsets[-1])
    if not len(h):
        return h, first
    text = flat[lo:hi]
    word = ~_SPACE[text]
    cut = np.zeros(hi - lo + 1, bool)
    cut[offsets - lo] = True
    last = np.flatnonzero(word & (np.append(~word[1:], True) | cut[1:]))
    alone = ~word[last - 1] | cut[last]
    two = _FOLD[text[last]] | 0x20
    two += 257 * np.where(alone, 0, _FOLD[text[last - 1]])
    ending = (two * 2654435761 >> 12) % ENDINGS
    return h & ~np.uint64(ENDING_BITS) | ending.astype(np.uint64), first


class Vocabulary:
    """The keys of the frequent words, most frequent first, and the number of all tokens."""

    def __init__(self, keys: np.ndarray, total: int = 0):
        self.total = total
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def classes(self, keys: np.ndarray) -> np.ndarray:
        out = FREQUENT + (keys & np.uint64(ENDING_BITS)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            known = self.sorted[at] == keys
            out[known] = self.order[at[known]]
        return out

    def tokens(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes, first): text i has the tokens first[i]:first[i + 1]."""
        keys, first = word_keys(flat, offsets)
        return self.classes(keys), first


class Shares:
    """Log shares of words in their classes, as far as the counts of the top words tell."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        order = np.argsort(keys)
        self.sorted, self.log_n = keys[order], np.log(counts[order])
        self.log_total = np.log(np.maximum(totals, 1))

    def of(self, keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log share, rest): of tokens in rest, the log of the word's count is still to be added."""
        share, rest = np.zeros(len(keys)), np.zeros(len(keys), bool)
        on = np.flatnonzero(classes >= FREQUENT)
        share[on] = -self.log_total[classes[on] - FREQUENT]
        rest[on] = True
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys[on]), len(self.sorted) - 1)
            known = self.sorted[at] == keys[on]
            share[on[known]] += self.log_n[at[known]]
            rest[on[known]] = False
        return share, rest


def windows(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the classes at the places around it; EDGE beyond its text."""
    n = len(tokens)
    place = np.arange(n)
    size = np.diff(first)
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    out = np.empty((2 * WINDOW, n), np.uint16)
    for row, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        x = place + d
        ok = (x >= begin) & (x < end)
        out[row] = np.where(ok, tokens[np.where(ok, x, 0)], EDGE)
    return out


def forward(weights: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden, logits of all classes, limited to +-LIMIT) for tokens with these classes around."""
    t, b, v, c = weights
    h = t[0].take(around[0], axis=0)
    for k in range(1, len(t)):
        h += t[k].take(around[k], axis=0)
    h += b
    np.tanh(h, out=h)
    z = h @ v
    z += c
    np.clip(z, -LIMIT, LIMIT, out=z)
    return h, z


def log_probs(weights: list[np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log probability of each target."""
    z = forward(weights, around)[1]
    own = z[np.arange(len(target)), target]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(CLASSES, np.float32))


class Trainer:
    """Adagrad on successive batches of tokens."""

    def __init__(self):
        self.w = start_weights()
        self.g = [np.full_like(x, 1e-3) for x in self.w]
        self.seen = 0

    def _step(self, k: int, grad: np.ndarray) -> None:
        self.g[k] += grad * grad
        self.w[k] -= RATE * grad / np.sqrt(self.g[k])

    def batch(self, around: np.ndarray, target: np.ndarray) -> None:
        n, places, one = len(target), len(around), np.ones(max(len(target), CLASSES), np.float32)
        h, z = forward(self.w, around)
        d = np.exp(z, out=z)
        d *= (1 / (d @ one[:CLASSES] * n))[:, None]
        d[np.arange(n), target] -= np.float32(1 / n)
        dh = (d @ self.w[2].T) * (1 - h * h)
        # gradients of the tables' rows: sums over equal classes, place by place
        keys = (around + np.arange(places, dtype=np.uint16)[:, None] * np.uint16(CLASSES)).ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        rows = keys[first]
        order = (order.reshape(places, n) - np.arange(places)[:, None] * n).ravel()
        grad = np.add.reduceat(dh.take(order, axis=0), first, axis=0)
        self._step(2, h.T @ d)
        self._step(3, one[:n] @ d)
        w, g = self.w[0].reshape(-1, HIDDEN), self.g[0].reshape(-1, HIDDEN)
        new = g[rows] + grad * grad
        g[rows] = new
        w[rows] -= RATE * grad / np.sqrt(new)
        self._step(1, one[:n] @ dh)
        self.seen += n


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) for every word of the corpus, h its key; docs: one column, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column(0))
            for i, j in slices(offsets, 4 * SLICE_BYTES):
                h, n = np.unique(word_keys(flat, offsets[i : j + 1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _level() -> Column:
    """The size of a count, in quarters of a doubling."""
    return F.floor(F.log2("n") * 4)


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, Shares]:
    """The frequent words, and the shares of the others; counts: count_words, written."""
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    frequent = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    totals = np.zeros(ENDINGS)
    for r in counts.groupBy(F.col("h").bitwiseAND(ENDING_BITS).alias("e")).agg(F.sum("n").alias("n")).collect():
        totals[r["e"]] = r["n"]
    total = int(totals.sum())
    np.subtract.at(totals, (frequent & np.uint64(ENDING_BITS)).astype(np.int64), [r["n"] for r in rows])
    least, words = None, 0
    for r in sorted(counts.groupBy(_level().alias("level")).count().collect(), reverse=True):
        words += r["count"]
        if words > TOP:
            break
        least = r["level"]
    top = counts.where(_level() >= least if least is not None else F.lit(False)).toArrow()
    return Vocabulary(frequent, total), Shares(top["h"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(float), totals)


def train(docs: DataFrame, vocab: Vocabulary) -> list[np.ndarray]:
    """The weights, averaged over the tasks by the tokens that each saw. Small file splits are put
    together, so that a task has about PART_TOKENS tokens or more to learn from."""
    docs = docs.coalesce(max(1, vocab.total // PART_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer()
        for batch in batches:
            flat, offsets = flat_text(batch.column(0))
            for i, j in slices(offsets):
                tokens, first = vocab.tokens(flat, offsets[i : j + 1])
                around = windows(tokens, first)
                for a in range(0, len(tokens), BATCH):
                    trainer.batch(around[:, a : a + BATCH], tokens[a : a + BATCH])
        if trainer.seen:
            x = np.concatenate([p.ravel() for p in trainer.w]).astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([x], pa.list_(pa.float64()))], names=["seen", "w"])

    parts = docs.mapInArrow(run, "seen long, w array<double>").select("seen", F.posexplode("w").alias("i", "x"))
    got = parts.groupBy("i").agg(F.sum("x").alias("x"), F.sum("seen").alias("seen")).toArrow()
    w = start_weights()
    if got.num_rows:
        order = np.argsort(got["i"].to_numpy())
        flat = (got["x"].to_numpy() / got["seen"].to_numpy())[order].astype(np.float32)
        stops = np.cumsum([0, *(p.size for p in w)])
        w = [flat[a:b].reshape(p.shape) for p, a, b in zip(w, stops, stops[1:], strict=False)]
    return w


SCORED = "row long, doc_id long, n_tokens long, log_prob double, words array<long>"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (summed over the tokens), mean_log_prob for each row."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = scratch.keep(count_words(docs.select("text")), "counts")
    vocab, shares = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, shares, train(docs.select("text"), vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, shares, weights = shared.value
        for batch in batches:
            flat, offsets = flat_text(batch.column(2))
            for i, j in slices(offsets):
                keys, first = word_keys(flat, offsets[i : j + 1])
                tokens = vocab.classes(keys)
                around = windows(tokens, first)
                p, rest = shares.of(keys, tokens)
                for a in range(0, len(tokens), BATCH):
                    target = tokens[a : a + BATCH]
                    p[a : a + len(target)] += log_probs(weights, around[:, a : a + BATCH], target)
                # summed text by text; single precision, so equal texts agree to about 1e-6
                total = np.add.reduceat(np.append(p, 0), np.minimum(first[:-1], len(tokens))) if len(first) > 1 else np.zeros(0)
                n = np.diff(first)
                total[n == 0] = 0
                stops = np.concatenate(([0], np.cumsum(rest)))[first]
                words = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(keys[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n, pa.int64()), pa.array(total), words], names=["row", "doc_id", "n_tokens", "log_prob", "words"])

    scored = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, SCORED)
    scored = scratch.keep(scored, "scored")
    # no word here is as frequent as the top ones, so no key of the join is hot
    rest = scored.select("row", F.explode("words").alias("h")).join(counts, "h")
    rest = rest.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    log_prob = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    out = scored.drop("words").join(rest, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
