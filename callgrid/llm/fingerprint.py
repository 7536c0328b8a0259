"""Document fingerprints (operator 2): digests of improbable features.

Every window of WINDOW bytes gets the level of its entropy, in LEVELS steps. How rare a
level is comes from a histogram over all windows of all documents; rarer levels rank first,
and windows of hardly any entropy never rank. In each neighbourhood of WINDOW successive
windows the one that ranks first (the leftmost of equals) wins; a window that wins POPULAR
neighbourhoods, or all of a short text's, is a feature. Features, in order and each once,
go into Bloom filters of 2048 bits, HASHES bits each; after PER_FILTER features the next
filter of the chain begins.

Likeness of two digests: for every filter of the shorter chain the best match in the other,
averaged by their features. A match is the number of common bits, scaled so that the share
CUT of the way from chance to the most possible is 0 and the most possible is 1.

Next documents: documents are dealt to blocks by ranges of (doc_id, hash of the text). The ranges
are those of Spark's range partitioning of these two numbers, so nothing sorts or summarises all
ids in one place; the driver gets one bound for each block. The first document of a block is sent
to the block before as well (that of the first block to the last). So texts are shuffled once and
each task reads its rows in order, holding about 1 MB of them and at most two texts that are longer.

Defined results: a null text counts as empty. An empty text has the empty fingerprint: like
another empty one 1.0, like others 0.0. A text of fewer bytes than a window, or without
features, has one feature, the whole text. Rows are ordered by doc_id, nulls first, and
those of one doc_id by a hash of the text; repeated rows follow one another. A single row is its own next
document. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import SLICE_BYTES, Scratch, flat_text, mix64, slices

WINDOW = 32
LEVELS = 1000
LEAST_LEVEL = 100
POPULAR = 8
BITS, HASHES, PER_FILTER = 2048, 5, 128
CUT = 0.3

_UNIT = 1 << 20
_CLOG = np.array([0, *(round(_UNIT * c * np.log2(c)) for c in range(1, WINDOW + 1))], np.int64)
_MOST = int(_UNIT * WINDOW * np.log2(WINDOW))
_NEVER = np.int64(1) << np.int64(62)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level of the window at each position (exact: sums of whole numbers)."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # occurrences of a position's byte in the window that it begins, and that it ends
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int(_CLOG[np.bincount(data[:WINDOW], minlength=256)].sum())
    step = np.zeros(n - WINDOW + 1, np.int64)
    step[0] = first
    out, into = ahead[: n - WINDOW], behind[WINDOW:]
    step[1:] = _CLOG[out - 1] - _CLOG[out] + _CLOG[into] - _CLOG[into - 1]
    return (LEVELS * (_MOST - np.cumsum(step))) // _MOST


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions whose window lies in one text; offsets: of the texts, from 0."""
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    whole = size >= WINDOW
    np.add.at(ok, offsets[:-1][whole], 1)
    np.add.at(ok, offsets[1:][whole] - WINDOW + 1, -1)
    return np.cumsum(ok[:-1]) > 0


def _levels_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        flat, offsets = flat_text(batch.column(0))
        for i, j in slices(offsets):
            data, offs = flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            levels = entropy_levels(data)
            if len(levels):
                total += np.bincount(levels[_inside(offs, len(data))[: len(levels)]], minlength=LEVELS + 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["level", "n"])


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each level, rarest first, over all windows of docs; the driver gets at
    most LEVELS + 1 counts."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_levels_counted, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(LEVELS + 1, np.int64)
    for r in rows:
        count[r["level"]] = r["n"]
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), count))] = np.arange(LEVELS + 1)
    return rank


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The feature hashes of each text, in order, each once."""
    docs = len(offsets) - 1
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * docs
    levels = entropy_levels(data)
    if len(levels):
        ok = _inside(offsets, len(data))[: len(levels)] & (levels >= LEAST_LEVEL)
        n = len(levels)
        key = np.full(n + WINDOW, _NEVER)
        key[:n][ok] = (rank[levels[ok]] << np.int64(40)) + np.flatnonzero(ok)
        step = 1
        while step < WINDOW:
            key[:-step] = np.minimum(key[:-step], key[step:])
            step *= 2
        # neighbourhoods: all that lie in a text, or the first one of a text with few windows
        size = np.diff(offsets)
        windows = np.maximum(size - WINDOW + 1, 0)
        hoods = np.where(windows > 0, np.maximum(windows - WINDOW + 1, 1), 0)
        edge = np.zeros(n + 1, np.int32)
        full = hoods > 0
        np.add.at(edge, offsets[:-1][full], 1)
        np.add.at(edge, np.minimum(offsets[:-1][full] + hoods[full], n), -1)
        at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (key[:n] < _NEVER))
        wins = np.bincount(key[at] & np.int64((1 << 40) - 1), minlength=n)
        at = np.flatnonzero(wins)
        owner = np.searchsorted(offsets, at, side="right") - 1
        chosen = wins[at] >= np.minimum(POPULAR, hoods[owner])
        at, owner = at[chosen], owner[chosen]
        if len(at):
            words = data[at[:, None] + np.arange(WINDOW)].copy().view(np.uint64)
            h = np.zeros(len(at), np.uint64)
            for k in range(WINDOW // 8):
                h = mix64(h ^ words[:, k])
            edges = np.searchsorted(owner, np.arange(docs + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                mine = h[edges[i] : edges[i + 1]]
                _, first = np.unique(mine, return_index=True)
                found[i] = mine if len(first) == len(mine) else mine[np.sort(first)]
    for i in range(docs):
        if not len(found[i]) and offsets[i + 1] > offsets[i]:
            whole = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest()
            found[i] = np.frombuffer(whole, np.uint64)
    return found


class Digest:
    """Filters (rows of 256 bytes) and the number of features in each."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        chains = -(-n // PER_FILTER)
        bits = np.zeros(chains * BITS, bool)
        base = np.arange(n) // PER_FILTER * BITS
        for k in range(HASHES):
            bits[base + ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits.reshape(chains, BITS), axis=1) if chains else np.zeros((0, BITS // 8), np.uint8)
        self.held = np.minimum(PER_FILTER, n - np.arange(chains) * PER_FILTER)
        self.words = self.filters.view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        return f"{int(self.held.sum())}:{base64.b64encode(self.filters.tobytes()).decode()}" if len(self.held) else ""

    def likeness(self, other: Digest) -> float:
        a, b = (self, other) if (len(self.held), int(self.held.sum())) <= (len(other.held), int(other.held.sum())) else (other, self)
        if not len(a.held) or not len(b.held):
            return float(len(a.held) == len(b.held))
        best = np.zeros(len(a.held))
        for i in range(len(a.held)):
            common = np.bitwise_count(a.words[i] & b.words).sum(axis=1, dtype=np.int64)
            chance, most = a.ones[i] * b.ones / BITS, np.minimum(a.ones[i], b.ones)
            least = chance + CUT * (most - chance)
            best[i] = np.max(np.clip((common - least) / np.maximum(most - least, 1e-9), 0, 1))
        return float((best * a.held).sum() / a.held.sum())


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The digest of each text, about SLICE_BYTES at a time."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    out: list[Digest] = []
    for i, j in slices(offsets):
        out += map(Digest, features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rank))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """text whose last quarter of code points (rounded down) is replaced by the first as
    many, or all, of the text after it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _rows(ids: list, texts: list[str], rank: np.ndarray) -> pa.RecordBatch:
    """Results for all but the last text, which only follows them."""
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    own, new = digests([t.encode() for t in texts], rank), digests(changed, rank)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array([str(d) for d in own[:-1]], pa.string()),
            pa.array([str(d) for d in new], pa.string()),
            pa.array([a.likeness(b) for a, b in zip(own, new, strict=False)], pa.float64()),
            pa.array([a.likeness(b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def _ranks(bounds: list[tuple], *keys: np.ndarray) -> np.ndarray:
    """For each row of keys, the number of bounds that are not above it."""
    n = len(bounds)
    own = [np.array([b[k] for b in bounds], x.dtype) for k, x in enumerate(keys)]
    row = np.arange(n + len(keys[0])) >= n
    order = np.lexsort((row, *(np.concatenate(x) for x in reversed(list(zip(own, keys, strict=True))))))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~row[order])
    return out[n:]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses for each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = rarity(docs)
    scratch = Scratch(spark)
    keyed = scratch.keep(docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th")), "keys")
    blocks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.repartitionByRange(blocks, "known", "id", "th").groupBy(F.spark_partition_id()).agg(F.min(F.struct("known", "id", "th")).alias("k"))
    bounds = sorted({tuple(r["k"]) for r in ranges.collect()})
    scratch.drop(keyed)
    low, bounds = bounds[:1], bounds[1:]
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def homes(known, ids, th):
        """The block of each document and, for the first of a block, the block before it."""
        import pandas as pd

        block = _ranks(bounds, known.to_numpy(), ids.to_numpy(), th.to_numpy())
        begins = low + bounds
        rows = zip(block.tolist(), zip(known, ids, th, strict=True), strict=True)
        return pd.Series([[b, -1 - (b - 1 if b else last)] if begins[b] == key else [b] for b, key in rows])

    placed = docs.withColumn("th", F.xxhash64("text"))
    placed = placed.withColumn("home", F.explode(homes(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("th"))))
    placed = placed.select("doc_id", "text", "th", F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home")).alias("block"), (F.col("home") < 0).alias("guest"))
    placed = placed.repartitionById(last + 1, "block").sortWithinPartitions("guest", "doc_id", "th", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, done = 0, False
        for batch in (whole.slice(i, j - i) for whole in batches for i, j in slices(flat_text(whole["text"])[1])):
            for v, t, guest in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist(), strict=True):
                if done:
                    continue
                ids.append(v)
                texts.append(t)
                size += len(t)
                done = guest
                if guest or size >= SLICE_BYTES and len(texts) > 1:
                    if len(texts) > 1:
                        yield _rows(ids[:-1], texts, rank)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return placed.mapInArrow(run, SCHEMA)
