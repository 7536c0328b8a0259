"""Best-fit packing with Martello-Toth dominance (operator 9).

Lengths are whole numbers from 1 to the capacity, so an instance of any size is its
histogram: at most `capacity` counts, which is all the driver gets. It plans patterns (so
many sequences, each with these lengths) in two steps. Dominance first, longest pieces
first: a set {j} or {j, k} is fixed for good when every other feasible set with j could be
exchanged for it without needing more sequences, that is

* nothing else fits beside j, or
* k is the longest piece that fits beside j and it is at least as long as the longest pair
  that fits there while no three do; a k that fills the sequence exactly always is.

Best fit then places the rest, longest first, into the fullest sequence that has room.

Pieces learn their place from their rank among the pieces of their length. Ranks come from
two levels, a number within (length, shard) and a running sum over the shards of a length,
so no task ever holds all pieces of a frequent length. The allocation is a table of at most
a few rows for each pattern, whatever the input; pieces look it up by binary search.

Tokens: the ids of the byte-level vocabulary, then END_ID. A document of more than
`capacity` tokens is cut from its end, so that only its first piece may be shorter.

Defined results: a null or empty text is one piece of the single token END_ID; repeated
rows are packed as often as they occur; a null doc_id is passed on; an empty table gives an
empty result; other columns are not read. Ids of pieces that tie are given in the order of
shard, doc_id, piece and checksum.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrid.llm.bpe import byte_letters
from callgrid.llm.common import Scratch, flat_text, slices
from callgrid.llm.pretoken import PIECES, WordIds, split

CAPACITY = 2048
END_ID = 0
#: Rows of one length that one task numbers, on average, at most.
SHARD_ROWS = 200_000


class PieceEncoder:
    """The byte-level vocabulary at `path`; special tokens in a text stay special."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {x: i for i, x in enumerate(byte_letters())}
        self.vocab = {bytes(byte[x] for x in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # in this vocabulary a token's id follows the order of the merges
        self.bpe = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=self.vocab, special_tokens={})
        self.words = WordIds(self._encode_words)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole, encode = self.vocab.get, self.bpe.encode_ordinary
        found = [encode(w) if (k := whole(w.encode())) is None else [k] for w in words]
        return np.array([k for x in found for k in x], np.int32), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, plan = [], []
        for t in texts:
            plan.append([])
            for p in self.cut.split(t) if "<|" in t else [t]:
                if p in self.special:
                    plan[-1].append(-1 - self.special[p])
                else:
                    plan[-1].append(len(parts))
                    parts.append(p)
        points, starts, ends, first = split(parts, "pieces")
        ids, size = self.words.of(points, starts, ends)
        at = np.concatenate(([0], np.cumsum(size)))[first]
        own = lambda k: np.array([-1 - k], np.int32) if k < 0 else ids[at[k] : at[k + 1]]
        return [own(p[0]) if len(p) == 1 else np.concatenate([own(k) for k in p]) for p in plan]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *((s, capacity) for s in range(head, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for batch in batches:
            _, offsets = flat_text(batch.column(1))
            for i, j in slices(offsets):
                rows, piece, start, length, crc = [], [], [], [], []
                for r, ids in enumerate(enc.encode([t or "" for t in batch.column(1)[i:j].to_pylist()])):
                    raw = np.append(ids, np.int32(END_ID)).astype("<u4").tobytes()
                    for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                        rows.append(i + r)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, list[tuple[int, int]]]


def _fit(left: np.ndarray, most: int, own: int = 0) -> int:
    """The longest length with a piece left that is at most `most`; 0 if none. own: a
    length of which one piece is spoken for."""
    while most > 0:
        found = np.flatnonzero(left[1 : most + 1])
        if not len(found):
            return 0
        k = int(found[-1]) + 1
        if k != own or left[k] > 1:
            return k
        most = k - 1
    return 0


def _longest_pair(left: np.ndarray, room: int, j: int) -> int:
    """The largest sum of two pieces, besides one of length j, that is at most room."""
    have = left.copy()
    have[j] -= 1
    sizes = np.flatnonzero(have[: room + 1])
    if not len(sizes):
        return 0
    best = 0
    partner = np.searchsorted(sizes, room - sizes, side="right") - 1
    for i, p in enumerate(partner):
        if p == i and have[sizes[i]] < 2:
            p -= 1
        if p >= 0:
            best = max(best, int(sizes[i] + sizes[p]))
    return best


def dominance(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix dominating sets; takes their pieces out of `left` (counts by length)."""
    fixed: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            k = _fit(left, room, own=j)
            if not k:
                fixed.append((n := int(left[j]) if 2 * j > capacity else 1, [(j, 1)]))
                left[j] -= n
                continue
            if k < room:
                smallest = np.repeat(np.flatnonzero(left), np.minimum(left[left > 0], 4))[:5].tolist()
                if j in smallest:
                    smallest.remove(j)
                if len(smallest) >= 3 and sum(smallest[:3]) <= room or _longest_pair(left, room, j) > k:
                    break
            n = int(left[j]) // 2 if k == j else int(min(left[j], left[k]))
            fixed.append((n, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
            left[j] -= n
            left[k] -= n
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Place all of `left`, longest first, each into the fullest sequence with room."""
    open_: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    done: list[Pattern] = []
    for s in range(capacity, 0, -1):
        n = int(left[s])
        left[s] = 0
        room = s
        while n:
            while room <= capacity and not open_[room]:
                room += 1
            count, held = open_[room].pop() if room <= capacity else (n, [])
            space = room if room <= capacity else capacity
            each = space // s
            for bins, m in ((min(count, n // each), each), (1, n % each)):
                # the last sequence may get fewer than fit
                if bins and m and count:
                    open_[space - m * s].append((bins, [*held, (s, m)]))
                    count -= bins
                    n -= bins * m
            if count and held:
                open_[space].append((count, held))
    for group in open_:
        done += [p for p in group if p[0]]
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (number of sequences, [(length, pieces of it in each)]) for all pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] += n
    return dominance(left, capacity) + best_fit(left, capacity)


def allocation(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each, offset), by length and rank."""
    rows, used, bins = [], {}, 0
    for count, held in patterns:
        offset = 0
        for s, m in held:
            rows.append((s, used.get(s, 0), bins, m, offset))
            used[s] = used.get(s, 0) + count * m
            offset += s * m
        bins += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, shards: int) -> DataFrame:
    """pieces with `rank`, from 0, among those of the same length."""
    p = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    sums = p.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("within", F.row_number().over(inside))
    return p.join(base, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("within") - 1).drop("shard", "base", "within")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(token_pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = allocation(plan(counts, capacity))
    shards = max(16, -(-sum(counts.values()) // SHARD_ROWS))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            s, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = table[np.searchsorted(key, s * (1 << 48) + rank, side="right") - 1]
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 3])
            out = [*(batch[n] for n in names), pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + slot * s)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    return ranked(pieces, shards).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
