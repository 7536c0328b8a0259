"""BPE encoding and decoding (operator 4): batched numpy merge rounds.

Words of many texts lie in one flat array of symbols. Each round finds, by binary search
over the sorted pair keys of the vocabulary's merges, every word's lowest-rank pair and
merges all its occurrences from the left; words without a known pair leave the array.
Words of more than LONG symbols use a heap instead, since the number of rounds grows with
the length of a word; both give the same ids.

A text is normalised as the vocabulary file asks (NFC, white space, lower case) and split
as described in pretoken; the vocabulary's special tokens, where they occur in a text, are
tokens of their own. Decoding joins the tokens of the ids with spaces, as the vocabulary
names no decoder.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated
rows give repeated rows; a null doc_id is passed on; an empty table gives an empty result;
other columns are not read. Memory is bounded by about 1 MB of text at a time (or one
longer text) and a table of about 250,000 words for each worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import flat_text, slices
from callgrid.llm.pretoken import WordIds, split

LONG = 256
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Encoder:
    """The vocabulary at `path`, with its merges as sorted keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.tokens = [""] * self.size
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + END] for x in letters], np.int64)
        self.words = WordIds(self.encode_words)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token_bytes = [t.encode() for t in self.tokens]
        self.id_bytes = [b"%d" % i for i in range(self.size)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def _rounds(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and owners after all merges; owner: ascending word numbers."""
        none, done_s, done_o = len(self.keys), [], []
        while len(sym):
            rank = np.full(len(sym), none)
            inside = owner[1:] == owner[:-1]
            rank[:-1][inside] = self._ranks(sym[:-1][inside], sym[1:][inside])
            first = np.flatnonzero(np.concatenate(([True], ~inside)))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(sym))))
            over = best == none
            if over.any():
                done_s.append(sym[over])
                done_o.append(owner[over])
                sym, owner, rank, best = sym[~over], owner[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # of overlapping occurrences (a a a), every second one from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        if not done_s:
            return sym, owner
        s, o = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def _heap(self, sym: list[int]) -> list[int]:
        """The same merges for one long word, with a heap of pairs."""
        n = len(sym)
        s, nxt, prv, none = list(sym), [*range(1, n), -1], [-1, *range(n - 1)], len(self.keys)
        a = np.array(sym, np.int64)
        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(self._ranks(a[:-1], a[1:])) if r < none]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != x or j < 0 or s[j] != y:
                continue
            s[i], s[j], nxt[i] = int(self.merged[r]), -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for a_, b_ in ((prv[i], i), (i, nxt[i])):
                if a_ >= 0 and b_ >= 0:
                    k = int(self._ranks(np.array([s[a_]]), np.array([s[b_]]))[0])
                    if k < none:
                        heapq.heappush(heap, (k, a_, s[a_], s[b_]))
        return [x for x in s if x >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number for each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        stop = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym[stop - 1] = self.final[data[stop - 1]]
        owner = np.repeat(np.arange(len(words)), size)
        long = np.flatnonzero(size > LONG)
        short = (size <= LONG)[owner]
        s, o = self._rounds(sym[short], owner[short])
        for i in long:
            found = self._heap(sym[stop[i] - size[i] : stop[i]].tolist())
            s, o = np.concatenate((s, found)), np.concatenate((o, np.full(len(found), i)))
        if len(long):
            order = np.argsort(o, kind="stable")
            s, o = s[order], o[order]
        return s, np.bincount(o, minlength=len(words))

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # each code point by itself: no final sigma
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, plan = [], []
        for t in texts:
            pieces = self.cut.split(t) if self.cut and "<|" in t else [t]
            plan.append([])
            for p in pieces:
                if p in self.special:
                    plan[-1].append(-1 - self.special[p])
                else:
                    plan[-1].append(len(parts))
                    parts.append(self.normal(p))
        points, starts, ends, first = split(parts, "words")
        ids, size = self.words.of(points, starts, ends)
        at = np.concatenate(([0], np.cumsum(size)))[first]
        own = lambda k: np.array([-1 - k], np.int32) if k < 0 else ids[at[k] : at[k + 1]]
        return [own(p[0]) if len(p) == 1 else np.concatenate([own(k) for k in p]) for p in plan]

    def decode(self, ids) -> str:
        """The tokens of the ids, joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            _, offsets = flat_text(batch.column(1))
            for i, j in slices(offsets):
                ids = enc.encode([t or "" for t in batch.column(1)[i:j].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row; return digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            _, offsets = flat_text(batch.column(1))
            for i, j in slices(offsets):
                found = [x.tolist() for x in enc.encode([t or "" for t in batch.column(1)[i:j].to_pylist()])]
                shown, tok = enc.id_bytes, enc.token_bytes
                a = [hashlib.sha256(b" ".join([shown[k] for k in x])).hexdigest() for x in found]
                b = [hashlib.sha256(b" ".join([tok[k] for k in x])).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(x) for x in found], pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGESTS)
