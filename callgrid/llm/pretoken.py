"""Splitting texts into words for byte-pair encoders, many texts at a time in numpy.

Two splits are known: "pieces" (a space belongs to the word after it; a run of other white
space is a piece) and "words" (white space is dropped, each numeral stands alone). Texts
with an apostrophe go through the regular expression itself, since contractions need it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from callgrid.llm.common import mix64, placed_sums, places

#: The split patterns of the two public vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


@cache
def _pattern(kind: str) -> regex.Pattern:
    return regex.compile(PIECES if kind == "pieces" else WORDS)


def _spans(points: np.ndarray, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts without apostrophes; ends: of the texts."""
    n = len(points)
    c = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[ends] = True
    edge[1:n] |= c[1:] != c[:-1]
    if kind == "words":
        edge[:n] |= c == NUMBER
        edge[1:] |= c == NUMBER
        at = np.flatnonzero(edge)
        a, b = at[:-1], at[1:]
        keep = c[a] != SPACE
        return a[keep], b[keep]
    last = np.zeros(n + 1, bool)
    last[ends] = True
    at = np.flatnonzero(edge)
    a, b = at[:-1].copy(), at[1:].copy()
    space = c[a] == SPACE
    # a run of white space before a word gives its last character away: to the word if it is a space
    gives = space & ~last[b]
    blank = np.zeros(len(a), bool)
    blank[gives] = points[b[gives] - 1] == 32
    a[1:][blank[:-1]] -= 1
    alone = gives & ~blank & (b - a >= 2)
    cut = gives & (blank | alone)
    b2 = b.copy()
    b2[cut] -= 1
    starts = np.concatenate((a, b[alone] - 1))
    stops = np.concatenate((b2, b[alone]))
    keep = stops > starts
    starts, stops = starts[keep], stops[keep]
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order]


def split(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, starts, ends, first): text i has the words first[i]:first[i + 1]."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum([0, *map(len, texts)])
    starts, ends = _spans(points, stops[1:], kind) if len(points) else (np.zeros(0, np.int64),) * 2
    odd = [i for i, t in enumerate(texts) if "'" in t]
    if odd:
        mine = np.zeros(len(points) + 1, bool)
        more: list[tuple[int, int]] = []
        for i in odd:
            mine[stops[i] : stops[i + 1]] = True
            more += [(m.start() + stops[i], m.end() + stops[i]) for m in _pattern(kind).finditer(texts[i])]
        keep = ~mine[starts]
        extra = np.array(more, np.int64).reshape(-1, 2)
        starts, ends = np.concatenate((starts[keep], extra[:, 0])), np.concatenate((ends[keep], extra[:, 1]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return points, starts, ends, np.searchsorted(starts, stops)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, none of them empty."""
    return _hashed(*_laid_out(points, starts, ends)) if len(starts) else np.zeros(0, np.uint64)


def _laid_out(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all spans, their places in the spans, sizes)."""
    size = ends - starts
    place = places(size)
    return points[place + np.repeat(starts, size)], place, size


def _hashed(symbols: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(placed_sums(symbols, place, size, 21) + size.astype(np.uint64))


class WordIds:
    """Token ids of words, looked up by hash; words not seen yet are encoded together.

    A word that is found is compared with the stored one, code point by code point, so words
    of equal hashes keep their own ids. The table holds at most `most` words of MOST_POINTS
    code points in all, beside those of one call; then it starts anew, which costs time only.
    """

    MOST_POINTS = 1 << 22

    def __init__(self, encode, most: int = 250_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.begin, self.length, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[int]:
        """Encode these words; their numbers in the table."""
        symbols, stops = _laid_out(points, starts, starts + size)[0], np.cumsum(size)
        text = symbols.tobytes().decode("utf-32-le", "surrogatepass")
        ids, sizes = self.encode([text[a:b] for a, b in zip((stops - size).tolist(), stops.tolist(), strict=True)])
        first = len(self.start)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.begin = np.concatenate((self.begin, len(self.text) + stops - size))
        self.length = np.concatenate((self.length, size))
        self.text = np.concatenate((self.text, symbols))
        return list(range(first, len(self.start)))

    def of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number for each word)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        symbols, place, length = _laid_out(points, starts, ends)
        hashes, at, back = np.unique(_hashed(symbols, place, length), return_index=True, return_inverse=True)
        if len(self.index) > self.most or len(self.text) > self.MOST_POINTS:
            self.clear()
        keys = hashes.tolist()
        found = list(map(self.index.get, keys))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            for i, k in zip(new, self._add(points, starts[at[new]], length[at[new]]), strict=True):
                found[i] = self.index[keys[i]] = k
        known = np.array(found, np.int64)[back]
        # words whose hash another word has
        differs = symbols != self.text.take(place + np.repeat(self.begin[known], length), mode="clip")
        odd = np.flatnonzero((self.length[known] != length) | np.logical_or.reduceat(differs, np.cumsum(length) - length)) if differs.any() or (self.length[known] != length).any() else ()
        if len(odd):
            known[odd] = self._add(points, starts[odd], length[odd])
        size = self.size[known]
        stop = np.cumsum(size)
        if not len(stop) or not stop[-1]:
            return np.zeros(0, np.int32), size
        return self.ids[np.repeat(self.start[known] - (stop - size), size) + np.arange(stop[-1])], size
