"""Periodic runs of words, by block matching at every scale.

A run of period q, with b the power of two at or below q, holds a whole block of b words that begins at a multiple of b, and the same block q words later, b to 2b - 1 places on. So for each b the
aligned blocks are the keys of an automaton over word numbers, which searches the document; of all places where a block occurs, only those b to 2b - 1 behind an aligned block of the same content count, one at most for each
place. Each is extended word by word in both directions, exactly, to the whole stretch that keeps this distance.

Beforehand, stretches that can't hold a run of such a period are left out: in a run, every word after the first q has stood q words or less before. That is one comparison a word and scale, and leaves
little of ordinary text. In what it leaves there are no more than 2b different words, so the automaton's nodes stay narrow.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FAMILIES, append_columns, bytes_of, splitmix, word_hashes, word_spans

#: Words of a run at least, and how many periods.
LEAST, TIMES = 6, 4
#: Words that an automaton searches at a time, beyond the blocks at hand, and that are joined to a text at a time.
SEARCHED, JOINED = 1 << 16, 1 << 16

FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, from 0; words are told apart by 128 bits of hash."""
    one, two = (word_hashes(data, starts, ends, f) for f in FAMILIES)
    _, at, which = np.unique(one, return_index=True, return_inverse=True)
    while (two != two[at][which]).any():
        # two words share a 64-bit hash: go on with another
        one = splitmix(one + two)
        _, at, which = np.unique(one, return_index=True, return_inverse=True)
    return which


def since_last(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words ago each word stood in its document last; a number beyond all documents' lengths if it didn't. first: each document's first word, and the end."""
    order = np.argsort(numbers, kind="stable")
    back = np.full(len(numbers), len(numbers) + 1, dtype=np.int64)
    same = numbers[order[1:]] == numbers[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    head = np.repeat(first[:-1], np.diff(first))
    back[np.arange(len(numbers)) - back < head] = len(numbers) + 1
    return back


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of a and b are equal, looking no further than twice as far."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def seeds(words: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks of b words that occur again b to 2b - 1 words later, by distance and place."""
    places, distances = [], []
    many = max(1, SEARCHED // b)
    for k in range(0, max(0, len(words) // b - 1), many):
        lo, hi = k * b, min(len(words), (k + many + 2) * b + b)
        text = tuple(words[lo:hi].tolist())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        own = []
        for at in range(0, min(many * b, len(text) - b + 1), b):
            key = text[at : at + b]
            number = automaton.get(key, -1)
            if number < 0:
                number = len(own)
                automaton.add_word(key, number)
            own.append(number)
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        place = found[:, 0] - b + 1
        block = place // b - 1
        near = (block >= 0) & (block < len(own))
        place, block, number = place[near], block[near], found[near, 1]
        same = np.asarray(own)[block] == number
        places.append(lo + block[same] * b)
        distances.append(lo + place[same] - places[-1])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, distance = np.concatenate(places), np.concatenate(distances)
    order = np.lexsort((place, distance))
    return place[order], distance[order]


class _Document:
    """The runs of one document's word numbers, found scale by scale."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.runs: list[tuple[int, int, int]] = []
        self.whole: set[tuple[int, int]] = set()
        self.scale = 0
        self.begun = self.ended = np.zeros(0, dtype=np.int64)

    def covered(self, lo: int, hi: int, b: int) -> bool:
        """Whether a run found at a smaller scale holds all of it; a run of a longer period can't share so many words with it."""
        if b != self.scale:
            self.scale, known = b, np.array(sorted((s, s + n) for s, n, _ in self.runs), dtype=np.int64).reshape(-1, 2)
            self.begun, self.ended = known[:, 0], np.maximum.accumulate(known[:, 1])
        at = int(np.searchsorted(self.begun, lo, side="right"))
        return at > 0 and bool(self.ended[at - 1] >= hi)

    def search(self, lo: int, hi: int, b: int, least: int, times: int) -> None:
        place, distance = seeds(self.words[lo:hi], b)
        place = place + lo
        at = 0
        while at < len(place):
            s, d = int(place[at]), int(distance[at])
            left = _agree(self.words[:s][::-1], self.words[d : s + d][::-1])
            right = _agree(self.words[s + b :], self.words[s + b + d :])
            start, end = s - left, s + b + right + d
            if end - start >= max(least, times * d) and (start, end) not in self.whole:
                self.whole.add((start, end))
                self.runs.append((start, end - start, d))
            # go on behind the blocks that lie in this stretch, at this distance
            last = int(np.searchsorted(distance, d, side="right"))
            at = max(at + 1, bisect_left(place, end - d - b + 1, at, last))


def find_runs(numbers: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """By document that has any: its runs (start, length, period) by start, then period. A run's period is its smallest, it has at least `least` words and `times` (3 or more) periods, and no neighbouring word goes on with it."""
    if times < 3:
        raise ValueError("a run must have three periods at least")
    found: dict[int, _Document] = {}
    back = since_last(numbers, first)
    sizes = np.diff(first)
    b, longest = 1, int(sizes.max(initial=0))
    while max(least, times * b) <= longest:
        # words after the first q of a run, for the periods q of this scale
        need = min(max(least, times * q) - q for q in range(b, 2 * b)) if b <= least else (times - 1) * b
        near = np.concatenate([[False], back < 2 * b, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        lo, hi = edge[::2], edge[1::2]
        wide = hi - lo >= need
        for x, y in zip(lo[wide].tolist(), hi[wide].tolist()):
            # back never reaches across documents, but stretches of two may touch
            for doc in range(int(np.searchsorted(first, x, side="right")) - 1, int(np.searchsorted(first, y, side="left"))):
                head, tail = int(first[doc]), int(first[doc + 1])
                u, v = max(x, head) - head, min(y, tail) - head
                if v - u < need:
                    continue
                document = found.setdefault(doc, _Document(numbers[head:tail]))
                if not document.covered(u, v, b):
                    document.search(max(0, u - 2 * b + 1), v, b, least, times)
        b *= 2
    return {doc: sorted(d.runs, key=lambda r: (r[0], r[2])) for doc, d in found.items() if d.runs}


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words lo to hi, joined by one space, without those that repeat a run's first period."""
    keep = np.ones(hi - lo, dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    parts = []
    for i in range(lo, hi, JOINED):
        j = min(hi, i + JOINED)
        words = data[starts[i] : ends[j - 1]].tobytes().split()
        parts.append(b" ".join(compress(words, keep[i - lo : j - lo].tolist()) if runs else words))
    return b" ".join(filter(None, parts))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with n_words, runs and collapsed.

    runs: (start, length, period) in words, by start, then period, as find_runs has them; collapsed: the words that no run repeats, joined by one space. Words are separated by the bytes 20 and 09-0D. A
    null or empty text has no words, no runs and an empty collapsed text. Texts of any length are searched whole, each in one task; rows are taken by themselves, so repeated rows come out alike.
    """

    def fn(column: pa.Array) -> list[pa.Array]:
        data, at = bytes_of(column)
        starts, ends, first = word_spans(data, at)
        found = find_runs(word_numbers(data, starts, ends), first, least, times)
        n = len(column)
        each = [found.get(i, []) for i in range(n)]
        flat = np.array([r for runs in each for r in runs], dtype=np.int64).reshape(-1, 3)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in each])]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"]))
        texts = [_collapsed(data, starts, ends, int(first[i]), int(first[i + 1]), each[i]) for i in range(n)]
        return [pa.array(np.diff(first), pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())]

    return append_columns(docs, text_col, FIELDS, fn, keep)
