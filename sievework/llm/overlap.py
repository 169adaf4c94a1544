"""Problem 3: same or near-same records across splits, by a compressed full-text index.

Texts of the evaluation splits are laid end to end in shards of about
``SHARD_CHARS`` characters. A shard is kept as its compressed Burrows–Wheeler
transform and a sketch of each text: no text, no suffix array, no table of
characters by blocks. A worker that has a candidate in it walks the transform
back from the end of that text, which locates the text's suffixes.

Training texts stream through the shards, one shard after the other:

1. *Sketches.* Each distinct 5-character stretch falls on one bit of a sketch,
   which is the parity of the stretches that do. A stretch that two texts share
   changes both sketches alike, so these differ in at most as many bits as the
   texts have stretches not in common.
2. *Candidates.* Texts of ``n`` and ``m`` distinct stretches with a similarity
   of ``t`` have at most ``(1 - t) / (1 + t) (n + m)`` of them not in common.
   Pairs whose sketches differ in more bits are no match; the others are
   candidates. Nothing is estimated, so no pair is lost.
3. *Maximal matches.* Selecting the rows of one text from the index of a shard
   leaves the index of that text. In it the search of the training text runs
   backward for as long as the interval isn't empty; where it stops, a match is
   maximal to the left, and the next one starts so that no stretch is passed
   over. Candidates of several shards advance together, character by character.
4. *Merged spans and counts.* Matches that overlap are one span. The distinct
   stretches inside the spans are those the texts share, which with the numbers
   of stretches of both gives the exact similarity.

Equal texts are collapsed to one class first and expanded at the end. Shards
and blocks hold texts of a narrow range of sizes: a training text is in one
block, and a block meets only the shards whose sizes allow a match, at most
``MOST_SHARDS`` in one task, of which one is open at a time. Texts longer
than ``GIANT_CHARS`` are not indexed in one task: their stretches and those of
all texts of like size are counted by joins.

Edge cases: null and blank texts, and texts without a word character, are
never a case; a text shorter than a stretch counts as one stretch, itself;
rows with an unknown or null split take no part; equal texts within one split
are no pair; a topic that occurs twice gives each pair once; empty tables give
no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..operators.skew import HOT_ROWS, salted_join

SIMILARITY = 0.8
STRETCH = 5
SHARD_CHARS = 1_000_000
#: Characters of a block of training texts: at most so many, and so few that there are ``BLOCKS`` of them, but no less than two shards.
TRAIN_CHARS, BLOCKS = 40_000_000, 12
GIANT_CHARS = 1_000_000
#: Shards that one task meets; a block that meets more is sent to several tasks.
MOST_SHARDS = 128
#: Bits of a sketch for each stretch of the largest text of its band, and bits of a mark.
SKETCH_SHARE, MARK_BITS = 0.75, 40
_ODD = np.random.default_rng(3).integers(0, 1 << 63, STRETCH + 1, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bounds of what one step of a search holds: candidates, pairs whose sketches are compared (so that they stay in the cache), pairs that advance together.
MOST_HITS, MOST_CELLS, MOST_LANES = 250_000, 60_000, 20_000
EVALUATION = ("dev", "test")
_WORDS = re.compile(r"\w+").findall
#: Steps of the sizes by which shards are told apart.
SIZE_STEP = 1.12
#: Characters of all texts for which a table takes the place of a search.
MOST_SHIFTS = 4_000_000


def normal(text: str | None) -> str:
    """Case-folded words joined by single blanks."""
    return " ".join(_WORDS(text.casefold())) if text else ""


def stretches(text: str) -> set[str]:
    """All stretches of a text; a shorter text is its own only one."""
    return {text[i : i + STRETCH] for i in range(max(1, len(text) - STRETCH + 1))} if text else set()


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, each closed by a 0, and where each starts."""
    joined = "".join(t + "\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *(len(t) + 1 for t in texts)])


def _coded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters that occur, in order, and the number of each place's."""
    seen = np.bincount(points) > 0
    alphabet = np.flatnonzero(seen)
    return alphabet, (np.cumsum(seen) - 1)[points]


def _set(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting is faster here than numpy's hashing."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Grams:
    """The stretches of several texts, numbered alike over all of them.

    ``number`` gives the stretch at each place that has one, text by text;
    those of text ``i`` begin at ``first[i]``, ``starts[i]`` is where its
    characters begin, and ``spelled`` holds the characters of each number.
    """

    def __init__(self, texts: list[str]):
        points, self.starts = _points(texts)
        counts = np.maximum(np.diff(self.starts) - STRETCH, 0)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.alphabet, self.code = _coded(points)
        sigma, n = len(self.alphabet), len(points) - STRETCH + 1
        place = np.arange(self.first[-1]) + np.repeat(self.starts[:-1] - self.first[:-1], counts)
        if n <= 0:
            self.number, self.spelled = np.empty(0, np.int64), np.empty((0, STRETCH), np.int64)
            return
        key = self.code[:n]
        for k in range(1, STRETCH):
            if len(self.alphabet) ** STRETCH >= 1 << 62:  # many scripts: numbers of shorter stretches stand for them
                key = np.searchsorted(_set(key), key)
            key = key * sigma + self.code[k : k + n]
        key = key[place]
        known = _set(key)
        self.number = np.searchsorted(known, key)
        at = np.empty(len(known), np.int64)
        at[self.number] = place
        self.spelled = self.code[at[:, None] + np.arange(STRETCH)]

    def __len__(self) -> int:
        return len(self.spelled)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """``(text, number)`` of each text's distinct stretches, by text."""
        both = _set(self.owner * max(1, len(self)) + self.number)
        return np.divmod(both, max(1, len(self)))


def sizes_of(texts: list[str]) -> np.ndarray:
    """Numbers of distinct stretches."""
    points, starts = _points(texts)
    counts = np.maximum(np.diff(starts) - STRETCH, 0)
    alphabet, code = _coded(points)
    bits = max(1, (len(alphabet) - 1).bit_length()) * STRETCH
    if bits + len(texts).bit_length() > 63:
        return np.array([len(stretches(t)) for t in texts], np.int64)
    n = max(0, len(points) - STRETCH + 1)
    key = np.zeros(n, np.int64)
    for k in range(STRETCH):
        key = (key << (bits // STRETCH)) | code[k : k + n]
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    found = np.bincount(_set((owner << bits) | key[place]) >> bits, minlength=len(texts))
    # A shorter text is its own only stretch.
    return np.maximum(found, [min(1, len(t)) for t in texts]).astype(np.int64)


def bands_of(sizes: np.ndarray) -> np.ndarray:
    """Bands of sizes; each is wider than the one before it by ``SIZE_STEP``."""
    return np.floor(np.log(np.maximum(sizes, 1)) / math.log(SIZE_STEP)).astype(np.int64)


def words_of(band: int) -> int:
    """Words of 64 bits in a sketch of the band: half of the bits are more than the differences a match may have."""
    return max(2, math.ceil(SKETCH_SHARE * SIZE_STEP ** (band + 1) / 64))


def marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, mark)`` of each text's distinct stretches, by text; a mark has ``MARK_BITS`` bits and follows from the stretch alone."""
    points, starts = _points(texts)
    counts = np.maximum(np.diff(starts) - STRETCH, 0)
    n = max(0, len(points) - STRETCH + 1)
    mark = np.zeros(n, np.uint64)
    for k in range(STRETCH):
        mark += points[k : k + n] * _ODD[k]
    mark ^= mark >> np.uint64(29)
    mark *= _ODD[STRETCH]
    mark >>= np.uint64(64 - MARK_BITS)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    both = _set((owner << MARK_BITS) | mark[place].astype(np.int64))
    return both >> MARK_BITS, both & ((1 << MARK_BITS) - 1)


def parities(owner: np.ndarray, mark: np.ndarray, low: int, high: int, words: int) -> np.ndarray:
    """Sketches of texts ``low`` to ``high``, a row for each word: a bit is the parity of the number of stretches whose marks fall on it.

    Two sketches differ in at most as many bits as the texts have stretches not in common.
    """
    a, b = np.searchsorted(owner, [low, high])
    bits = words * 64
    at = (owner[a:b] - low) * bits + ((mark[a:b] * bits) >> MARK_BITS)
    odd = (np.bincount(at, minlength=(high - low) * bits) & 1).astype(np.uint8).reshape(high - low, bits)
    return np.ascontiguousarray(np.packbits(odd, axis=1).view(np.uint64).T)


class TextIndex:
    """A Burrows–Wheeler index of several texts that tells which text an occurrence is in.

    Rows are the suffixes in order, each up to the end of its text, equal ones
    by text. ``last`` is the character before each; ``keys`` holds
    ``character * (rows + 1) + row`` in order, so the rows of one character lie
    together and a backward step is one binary search, whatever the alphabet.
    """

    def __init__(self, texts: list[str], sizes: np.ndarray | None = None):
        points, _ = _points(texts)
        # Character 0 only ends texts: a word never holds it.
        self.alphabet, code = _coded(points)
        order = self._sorted(code)
        kind = np.uint8 if len(self.alphabet) <= 1 << 8 else np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        self.last = code[order - 1].astype(kind)
        self.sizes = sizes_of(texts) if sizes is None else np.asarray(sizes, np.int64)
        self.rows, self.texts = len(self.last), len(texts)
        owner, mark = marks(texts)
        band = np.where([len(t) >= STRETCH for t in texts], bands_of(self.sizes), -1)
        by_band = np.lexsort((self.sizes, band))
        place = np.empty(len(texts), np.int64)
        place[by_band] = np.arange(len(texts))
        turned = np.argsort(place[owner], kind="stable")
        owner, mark = place[owner][turned], mark[turned]
        #: Numbers and sketches of the texts by their band of sizes, in order of size.
        self.sketches = {}
        for b in _set(band[band >= 0]).tolist():
            x, y = np.searchsorted(band[by_band], [b, b + 1]).tolist()
            self.sketches[b] = by_band[x:y], parities(owner, mark, x, y, words_of(b))

    @cached_property
    def keys(self) -> np.ndarray:
        by_last = np.argsort(self.last, kind="stable")
        return self.last[by_last].astype(np.int64) * (self.rows + 1) + by_last

    @cached_property
    def before(self) -> np.ndarray:
        """The row of the suffix one character longer; of a whole text, -1."""
        found = np.empty(self.rows, np.int32)
        found[np.argsort(self.last, kind="stable")] = np.arange(self.rows, dtype=np.int32)
        found[self.last == 0] = -1
        return found

    def _walk(self, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, place in texts)`` from the ends of texts back to their starts, all at once."""
        row, place = texts.astype(np.int32), np.arange(len(texts), dtype=np.int32)
        while len(row):
            yield row, place
            row = self.before[row]
            if not (on := row >= 0).all():
                row, place = row[on], place[on]

    @cached_property
    def text_of(self) -> np.ndarray:
        """The text of each row."""
        found = np.zeros(self.rows, np.int32)
        for row, text in self._walk(np.arange(self.texts)):
            found[row] = text
        return found

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(1).compress(pickle.dumps((self.sizes, self.sketches, self.alphabet, self.last), 5))

    @classmethod
    def unpack(cls, blob: bytes) -> TextIndex:
        index = cls.__new__(cls)
        index.sizes, index.sketches, index.alphabet, index.last = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        index.rows, index.texts = len(index.last), len(index.sizes)
        return index

    @staticmethod
    def _sorted(code: np.ndarray) -> np.ndarray:
        """Suffixes in order, each up to the end of its text, equal ones by text.

        Sorts by the first few characters, then doubles the length and sorts
        again what is still tied. The rank of a suffix is the number of
        suffixes before its group. Where it fits, what is sorted and its place
        share one number.
        """
        n = len(code)
        bits, per = n.bit_length(), max(1, int(code.max()).bit_length())
        mask = (1 << bits) - 1
        ends = np.flatnonzero(code == 0)
        end_of = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        width = max(1, (63 - bits) // per)
        padded = np.concatenate([code, np.zeros(width, code.dtype)])
        key, going = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            key = (key << per) | np.where(going, padded[k : k + n], 0)
            going &= padded[k : k + n] != 0
        ordered = np.sort((key << bits) | np.arange(n))
        order, ordered = ordered & mask, ordered >> bits
        at = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), at, 0))
        # Ends of texts come first, in the order of the texts, so no two of them are tied.
        rank[ends] = np.arange(len(ends))
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(tied):
            ahead = rank[np.minimum(tied + width, end_of[tied])]
            both = (rank[tied] << bits) | ahead
            if 3 * bits <= 63:
                both = np.sort((both << bits) | np.arange(len(tied)))
                o, both = both & mask, both >> bits
            else:
                o = np.argsort(both)
                both = both[o]
            tied, g = tied[o], both >> bits
            place = np.arange(len(tied))
            group = np.concatenate([[True], g[1:] != g[:-1]])
            run = np.concatenate([[True], both[1:] != both[:-1]])
            start = np.maximum.accumulate(np.where(run, place, 0))
            rank[tied] = g + start - np.maximum.accumulate(np.where(group, place, 0))
            tied = tied[np.bincount(start, minlength=len(tied))[start] > 1]
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = at
        return order

    def slots(self, alphabet: np.ndarray) -> np.ndarray:
        """Numbers of characters in the index; of unknown ones, and of the end of a text, -1."""
        slot = np.searchsorted(self.alphabet, alphabet)
        slot[slot == len(self.alphabet)] = 0
        return np.where((self.alphabet[slot] == alphabet) & (alphabet != 0), slot, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of equally long patterns, given as rows of slots, by backward search.

        Patterns that end alike share the search of that ending.
        """
        count, size = patterns.shape
        lo, hi = np.array([0]), np.array([self.rows])
        ending, sigma = np.zeros(count, np.int64), len(self.alphabet) + 1
        for i in range(size - 1, -1, -1):
            key = ending * sigma + patterns[:, i] + 1
            both = _set(key)
            ending = np.searchsorted(both, key)
            parent, c = np.divmod(both, sigma)
            known = np.flatnonzero((c > 0) & (hi[parent] > lo[parent]))
            base = (c[known] - 1) * (self.rows + 1)
            a, b = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
            a[known] = np.searchsorted(self.keys, base + lo[parent[known]])
            b[known] = np.searchsorted(self.keys, base + hi[parent[known]])
            lo, hi = a, b
        return lo[ending], hi[ending]

    def of_texts(self, wanted: np.ndarray) -> list[np.ndarray]:
        """The transforms of single texts, in code points: the rows of each, in the order they have here."""
        steps = list(self._walk(wanted))
        bits = self.rows.bit_length()
        both = np.sort((np.concatenate([p for _, p in steps]).astype(np.int64) << bits) | np.concatenate([r for r, _ in steps]))
        cuts = np.searchsorted(both >> bits, np.arange(1, len(wanted)))
        return np.split(self.alphabet[self.last[both & ((1 << bits) - 1)]], cuts)


class Sketches:
    """The sketches of texts in order of their sizes, for every band of sizes a match of theirs may have."""

    def __init__(self, texts: list[str], sizes: np.ndarray, similarity: float):
        self.order = np.argsort(sizes, kind="stable")
        self.size = sizes[self.order]
        ends = np.cumsum([len(texts[i]) for i in self.order])
        parts: dict[int, list] = {}
        low = 0
        while low < len(texts):
            # Numbers of stretches are held for a part of the texts at a time.
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SHARD_CHARS, "right")))
            if (size := self.size[low:high]).max():
                owner, mark = marks([texts[i] for i in self.order[low:high]])
                for band in range(int(bands_of(size[size > 0][:1] * similarity - 1)[0]), int(bands_of(size[-1:] / similarity + 1)[0]) + 1):
                    x, y = np.searchsorted(size, [max(1, similarity * SIZE_STEP**band - 1), SIZE_STEP ** (band + 1) / similarity + 1])
                    if y > x:
                        parts.setdefault(band, []).append((low + x, parities(owner, mark, int(x), int(y), words_of(band))))
            low = high
        self.bands = {b: (found[0][0], np.concatenate([f[1] for f in found], 1)) for b, found in parts.items()}


def candidates(index: TextIndex, asked: Sketches, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, indexed text)`` of all pairs that can reach the similarity, in steps."""
    apart = (1 - similarity) / (1 + similarity)
    for band, (names, bits) in index.sketches.items():
        first, theirs = asked.bands.get(band, (0, None))
        if theirs is None:
            continue
        sizes, rows = index.sizes[names], max(1, MOST_CELLS // len(names))
        buffers = [np.empty(min(rows, theirs.shape[1]) * len(names), kind) for kind in (np.uint64, np.uint8, np.uint8, np.uint16)]
        for at in range(0, theirs.shape[1], rows):
            n = asked.size[first + at : first + min(at + rows, theirs.shape[1])]
            # Both sides are in order of their sizes.
            left, right = np.searchsorted(sizes, [similarity * n[0] - 1e-6, n[-1] / similarity + 1e-6]).tolist()
            if left == right:
                continue
            m, shape = sizes[left:right], (len(n), right - left)
            x, c, part, differ = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in buffers)
            most = apart * (n[-1] + m[-1]) + 1e-6
            words = min(len(bits), 1000, math.ceil((most + 4 * math.sqrt(most)) / (0.44 * 64)))
            differ[:] = 0
            for w in range(words):
                np.bitwise_xor(theirs[w, at : at + len(n), None], bits[w, left:right], out=x)
                # Three words fit the byte in which they are counted.
                if w % 3:
                    part += np.bitwise_count(x, out=c)
                else:
                    np.bitwise_count(x, out=part)
                if w % 3 == 2 or w == words - 1:
                    differ += part
            i, j = np.nonzero(differ <= min(int(most), 65535))
            # The bounds of the pair itself.
            by = differ[i, j].astype(np.int64)
            keep = (m[j] >= similarity * n[i] - 1e-6) & (similarity * m[j] <= n[i] + 1e-6) & (by <= apart * (n[i] + m[j]) + 1e-6)
            i, j, by = i[keep], j[keep], by[keep]
            for w in range(words, len(bits)):
                by += np.bitwise_count(theirs[w, at + i] ^ bits[w, left + j])
            keep = by <= apart * (n[i] + m[j]) + 1e-6
            if keep.any():
                yield asked.order[first + at + i[keep]], names[left + j[keep]]


def maximal_matches(grams: Grams, texts: np.ndarray, others: list[np.ndarray], of: np.ndarray):
    """``(pair, from, to)`` of matches that cover every stretch the two texts of a pair share.

    Pair ``k`` is of text ``texts[k]`` of ``grams`` and the text with the transform
    ``others[of[k]]``. Places count over all texts of ``grams``. Each match is
    maximal to the left; the next begins so that the stretch which ended it is
    tried next.
    """
    sigma = len(grams.alphabet) + 1
    lengths = np.array([len(o) for o in others])
    begins = np.cumsum(lengths) - lengths
    points = np.concatenate(others)
    slot = np.minimum(np.searchsorted(grams.alphabet, points), len(grams.alphabet) - 1)
    # Characters that no text of the block has can't be searched: number 0 is left to them and to the ends.
    slot = np.where((grams.alphabet[slot] == points) & (points != 0), slot + 1, 0)
    total = len(points) + 1
    text = np.repeat(np.arange(len(others)), lengths)
    keys = np.sort((text * sigma + slot) * total + np.arange(len(points)))
    # Rows of a text start with its characters in the order of their code points, the end first.
    top = int(grams.alphabet[-1]) + 2
    smaller = np.sort(text * top + np.minimum(points, top - 1))

    def shift(o: np.ndarray, c: np.ndarray) -> np.ndarray:
        """From the place in ``keys`` of a character in a transform to the row it stands for, in the rows of that text."""
        return np.searchsorted(smaller, o * top + grams.alphabet[c]) - begins[o] - np.searchsorted(keys, (o * sigma + c + 1) * total)

    if len(others) * sigma <= MOST_SHIFTS:
        table = shift(np.repeat(np.arange(len(others)), sigma - 1), np.tile(np.arange(sigma - 1), len(others)))
        shift = lambda o, c: table[o * (sigma - 1) + c]
    begin, end = grams.starts[texts], grams.starts[texts + 1] - 2
    base = begins[of]
    lo, hi = np.zeros(len(texts), np.int64), lengths[of].astype(np.int64)
    to, i = end.copy(), end.copy()
    out = []
    at = np.flatnonzero(end - begin + 1 >= STRETCH)
    while len(at):
        x = i[at]
        inside = x >= begin[at]
        c = grams.code[np.maximum(x, 0)]
        o = of[at]
        key, more = (o * sigma + c + 1) * total + base[at], shift(o, c)
        a = more + np.searchsorted(keys, key + lo[at])
        b = more + np.searchsorted(keys, key + hi[at])
        ok = inside & (b > a)
        gone = at[ok]
        lo[gone], hi[gone], i[gone] = a[ok], b[ok], x[ok] - 1
        stop = at[~ok]
        long = to[stop] - i[stop] >= STRETCH
        ended = stop[long]
        out.append((ended, i[ended] + 1, to[ended] + 1))
        to[ended] = i[ended] + STRETCH - 1
        # A match that reached the start leaves nothing before it.
        to[ended[i[ended] < begin[ended]]] = -1
        to[stop[~long]] -= 1
        i[stop], lo[stop], hi[stop] = to[stop], 0, lengths[of[stop]]
        if len(stop):
            at = at[to[at] - begin[at] + 1 >= STRETCH]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))


def verified(
    texts: list[str], sizes: np.ndarray, i: np.ndarray, of: np.ndarray, others: list[np.ndarray], their: np.ndarray, similarity: float
) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, other, shared, union, covered)`` of the candidates that reach the similarity; ``others`` are transforms of texts of sizes ``their``."""
    length = np.array([len(texts[x]) for x in i.tolist()])
    order = np.lexsort((i, length))
    i, of, length = i[order], of[order], length[order]
    # Texts whose stretches are numbered together are bounded by their characters, pairs by their number.
    chars = np.cumsum(np.where(np.concatenate([[True], i[1:] != i[:-1]]), length, 0))
    low = 0
    while low < len(i):
        high = min(low + MOST_LANES, max(low + 1, int(np.searchsorted(chars, chars[low] + SHARD_CHARS, "right"))))
        own, mine = np.unique(i[low:high], return_inverse=True)
        known, theirs = np.unique(of[low:high], return_inverse=True)
        grams = Grams([texts[x] for x in own.tolist()])
        pair, start, stop = maximal_matches(grams, mine, [others[y] for y in known.tolist()], theirs)
        order = np.lexsort((start, pair))
        pair, start, stop = pair[order], start[order], stop[order]
        bounds = np.searchsorted(pair, np.arange(high - low + 1))
        for g, x, y, a, b in zip(mine.tolist(), i[low:high].tolist(), of[low:high].tolist(), bounds[:-1], bounds[1:]):
            if a == b:
                continue
            begin, first = grams.starts[g], grams.first[g]
            # Merged spans: a match may reach into the one before it.
            reach = np.maximum.accumulate(np.concatenate([[begin], stop[a:b]]))[:-1]
            covered = int((stop[a:b] - np.maximum(start[a:b], reach)).clip(0).sum())
            mark = np.zeros(grams.first[g + 1] - first + 1, np.int64)
            np.add.at(mark, start[a:b] - begin, 1)
            np.add.at(mark, stop[a:b] - STRETCH + 1 - begin, -1)
            shared = len(_set(grams.number[first : grams.first[g + 1]][np.cumsum(mark[:-1]) > 0]))
            union = int(sizes[x] + their[y] - shared)
            if shared * 10**9 >= round(similarity * 10**9) * union:
                yield x, y, shared, union, covered
        low = high


def matches(
    indexes: Iterable[TextIndex], texts: list[str], similarity: float, sizes: np.ndarray | None = None
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(text, index, indexed text, shared, union, covered)`` of every pair that reaches the similarity.

    ``indexes`` are met one after the other; of each only the transforms of
    candidates are kept until there are enough to search them together.
    """
    sizes = np.where([len(t) >= STRETCH for t in texts], sizes_of(texts) if sizes is None else sizes, 0)
    if not sizes.any():
        return
    asked = Sketches(texts, sizes, similarity)
    i, of, names, others, their, chars = [], [], [], [], [], 0

    def search() -> Iterator[tuple[int, int, int, int, int, int]]:
        if i:
            for x, y, *counts in verified(texts, sizes, np.concatenate(i), np.concatenate(of), others, np.array(their), similarity):
                yield x, *names[y], *counts
        for held in (i, of, names, others, their):
            held.clear()

    for k, index in enumerate(indexes):
        for own, j in _gathered(candidates(index, asked, similarity), MOST_HITS):
            wanted, place = np.unique(j, return_inverse=True)
            i.append(own)
            of.append(place + len(others))
            names += [(k, y) for y in wanted.tolist()]
            others += index.of_texts(wanted)
            their += index.sizes[wanted].tolist()
            chars += sum(map(len, others[-len(wanted) :]))
            if chars >= SHARD_CHARS or sum(map(len, i)) >= MOST_HITS:
                yield from search()
                chars = 0
    yield from search()


def _gathered(steps: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps put together until they hold ``most`` pairs."""
    held, count = [], 0
    for step in steps:
        held.append(step)
        count += len(step[0])
        if count >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def normalised(records: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """``(key, split, class, norm, size)`` of every text with a word; the class is a digest of the normal form."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                forms = [normal(t) for t in part.column(2).to_pylist()]
                keep = pa.array([i for i, t in enumerate(forms) if t], pa.int64())
                forms = [t for t in forms if t]
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in forms]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(keep), part.column(1).take(keep), pa.array(digests, pa.binary()), pa.array(forms, pa.string()),
                     pa.array(sizes_of(forms) if forms else [], pa.int64())],
                    names=["key", "split", "class", "norm", "size"],
                )

    source = records.select(records[key].alias("key"), records[split].alias("split"), records[text].alias("text"))
    source = source.where("key is not null and split is not null and text is not null")
    kinds = [source.schema[c].dataType.simpleString() for c in ("key", "split")]
    return source.mapInArrow(batches, f"key {kinds[0]}, split {kinds[1]}, class binary, norm string, size long")


PAIRS = "train_class binary, eval_class binary, shared long, union long, covered long"


def _cuts(volumes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """``(band, first, parts)``: bands of sizes put together up to ``most`` characters, or cut into parts of it."""
    out, number, filled = [], -1, most
    for band in sorted(volumes):
        parts = max(1, math.ceil(volumes[band] / most))
        if parts > 1 or filled + volumes[band] > most:
            number, filled = number + 1, 0
        out.append((band, number, parts))
        filled += volumes[band]
        if parts > 1:
            number, filled = number + parts - 1, most
    return out


def class_pairs(classes: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """``(train_class, eval_class, shared, union, covered)`` of different classes that reach the similarity.

    ``classes`` has one row per class: ``class, norm, size, in_train, in_eval``.
    """
    spark = classes.sparkSession
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(SIZE_STEP)).cast("int")
    # A text shorter than a stretch is like no other text.
    classes = classes.where(F.length("norm") >= STRETCH).withColumn("band", band)
    giant = F.length("norm") > GIANT_CHARS
    usual = classes.where(~giant)
    chars = lambda side: F.coalesce(F.sum(F.when(F.col(side) & ~giant, F.length("norm"))), F.lit(0))
    # One row per band; bands grow with the logarithm of the longest text.
    volume = classes.groupBy("band").agg(
        chars("in_eval").alias("held"), chars("in_train").alias("asked"),
        *(F.count_if(giant & F.col(side)).alias(name) for side, name in (("in_train", "large_asked"), ("in_eval", "large_held"))),
    ).collect()
    shards = _cuts({r["band"]: r["held"] for r in volume if r["held"]}, SHARD_CHARS)
    asked = {r["band"]: r["asked"] for r in volume if r["asked"]}
    blocks = _cuts(asked, min(TRAIN_CHARS, max(2 * SHARD_CHARS, sum(asked.values()) // BLOCKS)))
    far = math.ceil(-math.log(similarity) / math.log(SIZE_STEP))
    spread_ = lambda cut: {(n + p, b) for b, n, parts in cut for p in range(parts)}
    meets = sorted({(s, k) for s, x in spread_(shards) for k, b in spread_(blocks) if abs(x - b) <= far})
    # A text too long for an index is compared with all of like size, which may be far shorter.
    near_large = {c: sorted({r["band"] + d for r in volume if r[c] for d in range(-far, far + 1)}) for c in ("large_asked", "large_held")}
    found = None
    if any(near_large.values()):
        large_asked, large_held = classes.where(giant & F.col("in_train")), classes.where(giant & F.col("in_eval"))
        parts = [
            (large_asked, classes.where("in_eval").where(F.col("band").isin(near_large["large_asked"]))),
            (usual.where("in_train").where(F.col("band").isin(near_large["large_held"])), large_held),
        ]
        found = giant_pairs([p for p, bands in zip(parts, near_large.values()) if bands], classes.select("class", "size"), similarity)
    if not meets:
        return found if found is not None else spark.createDataFrame([], PAIRS)

    def placed(side: str, cut: list[tuple[int, int, int]], name: str) -> DataFrame:
        where = spark.createDataFrame(cut, "band int, first int, parts int")
        return usual.where(side).join(F.broadcast(where), "band").select(
            (F.col("first") + F.pmod(F.xxhash64("class"), F.col("parts"))).cast("int").alias(name), "class", "norm", "size"
        )

    def build(texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("class")
        blob = TextIndex(list(texts["norm"]), texts["size"].to_numpy()).pack()
        return pd.DataFrame({"shard": texts["shard"].iloc[:1], "classes": [list(texts["class"])], "blob": [blob]})

    held = placed("in_eval", shards, "shard").groupBy("shard").applyInPandas(build, "shard int, classes array<binary>, blob binary")
    # What one task reads is bounded: a block and at most MOST_SHARDS shards.
    tasks, asks, of_block = [], [], {}
    for shard, block in meets:
        of_block.setdefault(block, []).append(shard)
    for block in sorted(of_block):
        for at in range(0, len(of_block[block]), MOST_SHARDS):
            tasks += [(shard, len(asks)) for shard in of_block[block][at : at + MOST_SHARDS]]
            asks.append((block, len(asks)))
    sent = scratch.save(held).join(F.broadcast(spark.createDataFrame(tasks, "shard int, task int")), "shard")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            names, others = list(left["class"]), list(right["classes"])
            indexes = (TextIndex.unpack(b) for b in right["blob"])
            for i, k, j, *counts in matches(indexes, list(left["norm"]), similarity, left["size"].to_numpy()):
                if names[i] != others[k][j]:
                    rows.append((names[i], others[k][j], *counts))
        return pd.DataFrame(rows, columns=["train_class", "eval_class", "shared", "union", "covered"])

    train = placed("in_train", blocks, "block").join(F.broadcast(spark.createDataFrame(asks, "block int, task int")), "block")
    near = train.groupBy("task").cogroup(sent.groupBy("task")).applyInPandas(search, PAIRS)
    return near if found is None else near.unionByName(found)


def giant_pairs(parts: list[tuple[DataFrame, DataFrame]], sizes: DataFrame, similarity: float) -> DataFrame:
    """``class_pairs`` of pairs of which a text is too long for one task's index: distinct stretches are joined and counted.

    ``parts`` are training and evaluation classes that meet. There are few texts
    so long, at most one per ``GIANT_CHARS`` characters of the corpus.
    """

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = sorted(stretches(text))
                for at in range(0, len(own), 50_000):
                    some = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.binary()), pa.array(some, pa.string())], names=["class", "g"])

    spelled = lambda side, name: side.select("class", "norm").mapInArrow(spell, "class binary, g string").withColumnRenamed("class", name)
    shared = reduce(DataFrame.unionByName, [
        spelled(left, "train_class").join(spelled(right, "eval_class"), "g").where("train_class != eval_class").groupBy("train_class", "eval_class").agg(F.count(F.lit(1)).alias("shared"))
        for left, right in parts
    ])
    both = shared.join(sizes.toDF("train_class", "a"), "train_class").join(sizes.toDF("eval_class", "b"), "eval_class")
    both = both.withColumn("union", F.col("a") + F.col("b") - F.col("shared"))
    # The span is not measured for these: at least the shared stretches are covered.
    return both.where(F.col("shared") * 10**9 >= F.lit(round(similarity * 10**9)) * F.col("union")).select(
        "train_class", "eval_class", "shared", "union", F.col("shared").alias("covered")
    )


def overlaps(
    records: DataFrame, scratch: Scratch, key: str = "topic_id", text: str = "text", split: str = "split",
    similarity: float = SIMILARITY, evaluation: tuple[str, ...] = EVALUATION, train: str = "train", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(train_key, eval_key, eval_split, shared, union, covered)`` of every overlapping pair of records."""
    whole = scratch.save(
        normalised(records, key, text, split)
        .where(F.col("split").isin(train, *evaluation))
        .withColumn("is_train", F.col("split") == train)
    )
    classes = scratch.save(
        whole.groupBy("class").agg(
            F.first("norm").alias("norm"), F.first("size").alias("size"),
            F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"),
        )
    )
    # The texts themselves are kept once.
    texts = scratch.save(whole.drop("norm", "size"))
    scratch.drop(whole)
    near = class_pairs(classes, scratch, similarity)
    same = classes.where("in_train and in_eval").select(
        F.col("class").alias("train_class"), F.col("class").alias("eval_class"),
        F.col("size").alias("shared"), F.col("size").alias("union"), F.length("norm").cast("long").alias("covered"),
    )
    pairs = scratch.save(near.unionByName(same))
    left = texts.where("is_train").select(F.col("class").alias("train_class"), F.col("key").alias("train_key")).distinct()
    right = texts.where("not is_train").select(
        F.col("class").alias("eval_class"), F.col("key").alias("eval_key"), F.col("split").alias("eval_split")
    ).distinct()
    # A text that very many topics have is spread over tasks by the topic.
    found = salted_join(right, salted_join(left, pairs, "train_class", "train_key", hot_rows), "eval_class", "eval_key", hot_rows)
    return found.select("train_key", "eval_key", "eval_split", "shared", "union", "covered")
