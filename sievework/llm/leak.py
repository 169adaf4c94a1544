"""Problem 8: evaluation passages inside training documents, by the q-gram lemma.

A passage of ``w`` characters that stands in a document with at most ``e``
edits shares at least ``w + 1 - q * (e + 1)`` of its q-grams with it, all on
diagonals (document position minus item position) that differ by at most
``e``. So: look up the q-grams of the document in an index of the items; keep
the places where enough of them fall into ``w`` characters; among these, count
the hits of each item in overlapping bands of diagonals (each band ``2e + 1``
wide, starting every ``e + 1``); verify regions that reach the bound by an
alignment in the band. ``w`` is the shortest stretch of the required number of
words in any item, so the bound holds for every such stretch.

Words are runs of letters and digits after NFKD and case folding, without
combining marks (Mn) and format characters (Cf). The exact check that follows
keeps an item if ``words`` consecutive words of it stand consecutively in the
document.

Items are indexed in blocks of about ``BLOCK_CHARS`` characters, whatever their
number. A pass over the documents searches ``AT_ONCE`` blocks; a worker builds
the index of a block once, for all its tasks of the pass. Documents are never
shuffled.

Edge cases: null and blank texts match nothing; an item of fewer words than
required matches nothing; repeated documents and items each give their rows;
a document of any length is searched whole, in steps.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
EDITS = 1
MOST_Q = 16
BLOCK_CHARS = 4_000_000
AT_ONCE = 4
STEP_CHARS = 1_000_000
TABLE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
_ASCII = re.compile(r"[a-z0-9]+").findall
_ANY = re.compile(r"[^\W_]+").findall


@cache
def _dropped() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Cf")}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ASCII(text.lower())
    nfkd = unicodedata.normalize
    return _ANY(nfkd("NFKD", nfkd("NFKD", text).casefold()).translate(_dropped()))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            out *= BASE
            out += chars[i : i + n].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(31)
    return out


class ItemIndex:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], words: int, edits: int):
        self.words, self.edits = words, edits
        self.ids, self.texts, self.windows = [], [], []
        shortest = None
        for number, text in items:
            w = words_of(text)
            if len(w) < words:
                continue
            runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
            shortest = min([shortest or 1 << 30, *map(len, runs)])
            self.ids.append(number)
            self.texts.append(" ".join(w))
            self.windows.append(frozenset(runs))
        self.empty = not self.ids
        if self.empty:
            return
        self.w = shortest
        while self.edits and self.w // (self.edits + 2) < 4:
            self.edits -= 1
        self.q = max(1, min(MOST_Q, self.w // (self.edits + 2)))
        self.least = self.w + 1 - self.q * (self.edits + 1)
        hashes, item, place = [], [], []
        for i, text in enumerate(self.texts):
            h = grams(codes(text), self.q)
            hashes.append(h)
            item.append(np.full(len(h), i, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        hashes, item, place = map(np.concatenate, (hashes, item, place))
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place, diagonal)`` of the exact runs in regions of the text with enough q-grams of the item in a band of diagonals.

        A run is a longest row of q-grams that follow each other on one diagonal, given by its first place.
        """
        h = grams(chars, self.q)
        nothing = (np.empty(0, np.int64),) * 3
        if not len(h):
            return nothing
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.searchsorted(self.hashes, h[maybe])
        slot[slot == len(self.hashes)] = 0
        same = self.hashes[slot] == h[maybe]
        at, slot = maybe[same], slot[same]
        span = self.w - self.q
        if len(at) < self.least:
            return nothing
        # Stretches dense enough with hits of any item, before the hits are spelled out.
        dense = at[self.least - 1 :] - at[: len(at) - self.least + 1] <= span + self.edits
        mark = np.zeros(len(at) + 1, np.int32)
        starts = np.flatnonzero(dense)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + self.least, -1)
        keep = np.cumsum(mark[:-1]) > 0
        at, slot = at[keep], slot[keep]
        if not len(at):
            return nothing
        n = self.first[slot + 1] - self.first[slot]
        where = np.repeat(at, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slot], n)
        item, diagonal = self.item[entry].astype(np.int64), where - self.place[entry]
        step, shift = self.edits + 1, int(diagonal.min())
        band = (diagonal - shift) // step
        key = item * (int(band.max()) + 2) + band
        # Runs, in the order of item, diagonal and place.
        size, reach = len(chars) + 1, int(diagonal.max()) - shift + 2 * step + 1
        runs = np.sort((item * reach + diagonal - shift) * size + where)
        first = np.concatenate([[True], runs[1:] != runs[:-1] + 1])
        ends = runs[np.append(np.flatnonzero(first)[1:], len(runs)) - 1]
        runs = runs[first]
        if self.edits:  # each hit also counts in the band before its own, which overlaps it
            key, where, item = np.concatenate([key, key - 1]), np.tile(where, 2), np.tile(item, 2)
        order = np.lexsort((where, key))
        key, where, item = key[order], where[order], item[order]
        m = self.least - 1
        if len(key) <= m:
            return nothing
        hit = np.flatnonzero((key[m:] == key[: len(key) - m]) & (where[m:] - where[: len(where) - m] <= span + self.edits))
        if not len(hit):
            return nothing
        # Hits of one band that overlap make one region.
        a, b, k = where[hit], where[hit + m], key[hit]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] > b[:-1] + self.q)])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(hit)) - 1
        wide = k[head] % (int(band.max()) + 2)
        wide = np.where(wide > int(band.max()), -1, wide)  # the band before the first
        # The runs that touch each region on any diagonal of its band.
        lane = wide[:, None] * step + np.arange(2 * step)
        known = lane >= 0
        base = (item[hit[head]][:, None] * reach + lane)[known] * size
        low = np.searchsorted(runs, base + np.broadcast_to(a[head][:, None], lane.shape)[known], "right") - 1
        low += (low < 0) | (ends[low] < base + np.broadcast_to(a[head][:, None], lane.shape)[known])
        high = np.searchsorted(runs, base + np.broadcast_to(b[last][:, None], lane.shape)[known], "right")
        count = np.maximum(high - low, 0)
        touched = np.unique(np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count))
        lanes, place = np.divmod(runs[touched], size)
        return lanes // reach, place, lanes % reach + shift

    def aligned(self, text: str, k: int, at: int, diagonal: int) -> tuple[int, int] | None:
        """The stretch around a q-gram shared on a diagonal that aligns with item ``k`` within the edits, if it is long enough.

        The alignment runs to both sides of the q-gram, one edit at a time, in the band of diagonals around its own.
        """
        item, p = self.texts[k], at - diagonal
        right = _reach(text, at, item, p, self.edits, 1)
        left = _reach(text, at - 1, item, p - 1, self.edits, -1)
        return (at - left, at + right) if left + right >= self.w - self.edits else None

    def items_in(self, text: str, runs: list[tuple[int, int, int]]) -> dict[int, int]:
        """Of the items with runs ``(item, place, diagonal)`` those with an exact run of words, and the aligned length."""
        out: dict[int, int] = {}
        for k, at, diagonal in runs:
            if k in out:
                continue
            span = self.aligned(text, k, at, diagonal)
            if span is None:
                continue
            # Whole words around the stretch, with room for a run that reaches past it.
            lo = text.rfind(" ", 0, max(0, span[0] - self.w)) + 1
            hi = text.find(" ", min(len(text), span[1] + self.w))
            near = text[lo : hi if hi >= 0 else len(text)].split(" ")
            n = self.words
            if any(" ".join(near[i : i + n]) in self.windows[k] for i in range(len(near) - n + 1)):
                out[k] = span[1] - span[0]
        return out


CHUNK = 16


def _slide(a: str, x: int, b: str, y: int, way: int) -> int:
    """How many characters agree from ``a[x]`` and ``b[y]`` on, to the right or to the left."""
    n = 0
    if way > 0:
        while a[x + n : x + n + CHUNK] == b[y + n : y + n + CHUNK] and x + n + CHUNK <= len(a) and y + n + CHUNK <= len(b):
            n += CHUNK
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
    else:
        while x - n >= 0 and y - n >= 0 and a[x - n] == b[y - n]:
            n += 1
    return n


def _reach(a: str, i: int, b: str, j: int, edits: int, way: int) -> int:
    """How far ``a`` agrees with ``b`` from the places on with at most ``edits`` edits, in characters of ``a``.

    Furthest-reaching points by diagonal, one edit at a time.
    """
    size_a, size_b = (len(a) - i, len(b) - j) if way > 0 else (i + 1, j + 1)
    far = {0: _slide(a, i, b, j, way)}
    best = far[0]
    for _ in range(edits):
        ahead: dict[int, int] = {}
        for d, x in far.items():
            for shift, x2 in ((0, x + 1), (1, x + 1), (-1, x)):  # replaced, only in a, only in b
                y2 = x2 - d - shift
                if x2 <= size_a and 0 <= y2 <= size_b:
                    ahead[d + shift] = max(ahead.get(d + shift, -1), x2 + _slide(a, i + way * x2, b, j + way * y2, way))
        if not ahead:
            break
        far = ahead
        best = max(best, *far.values())
    return min(best, size_a)


def _search(index: ItemIndex, worded: list[tuple[object, str]]) -> tuple[list, list, list]:
    """Rows of the documents of a batch, given as ``(key, words joined by blanks)``: laid end to end and searched in steps."""
    out_key, out_item, out_length = [], [], []
    gap = "\x00" * index.q

    def flush(batch: list[tuple[object, str]]) -> None:
        starts, size = [], 0
        for _, text in batch:
            starts.append(size)
            size += len(text) + len(gap)
        joined = gap.join(text for _, text in batch)
        item, place, diagonal = index.candidates(codes(joined))
        # Runs never reach over the gap between two documents.
        owner = np.searchsorted(np.array(starts), place, "right") - 1
        by_doc: dict[int, list] = {}
        for d, k, at, lane in zip(owner.tolist(), item.tolist(), place.tolist(), diagonal.tolist()):
            by_doc.setdefault(d, []).append((k, at - starts[d], lane - starts[d]))
        for d, found in by_doc.items():
            for k, length in index.items_in(batch[d][1], found).items():
                out_key.append(batch[d][0])
                out_item.append(index.ids[k])
                out_length.append(length)

    batch, size = [], 0
    for one in worded:
        batch.append(one)
        size += len(one[1])
        if size >= STEP_CHARS:
            flush(batch)
            batch, size = [], 0
    if batch:
        flush(batch)
    return out_key, out_item, out_length


def _worded(keys: list, texts: list[str | None], words: int) -> list[tuple[object, str]]:
    """Documents of enough words, as these joined by blanks."""
    split = ((key, words_of(text)) for key, text in zip(keys, texts))
    return [(key, " ".join(w)) for key, w in split if len(w) >= words]


#: Indexes that this worker has built, by the name of their block; those of one pass at most.
_BUILT: dict[str, ItemIndex] = {}


def _index(name: str, shared, names: list[str], words: int, edits: int) -> ItemIndex:
    if name not in _BUILT:
        for old in set(_BUILT) - set(names):
            del _BUILT[old]
        _BUILT[name] = ItemIndex(shared.value, words, edits)
    return _BUILT[name]


def leaked_items(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    words: int = WORDS, edits: int = EDITS,
) -> DataFrame:
    """``(key, item_key, aligned_chars)`` of every document and item that share a run of words."""
    known = items.select(items[item_key].alias("k"), items[text].alias("t")).where("t is not null and k is not null")
    total = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kinds = source.schema["key"].dataType.simpleString(), known.schema["k"].dataType.simpleString()
    arrow = pa.int64() if kinds[1] in ("bigint", "long") else None
    spark, out = documents.sparkSession, None
    for first in range(0, blocks, AT_ONCE):
        held = []
        for b in range(first, min(blocks, first + AT_ONCE)):
            # The driver collects one block at a time; as a broadcast it is kept by the block manager, on disk where memory is short.
            rows = known.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).distinct().collect()
            held.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r["k"], r["t"]) for r in rows])))

        def batches(parts: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names = [name for name, _ in held]
            indexes = [x for x in (_index(name, shared, names, words, edits) for name, shared in held) if not x.empty]
            for part in parts:
                worded = _worded(part.column(0).to_pylist(), part.column(1).to_pylist(), words) if indexes else []
                for index in indexes:
                    keys, found, length = _search(index, worded)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, part.column(0).type), pa.array(found, arrow), pa.array(length, pa.int32())],
                        names=["key", "item", "aligned_chars"],
                    )

        part = source.mapInArrow(batches, f"key {kinds[0]}, item {kinds[1]}, aligned_chars int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item_key})
