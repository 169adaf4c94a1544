"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Bytes are mapped to Latin-1, so that the vocabulary fits an Aho-Corasick
automaton over strings. One pass of the automaton over a word gives the longest
token at every start. The encoder takes it if it agrees with its left
neighbour, else the next shorter token that is its prefix; where none is left
it steps back, and never returns to a place found hopeless, so every place is
left at most once per token length.

Two adjacent tokens agree when merging their joint bytes gives just these two
again. A sequence all of whose neighbours agree is the result of the merges, so
the ids are exactly those of the merge procedure. Agreement is memoised, as
are whole words, in dictionaries of bounded size.

Edge cases: null and empty texts give the empty list; special tokens in a text
are ordinary text; any characters, also unpaired controls and emoji, are
encoded by their UTF-8 bytes; repeated rows are encoded alike; very long words
(no white space) take linear time and are not memoised.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_WORDS = 400_000
MOST_PAIRS = 2_000_000
LONGEST_WORD = 64
#: The split of byte-level BPE with 50,257 ids; a fixed value of the public format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Exact byte-level BPE from a file of ranks (one base64 token and its id per line)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.rank = {base64.b64decode(token).decode("latin-1"): int(number) for token, number in pairs}
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.automaton.add_word(token, (len(token), number))
        self.automaton.make_automaton()
        self.words: dict[str, list[int]] = {}
        self.names = {number: token for token, number in self.rank.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefix: dict[int, int] = {}

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself; used on two tokens at a time."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            a, b = self.names[left], self.names[right]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        known = self.prefix.get(token)
        if known is None:
            name, known = self.names[token], -1
            for n in range(len(name) - 1, 0, -1):
                known = self.rank.get(name[:n], -1)
                if known >= 0:
                    break
            self.prefix[token] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of one word, given as Latin-1 of its bytes.

        Keeps the longest token at each start and, on a way back, goes from a
        token to the next shorter one: memory is a few numbers per byte.
        """
        size, names = len(text), self.names
        longest = array("i", [-1]) * size
        # The automaton reports ends in order, so the last token of a start is its longest.
        for end, (length, number) in self.automaton.iter(text):
            longest[end - length + 1] = number
        chosen = array("i")
        hopeless = bytearray(size + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                after = at + len(names[token])
                if not hopeless[after]:
                    if chosen:
                        if self.agree(chosen[-1], token):
                            break
                    elif after < size or len(self.merge(text)) == 1:
                        break
                token = self.shorter(token)
            if token >= 0:
                chosen.append(token)
                at = after
                if at == size:
                    return chosen.tolist()
                token = longest[at]
            else:
                hopeless[at] = 1
                if not chosen:
                    raise ValueError("the vocabulary lacks a byte")
                last = chosen.pop()
                at -= len(names[last])
                token = self.shorter(last)

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
                number = self.rank.get(raw)
                ids = [number] if number is not None and len(self.merge(raw)) == 1 else self.backtrack(raw)
                if len(word) <= LONGEST_WORD:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_at(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a vocabulary file; the folder is the argument, SIEVEWORK_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("SIEVEWORK_TOKENIZERS", "/opt/tokenizers"), f"{name}.tiktoken")


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids array<int>)`` of every row, in one pass without a shuffle."""
    path = path or vocabulary()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_at(path).encode
        kind = pa.list_(pa.int32())
        for part in parts:
            flat, offsets = [], [0]
            for value in part.column(1):
                value = value.as_py()
                if value:
                    flat += encode(value)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(kind)], names=["key", "ids"])

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(batches, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
