"""Text expressions: tokens, words, stretches, windows and hashes. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual English stop list of 33 words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
TERM = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-case terms of two characters or more without stop words, in order; null for null."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def normal_words(text: str | Column) -> Column:
    """Lower-case words joined by one blank: what isn't a word becomes the blank, without a list in between."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " "))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once per row, also where it is used inside a lambda."""
    return F.transform(F.array(value), then)[0]


def shingles(text: str | Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` words; none for shorter texts."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return _once(words(text), runs)


def char_grams(text: str | Column, n: int = 5) -> Column:
    """Distinct stretches of ``n`` characters of the normal words; a shorter text is its own only one."""

    def grams(c: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))
        return F.when(F.size(c) < n, F.array(F.array_join(c, ""))).otherwise(F.array_distinct(every))

    return _once(F.split(normal_words(text), ""), grams)


def window_starts(count: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` that overlap by ``overlap``; the last one ends at the end."""
    step = size - overlap
    last = F.greatest(F.ceil((count - size) / F.lit(float(step))).cast("int"), F.lit(0))
    return F.when(count <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def hash_bucket(value: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of SHA-256, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hash_split(value: Column) -> Column:
    """60 % train, 20 % dev, 20 % test, by hash."""
    b = hash_bucket(value)
    return F.when(b < 60, "train").when(b < 80, "dev").otherwise("test")
