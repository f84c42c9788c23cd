"""Difference hash of numeric vectors, kept as four 64-bit words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = ("h0", "h1", "h2", "h3")
HASH_BITS = 256
HISTOGRAM_BUCKETS = HASH_BITS + 1


def tokens(text: Column) -> Column:
    """The words of a text: its parts between blanks and line ends, without empty ones."""
    # Split at one plain character, which needs no regular expression.
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def word_bucket(word: Column, buckets: int = HISTOGRAM_BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def word_histogram(words: Column, buckets: int = HISTOGRAM_BUCKETS) -> Column:
    """How many of the words fall into each bucket: an array of `buckets` counts.

    Every bucket number is added once, so that after sorting each bucket forms one run; the
    counts are the distances between the run ends, less the added one. This needs one sort per
    row and no shuffle. `sort_array` compares numbers as they are; `array_sort` would evaluate a
    function for every comparison.
    """
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    marked = F.sort_array(F.concat(F.transform(words, lambda w: word_bucket(w, buckets)), every))

    def run_ends(m: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(m)),
            lambda i: (i == F.size(m)) | (F.get(m, i) != F.get(m, i - 1)),
        )

    def lengths(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, buckets - 1))
        return F.zip_with(ends, starts, lambda end, start: end - start - 1)

    return once(once(marked, run_ends), lengths)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def difference_words(vector: Column) -> list[Column]:
    """The 256 bits 'greater than the left neighbour' of a 257-element array, as four words.

    A shorter array leaves the bits beyond its end 0.
    """
    words = []
    for w in range(4):
        left = F.slice(vector, 64 * w + 1, 64)
        right = F.slice(vector, 64 * w + 2, 64)
        bits = F.zip_with(right, left, lambda r, l: F.coalesce(r > l, F.lit(False)).cast("long"))
        # The first bit becomes the lowest: fold from the last element on, shifting left.
        word = F.aggregate(
            F.reverse(bits), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)
        )
        words.append(word.alias(WORDS[w]))
    return words


def hamming(a: str, b: str) -> Column:
    """Number of differing bits between the hash words of two aliased tables."""
    total = None
    for w in WORDS:
        differing = F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
        total = differing if total is None else total + differing
    return total


def circular_bits(words: Column, start: Column | int, length: int) -> Column:
    """`length` (< 64) bits of the hash from bit `start` on, wrapping round at bit 255.

    `words` is the array of the four words; `start` may be a column.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    start = start % HASH_BITS
    offset = start % 64
    word = F.shiftright(start, 6)
    first = F.get(words, word)
    second = F.get(words, (word + 1) % 4)
    head = F.call_function("shiftrightunsigned", first, offset)
    # A shift by 64 would leave the word as it is, so an aligned window takes no second part.
    tail = F.when(offset == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", second, 64 - offset)
    )
    return head.bitwiseOR(tail).bitwiseAND(F.lit((1 << length) - 1))
