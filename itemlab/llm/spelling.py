"""Spelling variants: words that differ by one letter, each led to a far more frequent neighbour.

One edit moves letter counts by at most two: a replaced letter lowers one count and raises
another, an inserted one raises one count and may push a letter out of the part that is counted.
Letters are counted in the first and in the last half of a word, so that an edit changes one of
the two by at most two and leaves the other as it is. A word is a point of 64 numbers, the counts
of both halves, and its neighbours lie close by.

For each word length the points stand in a k-d tree. Its upper part cuts the length's words into
cells of some ten thousand, by a bounded sample of words; a cell is one task's work. A word asks
the trees of its own length and of the next one: boxes that are too far away, or away in both
halves, are left out, first among cells and then inside them. What a leaf holds is compared by the
parities of all counts at once, and the order of the letters decides.

Nothing is lost where the sample is poor, or where more words than a leaf should have share all
counts: cells or leaves are then larger. Words are of at most 8-bit code points, so a letter is a byte.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import draw
from itemlab.plans.staging import stage

#: Letters, and runs that are long enough to leave a word when one of them is taken out.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form has at least so many times the word's count.
FORM_TIMES = 10
#: One in so many runs of a document loses a letter.
DAMAGED_ONE_IN = 31
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Counts of a half: the letters a to z, and six bins for all others.
BINS = 32
#: How far one edit moves the counts of a half.
MOST_MOVED = 2
#: Words in a cell, about, and in a leaf of its tree.
CELL_WORDS = 65_536
LEAF_WORDS = 64
#: Words that the cells of one length are cut by, for each cell, and of all lengths at most.
SAMPLE_WORDS = 48
MOST_SAMPLED = 1 << 18
#: Pairs, or letters of pairs, that are compared at a time.
BLOCK = 1 << 16
#: Words that ask a tree together.
ASKED = 1 << 17
#: Different runs whose counts a task keeps before it hands them on.
MOST_KEPT = 1 << 18
SEED = 12

_BIN = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)

Node = tuple[int, int, int, int]


def words_of(id: object, text: str | None, run: re.Pattern) -> Counter:
    """The words of a document with their numbers there; `run` matches the runs that can give one."""
    found: Counter = Counter()
    runs: Counter = Counter()
    for word, n in Counter(run.findall(text or "")).items():
        runs[word.lower() if word.isascii() else word.translate(LOWER)] += n
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    for word, n in runs.items():
        number = zlib.crc32(word.encode(), start)
        if number % DAMAGED_ONE_IN == 0:
            at = number % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LETTERS:
            found[word] += n
    return found


def word_counts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(word, n, size) of all words with at least LEAST_COUNT occurrences; `size` is their letters."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    run = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")

    def table(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            for id, text in zip(batch["id"], batch["text"]):
                kept.update(words_of(id.as_py(), text.as_py(), run))
                if len(kept) > MOST_KEPT:
                    yield table(kept)
                    kept = Counter()
        yield table(kept)

    sums = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= LEAST_COUNT).withColumn("size", F.length("word"))


def letters_of(words: list[str]) -> np.ndarray:
    """(words, letters) bytes of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def half_of(size: int) -> int:
    """Letters in either half, when words of `size` meet words that are one shorter or longer.

    Two halves never share a letter, also not in the shorter word, so no edit touches both.
    """
    return (size - 1) // 2


def counts_of(letters: np.ndarray, half: int) -> np.ndarray:
    """(words, 2 * BINS): letter counts of the first and of the last `half` letters; 255 stands for more."""
    rows = np.arange(len(letters))[:, None] * BINS
    both = []
    for part in (letters[:, :half], letters[:, letters.shape[1] - half :]):
        flat = np.bincount((rows + _BIN[part]).ravel(), minlength=len(letters) * BINS)
        both.append(np.minimum(flat, 255).astype(np.uint8).reshape(-1, BINS))
    return np.concatenate(both, axis=1)


def parities_of(counts: np.ndarray) -> np.ndarray:
    """One number of 64 bits for each row of counts: which of them are odd."""
    return np.packbits(counts & 1, axis=1, bitorder="little").view("<u8").ravel()


def grow(points: np.ndarray, most: int) -> tuple[list[Node], np.ndarray]:
    """A k-d tree of rows of counts: nodes, and the rows in the order of the leaves.

    A node is (number, cut, left, right): counts up to the cut go left. Leaves are (-1, start,
    stop, 0) and hold more than `most` rows only where all their counts are equal.
    """
    order = np.arange(len(points))
    nodes: list[Node] = [(-1, 0, len(points), 0)]
    open_nodes = [0]
    while open_nodes:
        at = open_nodes.pop()
        _, start, stop, _ = nodes[at]
        if stop - start <= most:
            continue
        own = order[start:stop]
        part = points[own]
        spread = part.var(axis=0)
        number = int(spread.argmax())
        if spread[number] == 0:
            continue
        values = part[:, number]
        cut = min(int(np.median(values)), int(values.max()) - 1)
        left = values <= cut
        order[start:stop] = np.concatenate([own[left], own[~left]])
        middle = start + int(left.sum())
        nodes[at] = (number, cut, len(nodes), len(nodes) + 1)
        open_nodes += [len(nodes), len(nodes) + 1]
        nodes += [(-1, start, middle, 0), (-1, middle, stop, 0)]
    return nodes, order


def reach(nodes: list[Node], asked: np.ndarray, most: int = MOST_MOVED) -> Iterator[tuple[int, np.ndarray]]:
    """For every leaf the rows of `asked` that its box may hold a neighbour of.

    That is a point at a distance of at most `most` in one half of the counts and of 0 in the other.
    """
    none = np.zeros(len(asked), np.int16)
    stack = [(0, np.arange(len(asked)), (none, none), {})]
    while stack:
        at, rows, far, box = stack.pop()
        number, cut, left, right = nodes[at]
        if number < 0:
            yield at, rows
            continue
        values = asked[rows, number].astype(np.int16)
        low, high = box.get(number, (0, 255))
        side = number // BINS
        other = far[1 - side]
        rest = far[side] - np.maximum(low - values, 0) - np.maximum(values - high, 0)
        for child, a, b in ((left, low, cut), (right, cut + 1, high)):
            now = rest + np.maximum(a - values, 0) + np.maximum(values - b, 0)
            stay = (now <= most) & ((now == 0) | (other == 0))
            if stay.any():
                both = (now[stay], other[stay]) if side == 0 else (other[stay], now[stay])
                stack.append((child, rows[stay], both, box | {number: (a, b)}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one edit; `a` is as long as `b` or one longer."""
    out = np.zeros(len(a), bool)
    step = max(1, 16 * BLOCK // a.shape[1])
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        if x.shape[1] == y.shape[1]:
            out[i : i + step] = (x != y).sum(axis=1) == 1
        else:
            head = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
            out[i : i + step] = head + tail >= y.shape[1]
    return out


def close_pairs(
    rows: np.ndarray, ask_parity: np.ndarray, held: np.ndarray, own_parity: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of `rows` and `held` whose counts differ in few parities."""
    for first in range(0, len(held), BLOCK):
        points = held[first : first + BLOCK]
        step = max(1, BLOCK // len(points))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            odd = ask_parity[part][:, None] ^ own_parity[points][None, :]
            q, p = np.nonzero(np.bitwise_count(odd) <= MOST_MOVED)
            if len(q):
                yield part[q], points[p]


def near_pairs(asked: list[str], points: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (index in `asked`, index in `points`) of words that are one edit apart.

    All of `points` have one length, and all of `asked` the same or one less.
    """
    if not asked or not points:
        return
    own = letters_of(points)
    half = half_of(own.shape[1])
    own_counts = counts_of(own, half)
    nodes, order = grow(own_counts, LEAF_WORDS)
    own_parity = parities_of(own_counts)
    for first in range(0, len(asked), ASKED):
        ask = letters_of(asked[first : first + ASKED])
        ask_counts = counts_of(ask, half)
        ask_parity = parities_of(ask_counts)
        for leaf, rows in reach(nodes, ask_counts):
            held = order[nodes[leaf][1] : nodes[leaf][2]]
            for x, y in close_pairs(rows, ask_parity, held, own_parity):
                same = one_edit(own[y], ask[x])
                if same.any():
                    yield first + x[same], y[same]


def cut_into_cells(words: DataFrame, cell_words: int) -> dict[int, list[Node]]:
    """For each length with too many words for one cell, the upper part of its tree.

    Only these lengths are fetched, and a bounded sample of their words, which decides how evenly
    the cells are filled and nothing else.
    """
    sizes = words.groupBy("size").count().where(F.col("count") > cell_words).collect()
    if not sizes:
        return {}
    cells = {r["size"]: -(-r["count"] // cell_words) for r in sizes}
    each = min(SAMPLE_WORDS, max(2, MOST_SAMPLED // (2 * sum(cells.values()))))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("size") == r["size"], min(1.0, each * cells[r["size"]] / r["count"])).otherwise(share)
    drawn = words.select("word", "size", draw(SEED, "word").alias("drawn")).where(F.col("drawn") <= share * 2.0**62)
    sample = drawn.orderBy("drawn", "word").limit(MOST_SAMPLED).collect()
    trees = {}
    for size in sorted(cells):
        own = [r["word"] for r in sample if r["size"] == size]
        if own:
            trees[size] = grow(counts_of(letters_of(own), half_of(size)), max(1, len(own) // cells[size]))[0]
    return trees


def _sent(words: DataFrame, trees: dict[int, list[Node]]) -> DataFrame:
    """Rows (size, cell, word, n, asks): a word is sent to its own cell, and to all cells that it asks."""
    one_cell = [(-1, 0, 0, 0)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                letters = letters_of(own["word"].to_pylist())
                for other, most, asks in ((size, 0, False), (size, MOST_MOVED, True), (size + 1, MOST_MOVED, True)):
                    for cell, rows in reach(trees.get(other, one_cell), counts_of(letters, half_of(other)), most):
                        chosen = own.take(pa.array(rows))
                        keys = [pa.array(np.full(len(rows), k, np.int32)) for k in (other, cell)]
                        columns = [*keys, chosen["word"], chosen["n"], pa.array(np.full(len(rows), asks))]
                        yield pa.RecordBatch.from_arrays(columns, ["size", "cell", "word", "n", "asks"])

    return words.select("word", "n", "size").mapInArrow(spread, "size int, cell int, word string, n long, asks boolean")


def _met(key: tuple, group: pa.Table) -> pa.Table:
    """What the words of a cell, and those that ask it, know of one another."""
    size = key[0].as_py()
    # By falling n, so that the first one that is near is the best.
    group = group.sort_by([("n", "descending"), ("word", "ascending")])
    words = np.array(group["word"].to_pylist(), object)
    n, asks = group["n"].to_numpy(), group["asks"].to_numpy()
    lengths = np.array([len(w) for w in words])
    points = np.flatnonzero(~asks)
    found = []
    for length in (size - 1, size):
        asked = np.flatnonzero(asks & (lengths == length))
        # Words of one length ask each other; of two lengths only the shorter one asks.
        sides = [(asked, points), (points, asked)] if length < size else [(asked, points)]
        near = [np.zeros(len(own), np.int64) for own, _ in sides]
        best = [np.full(len(own), len(other), np.int64) for own, other in sides]
        for pair in near_pairs(words[asked].tolist(), words[points].tolist()):
            for side, (own, other) in enumerate([pair, pair[::-1]][: len(sides)]):
                np.add.at(near[side], own, 1)
                np.minimum.at(best[side], own, other)
        for (own, other), count, top in zip(sides, near, best):
            some = count > 0
            chosen = other[top[some]]
            found.append((words[own[some]], count[some], n[chosen], words[chosen]))
    columns = [np.concatenate(c) for c in zip(*found)]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the one of largest n.

    Words without such a word are left out. Pairs are counted where they are found; none is shuffled.
    """
    sent = _sent(words, cut_into_cells(words, cell_words))
    parts = sent.groupBy("size", "cell").applyInArrow(_met, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("_n"), F.col("best").alias("_word")))
    sums = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("_top"))
    return sums.select("word", "n_near", (-F.col("_top._n")).alias("best_n"), F.col("_top._word").alias("best"))


def follow(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the last word that is reached from `word` over (word, form), by pointer jumps.

    A form is at least FORM_TIMES as frequent as its word, so there are no circles, and the steps of
    a chain are few; a jump halves them.
    """
    steps = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = steps.join(beyond, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        jumped = stage(jumped, "spelling-roots")
        steps = jumped.select("word", "root")
        if jumped.where("_moved").isEmpty():
            return steps
    raise RuntimeError("the chains of forms do not end")


def group_spellings(docs: DataFrame, id: str = "doc_id", text: str = "text", cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words with LEAST_COUNT occurrences in the corpus.

    A NULL text has no words and a NULL id is written as nothing before the colon; rows that agree
    in id and text count as often as they stand there. Of near words with equal n the first in
    code-point order is the form. Very long runs are words like others. An empty table, or one
    without repeated words, gives an empty one; other columns are not read.
    """
    words = stage(word_counts(docs, id, text), "spelling-words")
    near = neighbours(words, cell_words)
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    judged = stage(judged, "spelling-forms")
    roots = follow(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
