"""Packing documents into sequences of a fixed number of tokens, by best fit in rounds.

Documents longer than a sequence are cut; every piece then needs a place in one sequence. Packing
is bulk-synchronous: a round sorts the lengths that wait and the gaps that are open, finds for
every length its successor (the smallest gap that holds it), settles conflicts over a gap by rank
(longest first, equal lengths by a drawn order), places the winners all at once, updates the gaps
and repeats. Lengths enter from long to short, an octave at a time; what is left of an octave when
no gap holds it opens new sequences, as many as its tokens fill.

Pieces of one length are alike, and so are gaps of one size. A round therefore works on runs: a
length with its count and a gap size with its interval of sequence numbers. There are at most as
many lengths as a sequence has tokens, whatever the size of the corpus, so rounds cost nothing;
the pieces themselves are counted, ranked and placed by distributed steps, and read only twice.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import bins_for, draw, draw_bin, running_totals
from itemlab.plans.staging import stage

SEQUENCE = 4096
END_ID = 1
SEED = 3
#: Words that both generations hold.
CACHED_WORDS = 250_000
BYTES_AT_ONCE = 1 << 19
#: ASCII punctuation but for the apostrophe, letters and digits, and white space, by byte.
_BYTES = [chr(b) if b < 128 else "" for b in range(256)]
PUNCTUATION = np.array([c in string.punctuation.replace("'", "") and c > "" for c in _BYTES])
ALPHANUMERIC = np.array([c.isalnum() for c in _BYTES])
WHITE = np.array([c in " \t\n\v\f\r" and c > "" for c in _BYTES])
#: Texts with this may hold a special token and are taken as they are.
SPECIAL = b"<|"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, and never joins what ASCII white space separates, nor a letter or
    digit and the ASCII punctuation that ends the word. So both are encoded once and remembered, in
    two generations: when the newer one is full it becomes the older, and words met again move over,
    so that frequent words stay. Arrow splits many texts at once into words, numbers the distinct
    ones and puts their ids together again.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn_letters(self, words: list[str]) -> bool:
        """Words of letters alone are one tokenizer word each, so their ids can be told apart by
        the tokens that end a word; False if the number of those is another."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words):
            return False
        data, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = data[start:end]
            start = end
        return True

    def _learn_any(self, words: list[str]) -> None:
        encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        owner = np.array(encoded.word_ids, np.int64)
        ends = (np.searchsorted(owner, np.arange(len(words)), side="right") * 4).tolist()
        data, start = np.array(encoded.ids, "<u4").tobytes(), 0
        for word, end in zip(words, ends):
            self.known[word] = data[start:end]
            start = end

    def learn(self, new: list[str]) -> None:
        simple, other = [], []
        for word in new:
            letters = word.isalpha() and (word.isascii() or (word.lower() == word and is_normalized("NFC", word)))
            (simple if letters else other).append(word)
        if simple and not self._learn_letters(simple):
            other += simple
        if other:
            self._learn_any(other)

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        ids = list(map(self.known.get, words))
        new = [w for w, known in zip(words, ids) if known is None]
        if not new:
            return ids
        again = list(map(self.older.get, new))
        if len(self.known) + len(new) > CACHED_WORDS // 2:
            self.older, self.known = self.known, {w: known for w, known in zip(words, ids) if known is not None}
        self.known.update((w, known) for w, known in zip(new, again) if known is not None)
        unknown = [w for w, known in zip(new, again) if known is None]
        if unknown:
            self.learn(unknown)
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        raws = [text.encode("utf-8", "replace") for text in texts]
        plain = np.array([SPECIAL not in raw for raw in raws], bool)
        joined = b"\n".join([*(raw.lower() if low else raw for raw, low in zip(raws, plain.tolist())), b""])
        ends = np.cumsum([len(raw) + 1 for raw in raws])
        data = np.frombuffer(joined, np.uint8)
        # white space goes before the punctuation that ends a word
        marks = PUNCTUATION[data]
        bounds = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        if len(marks) and marks[0]:
            bounds = bounds[1:]
        first, after = bounds[::2], bounds[1::2]
        parted = first[ALPHANUMERIC[data[first - 1]] & WHITE[data[after]]]
        parted = parted[plain[np.searchsorted(ends, parted, side="right")]]
        data = np.insert(data, parted, 32)
        ends += np.searchsorted(parted, ends)
        starts = np.concatenate([[0], ends]).astype(np.int64)
        lines = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(lines)
        words = split.values.dictionary_encode()
        # the split leaves an empty word before or after white space at the ends
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = iter(self.look_up([w for w in found if w]))
        ids = pa.array([next(known) if w else b"" for w in found], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.asarray(split.offsets)].tolist()
        whole = memoryview(ids.buffers()[2] or b"")
        return [bytes(whole[start:end]) for start, end in zip(at, at[1:])]


def _encoder(tokenizer_file: str) -> WordEncoder:
    """One for each file and worker process."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in slices of about BYTES_AT_ONCE of text; no text is cut."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    filled = np.cumsum(sizes, dtype=np.int64) // BYTES_AT_ONCE
    bounds = [0, *(np.flatnonzero(filled[1:] != filled[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def cut_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for the pieces of every document.

    A document is its token ids and `end_id`; a NULL or empty text is `end_id` alone. The
    tokenizer file must lie at the same path on every machine.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for whole in batches:
            for batch in _slices(whole):
                owners, pieces, lengths, sums = [], [], [], []
                for i, body in enumerate(encoder.encode([t or "" for t in batch["text"].to_pylist()])):
                    ids = body + end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        owners.append(i)
                        pieces.append(piece)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(pa.array(owners, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array([piece * sequence for piece in pieces], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """The rounds on runs. A placement puts pieces `rank` .. `rank + n - 1` of a length, `per` to
    a sequence, into sequences from `first` on, each from `offset` on."""

    def __init__(self, counts: dict[int, int], sequence: int) -> None:
        self.sequence = sequence
        self.left = {length: n for length, n in counts.items() if n}
        self.rank = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.opened = 0
        self.placed: list[tuple[int, int, int, int, int]] = []

    def place(self, length: int, n: int, per: int, first: int, gap: int) -> None:
        self.placed.append((length, self.rank[length], per, first, self.sequence - gap))
        self.rank[length] += n
        self.left[length] -= n

    def round(self, lengths: list[int]) -> bool:
        """One synchronous round for these lengths, longest first; whether any was placed."""
        sizes = sorted(self.gaps)
        asked: dict[int, list[int]] = defaultdict(list)
        for length in lengths:
            successor = bisect_left(sizes, length)
            if self.left[length] and successor < len(sizes):
                asked[sizes[successor]].append(length)
        changed: list[tuple[int, tuple[int, int]]] = []
        for size, rivals in asked.items():
            runs = self.gaps.pop(size)
            for length in rivals:
                per = size // length
                while self.left[length] and runs:
                    first, free = runs.pop()
                    full = min(free, self.left[length] // per)
                    if full:
                        self.place(length, full * per, per, first, size)
                        changed.append((size - per * length, (first, full)))
                    if self.left[length] and full < free:
                        rest = self.left[length]
                        self.place(length, rest, per, first + full, size)
                        changed.append((size - rest * length, (first + full, 1)))
                        full += 1
                    if full < free:
                        runs.append((first + full, free - full))
            if runs:
                self.gaps[size] = runs
        for size, run in changed:
            if size:
                self.gaps.setdefault(size, []).append(run)
        return bool(asked)

    def open(self, lengths: list[int]) -> None:
        """New sequences for the longest pieces that no gap holds, as many as the rest fills."""
        tokens = sum(length * self.left[length] for length in lengths)
        wanted = -(-tokens // self.sequence)
        for length in lengths:
            n = min(wanted, self.left[length])
            if n:
                self.place(length, n, 1, self.opened, self.sequence)
                if length < self.sequence:
                    gap = self.sequence - length
                    self.gaps.setdefault(gap, []).append((self.opened, n))
                self.opened += n
                wanted -= n

    def run(self) -> None:
        top = self.sequence
        while top:
            lengths = sorted((x for x in self.left if top // 2 < x <= top), reverse=True)
            while any(self.left[x] for x in lengths):
                if not self.round(lengths):
                    self.open(lengths)
            top //= 2


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, rank, per, first, offset) for pieces counted by length, and the number
    of sequences."""
    packing = _Plan(counts, sequence)
    packing.run()
    return packing.placed, packing.opened


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, start, length, ids_crc32)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = plan(counts, sequence)
    table = np.array(sorted(placed), np.int64).reshape(-1, 5)
    ranked = running_totals(
        pieces.withColumn("_draw", draw(SEED, "id", "piece", "ids_crc32")),
        ["length"],
        ["_draw", "id", "piece", "ids_crc32"],
        {"_rank": F.lit(1)},
        draw_bin(F.col("_draw"), bins_for(sum(counts.values()))),
    ).drop("_draw")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.searchsorted(table[:, 0], np.arange(sequence + 2))
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                low, high = lowest[x], lowest[x + 1]
                mine = length == x
                row[mine] = low + np.searchsorted(table[low:high, 1], rank[mine], side="right") - 1
            _, since, per, first, offset = table[row].T
            nth = rank - since
            placed = [pa.array(first + nth // per), pa.array(offset + nth % per * length)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], *placed], names)

    columns = pieces.columns
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    names = out.names
    return ranked.mapInArrow(look_up, out)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed as often as they occur; other columns are not read.
    """
    pieces = stage(cut_pieces(docs, tokenizer_file, id, text, sequence, end_id), "pieces")
    return pack(pieces, sequence).withColumnRenamed("id", id)
