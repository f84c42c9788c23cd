import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, rows
from tokenizers import Tokenizer

from itemlab.llm import packing
from itemlab.llm.queries import tokenizer_file

HARD = [
    (20, "<|endoftext|> x <|ENDOFTEXT|>, y<|startoftext|>.", "en", "a"),
    (21, "it's I'LL l'm don't... 'quoted' \"so\" (a)-b, 3.14! x_y_ …, é, É. ÉTÉ; İstanbul, ΣΑΣ. ß ﬁ,", "en", "a"),
    (22, "é, É. a b c \x1c\x85 ### $$$ word### WORD$$$ &&& ñ%%%", "en", "a"),
    (23, "漢字。かな, 한국어! 🙂🙂, \U0010ffff ퟿", "en", "a"),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def want_pieces(tokenizer, docs, size):
    out = []
    for i, text, *_ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            out.append((repr(i), piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


@pytest.mark.parametrize("size", [4096, 7])
def test_pieces_and_places(spark, tokenizer, size):
    docs = AWKWARD + HARD
    found = packing.pack_documents(documents(spark, docs), tokenizer_file(), sequence=size).collect()
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == want_pieces(tokenizer, docs, size)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= size


def test_empty_table(spark):
    assert rows(packing.pack_documents(documents(spark, AWKWARD).limit(0), tokenizer_file())) == []


def test_a_small_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.WordEncoder(tokenizer_file())
    texts = [t or "" for _, t, *_ in AWKWARD + HARD]
    for text in texts + texts[::-1]:
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_few_words_are_remembered():
    encoder, most = packing.WordEncoder(tokenizer_file()), 0
    letters = [chr(97 + i) for i in range(26)]
    for a in letters[:18]:
        encoder.encode([" ".join(a + b + c + d for b in letters for c in letters for d in letters)])
        most = max(most, len(encoder.known))
    assert most <= 250_000


def test_frequent_words_are_learned_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    encoder = packing.WordEncoder(tokenizer_file())
    learned, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(new), learn(new)))
    letters = [chr(97 + i) for i in range(26)]
    for i in range(40):
        often = ["often", "usual"][i % 2]
        encoder.encode([f"{often} {' '.join('rare' + letters[i % 26] + letters[i // 26] + b for b in letters[:20])}"])
        assert len(encoder.known) + len(encoder.older) <= 60
    names = [w if isinstance(w, str) else w.decode() for w in learned]
    assert (names.count("often"), names.count("usual")) == (1, 1)


def test_texts_encoded_together_keep_their_own_ids(tokenizer):
    texts = [t or "" for _, t, *_ in AWKWARD + HARD] + [".", "", " ", "...", "a.", "\x1c\x85\xa0", "#a. b##\n", "end", "\n.x", "x<|y. <|Z."]
    for order in (texts, texts[::-1], [""], ["."], []):
        found = packing.WordEncoder(tokenizer_file()).encode(order)
        want = [tokenizer.encode(text, add_special_tokens=False).ids for text in order]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == want


@pytest.mark.parametrize("size", [1, 9, 1 << 21])
def test_slices_hold_every_row_once(monkeypatch, size):
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", size)
    rows_in = [None, "", "abc", "d" * 30, None, "e", "é" * 8, ""]
    for values in (rows_in, [], [None]):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})
        assert [v for part in packing._slices(batch) for v in part["text"].to_pylist()] == values


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_once_and_tightly(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 4096])
    lengths = [min(size, max(1, int(rng.paretovariate(0.7) * size / 50))) for _ in range(rng.choice([1, 50, 5000]))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed, opened = packing.plan(counts, size)
    used = [0] * opened
    for length in counts:
        runs = sorted(p for p in placed if p[0] == length)
        assert [r[1] for r in runs][:1] == [0]
        for run, after in zip(runs, [*[r[1] for r in runs[1:]], counts[length]]):
            for nth in range(after - run[1]):
                used[run[3] + nth // run[2]] += length
    assert max(used) <= size and sum(used) == sum(lengths)
    bound = max(math.ceil(sum(lengths) / size), sum(x > size / 2 for x in lengths))
    assert opened <= bound + max(1, bound // 50)
