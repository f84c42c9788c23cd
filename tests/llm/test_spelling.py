"""Spelling variants against a plain search over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents
from itemlab.llm import spelling
from itemlab.llm.common import table
from itemlab.llm.queries import registry
from pyspark.sql import functions as F

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    found = Counter()
    for id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word, alphabet):
    """All strings that are one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def plain(rows):
    """(word, n, n_near, form, form_n, root) rows, by all edits of every word."""
    counts = plain_counts(rows)
    alphabet = sorted({c for w in counts for c in w})
    forms, out = {}, []
    for word, n in counts.items():
        near = sorted((-counts[x], x) for x in edits(word, alphabet) if x in counts)
        forms[word] = near[0][1] if near and -near[0][0] >= 10 * n else None
        out.append([word, n, len(near), forms[word], counts.get(forms[word])])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, out), key=str)


def got(docs, **more):
    found = spelling.group_spellings(docs, **more).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, letters="abcÀÿ", words=60, rows=80):
    """Texts over few words and their edits, so that chains, ties and crowds arise."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(words)]
    once = [rng.choice(sorted(edits(w, letters))) for w in base]
    twice = [rng.choice(sorted(edits(w, letters))) for w in once]
    weights = [rng.choice([40, 40, 3]) * rng.choice([1, 30, 30]) for _ in base]
    pool = base + once + twice
    weights += [max(1, w // 20) for w in weights] + [max(1, w // 400) for w in weights]
    return [(i, " ".join(rng.choices(pool, weights, k=300)), "en", "a") for i in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 20])
def test_equals_all_edits(spark, seed, cell_words):
    rows = corpus(seed)
    want = plain(rows)
    assert any(r[3] for r in want) and any(r[3] and r[5] != r[3] for r in want)
    assert got(documents(spark, rows), cell_words=cell_words) == want


def test_few_letters_make_crowds_of_equal_counts(spark):
    rows = corpus(3, "ab", 200)
    assert got(documents(spark, rows), cell_words=30) == plain(rows)


def test_awkward_rows(spark):
    long_run = "abcdefghij" * 40
    rows = AWKWARD + [(8, f"{long_run} {long_run}x", "en", "a"), (9, f"{long_run} {long_run}x", "en", "a"), (None, "Wortform wortform", "", "")]
    assert got(documents(spark, rows)) == plain(rows)


def test_empty_table(spark):
    assert got(documents(spark, [])) == []
    assert got(documents(spark, [(1, "seldomword another", "en", "a")])) == []


def test_whole_table_against_all_edits(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    found = registry.functions["op12_spelling_variants"](spark, sf)
    assert sorted((tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str) == plain(rows)


def test_one_edit_against_plain():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choices("abÿ", k=8))
        near = rng.choice(sorted(edits(a, "abÿ")))
        other = near if rng.random() < 0.5 else "".join(rng.choices("abÿ", k=rng.choice([7, 8, 9])))
        long, short = sorted((a, other), key=len, reverse=True)
        told = spelling.one_edit(spelling.letters_of([long]), spelling.letters_of([short]))[0]
        assert told == (other in edits(a, "abÿ"))


def test_an_edit_moves_one_half_by_at_most_two():
    """What the boxes are left out by."""
    rng = random.Random(6)
    for _ in range(500):
        a = "".join(rng.choices("abcdé", k=rng.randint(8, 13)))
        for size in {len(a), len(b := rng.choice(sorted(edits(a, "abcdé"))))}:
            half = spelling.half_of(size)
            x, y = (spelling.counts_of(spelling.letters_of([w]), half)[0].astype(int) for w in (a, b))
            first, last = (np.abs(x - y)[part].sum() for part in (slice(0, 32), slice(32, 64)))
            assert max(first, last) <= 2 and min(first, last) == 0


def test_follow_takes_chains_to_their_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(30)], "word string, form string")
    assert {r.root for r in spelling.follow(forms).collect()} == {"w30"}


def test_names_with_dots(spark):
    docs = documents(spark, corpus(4)).withColumnsRenamed({"doc_id": "a.id", "text": "a.text"}).withColumn("x.y", F.lit(1))
    assert got(docs, id="a.id", text="a.text") == plain(corpus(4))
