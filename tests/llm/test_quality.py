import random
import re
from collections import Counter

import numpy as np
from helpers import AWKWARD, WORD, documents, rows

from itemlab.llm import quality


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside), failed


def test_awkward_documents(spark):
    docs = documents(spark, [*AWKWARD, (8, "a a a a a\n\n \na a\na a", None, None)])
    found = quality.judge_quality(docs).collect()
    got = sorted(repr((r.doc_id, *r[1:7])) for r in found)
    assert got == sorted(repr((i, *brute(t))) for i, t, *_ in [*AWKWARD, (8, "a a a a a\n\n \na a\na a", None, None)])
    assert all(not r.kept for r in found if r.base_failed)
    assert rows(quality.judge_quality(docs.limit(0))) == []


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert quality.repeated_words([w.encode() for w in words]) == brute(" ".join(words))[4]


def prose(rng):
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwyz", k=rng.randint(2, 8))) for _ in range(rng.randint(80, 200))]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(2)
    junk = [
        lambda t: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split()),
        lambda t: " | ".join(t.split()),
        lambda t: " ".join(w.upper() + "!!" for w in t.split()),
    ]
    texts = [(i, prose(rng) if i % 6 else junk[i // 6 % 3](prose(rng)), "en", "a") for i in range(600)]
    docs = documents(spark, texts)
    found = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert found == {i: bool(i % 6) for i in range(600)}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in found if i % 6}


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    n, good = 60_000, 0.85
    truth = rng.random(n) < good
    accuracy = np.array([0.95, 0.9, 0.85, 0.8])
    right = rng.random((n, 4)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((n, 4)) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, found = quality.estimate(patterns, counts.astype(float), rounds=2000)
    assert abs(share - good) < 0.02
    assert np.abs(found[:, 1, 1] - 0.8 * accuracy).max() < 0.03
    assert np.abs(found[:, 0, 0] - 0.8 * accuracy).max() < 0.05
