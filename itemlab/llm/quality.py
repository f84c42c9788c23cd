"""Quality of documents by weak supervision.

Each rule looks at one property of a text and votes: good, bad, or it abstains. No rule rejects a
text by itself. Expectation-maximisation over all documents estimates how often each rule gives
each vote on good and on bad documents, without labels, and with that the probability that a
document is good given all its votes. Documents below a probability of one half are rejected, and
so are those that fail the two base conditions (too few words, too much of them repeated).

The votes of a document are one pattern of a small alphabet, so the estimation needs only the
number of documents of each pattern: at most 3 ^ rules rows, whatever the size of the corpus. The
posterior is then a sum of one learned weight per vote, taken in the table itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import own_names
from itemlab.plans.staging import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
GOOD, BAD, ABSTAIN = 1, 0, 2
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_lower",
    "n_digits",
    "n_shouts",
    "n_other",
    "n_marked",
)
UPPER, LOWER, DIGITS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
)
NOT_ASCII = bytes(range(128, 256))
SYMBOL_BYTES = frozenset(SYMBOLS.encode())


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # Two ids fit one code, and so do a code of pairs and an id.
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : n - WINDOW + 1 + k] |= twice
    return int(inside.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS` for one text; all 0 for NULL."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    size = len(raw)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        lines.total(),
        lines.total() - len(lines),
        repeated_words(words),
        size - len(raw.translate(None, UPPER)),
        size - len(raw.translate(None, LOWER)),
        size - len(raw.translate(None, DIGITS)),
        text.count("!!"),
        len(text) - len(raw.translate(None, NOT_ASCII)),
        sum(w[-1] in SYMBOL_BYTES for w in words),
    )


def text_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, as `keep_<name>`, and COUNTS for every document."""
    kept = [f"keep_{c}" for c in keep]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([count_text(t.as_py()) for t in batch["_text"]], np.int64)
            found = found.reshape(-1, len(COUNTS))
            columns = [*[batch[k] for k in kept], *[pa.array(found[:, i]) for i in range(len(COUNTS))]]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *COUNTS])

    shape = rows.select(*kept).schema
    for c in COUNTS:
        shape = shape.add(c, "long")
    return rows.mapInArrow(count, shape)


def _vote(good: Column, bad: Column) -> Column:
    """Neither, or no value to judge by: the rule abstains."""
    return F.when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN)


def rule_votes() -> dict[str, Column]:
    """The rules, as votes over `COUNTS`."""
    per_word = F.try_divide("word_chars", "n_words")
    symbols = F.try_divide("n_symbols", "word_chars")
    letters = F.col("n_upper") + F.col("n_lower")
    upper = F.try_divide(F.col("n_upper"), letters)
    copied = F.try_divide("n_dup_lines", "n_lines")
    repeated = F.try_divide("n_repeat_words", "n_words")
    shouts = F.try_divide("n_shouts", "n_words")
    digits = F.try_divide("n_digits", "word_chars")
    spoken = F.try_divide(letters + F.col("n_other") + F.col("n_digits"), F.col("word_chars"))
    marked = F.try_divide("n_marked", "n_words")
    return {
        "word_length": _vote(per_word.between(3, 9), (per_word < 2) | (per_word > 12)),
        "symbols": _vote(symbols < 0.02, symbols > 0.05),
        "capitals": _vote(upper < 0.2, upper > 0.4),
        "copied_lines": _vote(copied < 0.1, copied > 0.3),
        "repetition": _vote(repeated < 0.1, repeated > 0.25),
        "shouting": _vote(shouts < 0.02, shouts > 0.1),
        "letters": _vote(spoken > 0.9, spoken < 0.85),
        "marked_words": _vote(marked < 0.02, marked > 0.05),
        "digits": _vote(digits < 0.1, digits > 0.3),
    }


def estimate(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8
) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    `patterns` is (patterns, rules) of votes, `counts` their numbers. Returns the share of good
    documents and the votes' probabilities, (rules, class, vote) with class 0 bad and 1 good.
    It starts from most documents being good, and from rules that rarely blame a good document
    while a bad one breaks some and passes the others. A small count is added to every vote, so
    nothing becomes impossible.
    """
    rules = patterns.shape[1]
    votes = np.empty((rules, 2, 3))
    votes[:, 0] = [0.3, 0.6, 0.1]
    votes[:, 1] = [0.02, 0.88, 0.1]
    good = prior
    each = np.arange(rules)
    for _ in range(rounds):
        by_class = np.log(votes)[each, :, patterns].sum(axis=1) + np.log([1 - good, good])
        odds = by_class[:, 1] - by_class[:, 0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        before = votes.copy()
        good = float((weights[1].sum() + 1) / (counts.sum() + 2))
        for vote in range(3):
            votes[:, :, vote] = (weights @ (patterns == vote)).T + 0.5
        votes /= votes.sum(axis=2, keepdims=True)
        if np.abs(votes - before).max() < 1e-9:
            break
    return good, votes


def _voted(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"vote_{name}": vote for name, vote in rule_votes().items()})


def learn(counted: DataFrame) -> tuple[float, np.ndarray]:
    """The share of good documents and the log odds of each vote, (rules, vote)."""
    names = [f"vote_{name}" for name in rule_votes()]
    found = _voted(counted).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([[r[c] for c in names] for r in found], np.int64).reshape(-1, len(names))
    good, votes = estimate(patterns, np.array([r["n"] for r in found], np.float64))
    return good, np.log(votes[:, 1] / votes[:, 0])


def apply(counted: DataFrame, good: float, weights: np.ndarray) -> DataFrame:
    """Add base_failed, kept and quality, the posterior probability of being good."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    odds = F.lit(float(np.log(good / (1 - good))))
    for name, weight in zip(rule_votes(), weights):
        odds = odds + F.element_at(F.array(*[F.lit(float(w)) for w in weight]), F.col(f"vote_{name}") + 1)
    return _voted(counted).withColumns(
        {"base_failed": failed, "kept": ~failed & (odds >= 0), "quality": 1 / (1 + F.exp(-odds))}
    )


def judge_quality(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    `quality`, the probability that the document is good.

    A NULL or empty text has no words and fails the base. An empty table gives an empty table.
    Repeated rows are judged alike and all returned; other columns are not read.
    """
    counted = stage(text_counts(docs, text, [id]), "text-counts")
    return apply(counted, *learn(counted)).select(
        F.col(f"keep_{id}").alias(id),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        *["base_failed", "kept", "quality"],
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are counted twice, to learn and to judge, rather than written down in between. Other
    columns may have any names.
    """
    named = own_names(docs.columns)
    own = docs.toDF(*named)
    learned = learn(text_counts(own, f"own_{text}", []))
    judged = apply(text_counts(own, f"own_{text}", named), *learned).where("kept")
    return judged.select(*[F.col(f"keep_{n}").alias(c) for n, c in zip(named, docs.columns)])
