"""Quality of texts by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from good and one from bad labelled texts. A text is compressed
whole, in pieces of `PIECE` bytes, once with either; the difference of the two sizes over the
text's own size says whose language it speaks. A logistic curve, fitted on labelled texts that
the dictionaries have not seen, turns the difference into a probability. It also sees how small
the text became: what repeats itself shrinks under any dictionary and leaves little difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlab.llm.common import draw

#: Bounds of what is learned from: texts of each class for the dictionaries and for the curve, and
#: characters of each.
DICTIONARY_TEXTS = 400
CURVE_TEXTS = 400
SAMPLE_CHARS = 4000
#: Characters of a sampled text that a dictionary is built from.
DICTIONARY_CHARS = 2000
DICTIONARY_BYTES = 32_000
PIECE = 512
LEVEL = 3
SEED = 13
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3


class Model(NamedTuple):
    """Contents of the two dictionaries, and the curve over (difference, share left)."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    shift: float
    prior: float


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' pieces; with too few of them, their own bytes."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    of = zstandard.ZstdCompressionDict(content) if content else None
    if of:
        of.precompute_compress(level=LEVEL)
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=of, **plain)


def measures(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(texts, 2): the size with the bad dictionary minus that with the good one, and the smaller
    of the two, both over the text's size. An empty text has no difference and loses nothing."""
    two = [compressor(good), compressor(bad)]
    out = np.zeros((len(texts), 2))
    for row, text in zip(out, texts):
        parts = pieces(text)
        with_good, with_bad = (sum(len(c.compress(p)) for p in parts) for c in two)
        row[:] = (with_bad - with_good) / max(1, len(text)), min(1.0, min(with_good, with_bad) / len(text)) if text else 1.0
    return out


def fit_curve(values: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic curve, by Newton's method on standardised values."""
    mean, spread = values.mean(axis=0), values.std(axis=0) + 1e-9
    rows = np.c_[(values - mean) / spread, np.ones(len(values))]
    found = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        slope = rows.T @ (p - labels) / len(labels) + penalty * found
        bend = (rows.T * (p * (1 - p))) @ rows / len(labels) + penalty * np.eye(len(found))
        step = np.linalg.solve(bend, slope)
        found -= step
        if np.abs(step).max() < 1e-10:
            break
    weights = found[:-1] / spread
    return weights, float(found[-1] - weights @ mean)


def fit(good: list[bytes], bad: list[bytes], prior: float) -> Model:
    """Dictionaries from the first half of each class (at most DICTIONARY_TEXTS), the curve from the rest.

    `prior` is the share of good ones among all; the curve is moved from the sample's share to it.
    """
    cuts = [min(DICTIONARY_TEXTS, len(texts) // 2) for texts in (good, bad)]
    if not all(cuts):
        return Model(b"", b"", np.zeros(2), float(np.log(prior / (1 - prior))), prior)
    # Bytes, not characters, are cut here; a broken character at the end of a sample does no harm.
    contents = [dictionary([t[:DICTIONARY_CHARS] for t in texts[:cut]]) for texts, cut in zip((good, bad), cuts)]
    rest = [texts[cut : cut + CURVE_TEXTS] for texts, cut in zip((good, bad), cuts)]
    labels = np.repeat([1.0, 0.0], [len(r) for r in rest])
    weights, shift = fit_curve(measures(rest[0] + rest[1], *contents), labels)
    shift += float(np.log(prior / (1 - prior)) - np.log(len(rest[0]) / len(rest[1])))
    return Model(*contents, weights, shift, prior)


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    if not model.good:
        return np.full(len(texts), model.prior)
    odds = measures(texts, model.good, model.bad) @ model.weights + model.shift
    odds[[not t for t in texts]] = np.log(model.prior / (1 - model.prior))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of FOLDS; a NULL id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> Model:
    """A model from a bounded sample of labelled texts that are not held out.

    Labels other than 0 and 1 and labels without id count as none. The ids are drawn from the labels,
    in proportion to what is wanted of each class, and are few whatever the size of the tables,
    so they are broadcast. Of rows that share an id one text is used.
    """
    named = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    wanted = DICTIONARY_TEXTS + CURVE_TEXTS
    share = {k: min(1.0, (1.5 * wanted + 50) / n) for k, n in sizes.items()}
    limit = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * 2.0**62
    drawn = named.withColumn("drawn", draw(SEED, F.col("id").cast("string"))).where(F.col("drawn") <= limit)
    drawn = drawn.distinct().orderBy("drawn", "id", "label").limit(4 * wanted)
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    place = (F.pmod("drawn", room) + 1).cast("int")
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    parts = own.join(F.broadcast(drawn), "id").select(
        "id", "label", "drawn", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("part")
    )
    found = parts.groupBy("id", "label", "drawn").agg(F.min("part").alias("part")).orderBy("drawn", "id").collect()
    texts = {k: [r["part"].encode("utf-8", "replace") for r in found if r["label"] == k] for k in (0, 1)}
    return fit(texts[1], texts[0], prior)


def score_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`, from its whole text.

    `score` is the probability of label 1. NULL and empty texts, and all texts when one class has
    fewer than two labelled texts, get the share of label 1 among the labels that may be learned
    from (one half without any). Repeated rows are all returned and score alike; a text is a few
    pieces or many, so a very long one takes time but no more memory than itself. Labels of
    unknown documents are not used, an empty table gives an empty one, and columns other than the
    named ones are not read. Labels serve to learn only.
    """
    model = learn(docs, labels, id, text, label)
    rows = docs.select(F.col(f"`{id}`").alias("id"), held_out(F.col(f"`{id}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch["text"]]
            score = pa.array(probabilities(model, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], score], ["id", "held_out", "score"])

    shape = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())])
    told = rows.mapInArrow(scored, shape)
    return told.select(
        F.col("id").alias(id), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
