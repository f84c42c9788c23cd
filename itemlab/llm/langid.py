"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads a stretch of bytes from both ends and labels every position with a probability
for each language; a document's probabilities are the means over all its positions. It is trained
in numpy by backpropagation through time on a bounded sample of labelled documents. Texts are read
whole, as consecutive stretches of `STRETCH` bytes that run side by side through the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import draw

HIDDEN = 12
STRETCH = 64
SIDE_BY_SIDE = 1024
#: Bounds of what is learned from: documents of each language, and characters of each.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 384
STEPS = 250
BATCH = 128
RATE = 0.02
SEED = 10
HELD_OUT = 2
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Two gated recurrent layers, forward and backward in time, and a softmax over languages.

    `inputs` (2, 256, 3H) holds what each byte adds to the update gate, the reset gate and the new
    state; `states` (2, H, 3H) what the state adds; `shift` (2, 3H) their constants.
    """

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.inputs = rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.states = rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32)
        self.shift = np.zeros((2, 3 * hidden), np.float32)
        self.out = rng.normal(0, 0.3, (2 * hidden, languages)).astype(np.float32)
        self.bias = np.zeros(languages, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.shift, self.out, self.bias]

    def _order(self, steps: int, direction: int) -> range:
        return range(steps) if direction == 0 else range(steps - 1, -1, -1)

    def positions(self, data: np.ndarray) -> np.ndarray:
        """(steps, side by side) bytes to (steps, side by side, languages) probabilities."""
        steps, wide = data.shape
        h2 = 2 * self.hidden
        both = np.empty((steps, h2, wide), np.float32)
        for d in (0, 1):
            # Half the gates' input, as a logistic function is a hyperbolic tangent of it.
            scale = np.concatenate([np.full(h2, 0.5, np.float32), np.ones(self.hidden, np.float32)])[:, None]
            table = np.ascontiguousarray((self.inputs[d] + self.shift[d]).T * scale)
            mix = np.ascontiguousarray(self.states[d].T * scale)
            state = np.zeros((self.hidden, wide), np.float32)
            for t in self._order(steps, d):
                given = np.take(table, data[t], axis=1)
                own = mix @ state
                gates = own[:h2]
                gates += given[:h2]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new = own[h2:]
                new *= gates[self.hidden :]
                new += given[h2:]
                np.tanh(new, out=new)
                state = new + gates[: self.hidden] * (state - new)
                both[t, d * self.hidden : (d + 1) * self.hidden] = state
        logits = np.matmul(self.out.T, both) + self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(0, 2, 1)

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        steps, wide = data.shape
        h, h2 = self.hidden, 2 * self.hidden
        both = np.empty((steps, wide, h2), np.float32)
        kept: list[dict[int, tuple]] = [{}, {}]
        for d in (0, 1):
            state = np.zeros((wide, h), np.float32)
            for t in self._order(steps, d):
                given = self.inputs[d][data[t]] + self.shift[d]
                own = state @ self.states[d]
                gates = 1 / (1 + np.exp(-(given[:, :h2] + own[:, :h2])))
                new = np.tanh(given[:, h2:] + gates[:, h:] * own[:, h2:])
                kept[d][t] = state, own[:, h2:], gates, new
                state = new + gates[:, :h] * (state - new)
                both[t, :, d * h : (d + 1) * h] = state
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=2, keepdims=True)
        right = labels[None, :, None]
        loss = -float(np.log(np.take_along_axis(share, right, 2) + 1e-9).mean())
        np.put_along_axis(share, right, np.take_along_axis(share, right, 2) - 1, 2)
        share /= steps * wide
        back = share @ self.out.T
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[3] += np.tensordot(both, share, ((0, 1), (0, 1)))
        grads[4] += share.sum(axis=(0, 1))
        for d in (0, 1):
            later = np.zeros((wide, h), np.float32)
            through = np.empty((steps, wide, 3 * h), np.float32)
            for t in reversed(self._order(steps, d)):
                state, own_new, gates, new = kept[d][t]
                update, reset = gates[:, :h], gates[:, h:]
                total = back[t, :, d * h : (d + 1) * h] + later
                d_new = total * (1 - update) * (1 - new**2)
                d_update = total * (state - new) * update * (1 - update)
                d_reset = d_new * own_new * reset * (1 - reset)
                through[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
                d_own = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
                grads[1][d] += state.T @ d_own
                later = total * update + d_own @ self.states[d].T
            np.add.at(grads[0][d], data.ravel(), through.reshape(-1, 3 * h))
            grads[2][d] += through.sum(axis=(0, 1))
        return loss, grads


def train(stretches: np.ndarray, labels: np.ndarray, languages: int, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam steps on batches that hold every language equally often. stretches: (n, STRETCH) bytes."""
    network = Network(languages, seed=seed)
    rng = np.random.default_rng(seed)
    by_language = [np.flatnonzero(labels == x) for x in range(languages)]
    mean = [np.zeros_like(p) for p in network.parameters()]
    square = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(own, -(-BATCH // languages)) for own in by_language])
        _, grads = network.gradients(np.ascontiguousarray(stretches[chosen].T), labels[chosen])
        rate = RATE * min(1.0, 2 * (steps - step + 1) / steps)
        for p, g, m, s in zip(network.parameters(), grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return network


def cut_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretches, owner, filled): rows of STRETCH bytes, whose text each is, how many are its."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // STRETCH)
    padded = b"".join(t + bytes(int(r) * STRETCH - len(t)) for t, r in zip(texts, rows))
    owner = np.repeat(np.arange(len(texts)), rows)
    first = np.cumsum(rows) - rows
    filled = np.minimum(STRETCH, sizes[owner] - (np.arange(len(owner)) - first[owner]) * STRETCH)
    return np.frombuffer(padded, np.uint8).reshape(-1, STRETCH), owner, filled


def document_probabilities(network: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean over all positions; 0 for an empty text."""
    stretches, owner, filled = cut_bytes(texts)
    out = np.zeros((len(texts), len(network.bias)))
    time = np.arange(STRETCH)[:, None]
    for i in range(0, len(owner), SIDE_BY_SIDE):
        part = slice(i, i + SIDE_BY_SIDE)
        each = network.positions(np.ascontiguousarray(stretches[part].T))
        sums = np.einsum("tbl,tb->bl", each, (time < filled[part]).astype(np.float32))
        np.add.at(out, owner[part], sums)
    return out / np.maximum(1, [len(t) for t in texts])[:, None]


def held_out(id: str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a NULL id is not held out."""
    rest = F.crc32(F.col(id).cast("string").cast("binary")) % 4
    return F.coalesce(rest == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, id: str, text: str, lang: str, steps: int = STEPS) -> tuple[list[str], Network | None]:
    """The languages and a network trained on at most SAMPLE_DOCS documents of each.

    Documents that are held out, or without id, text or language, are not learned from. Each
    sampled document gives one stretch of SAMPLE_CHARS characters from a drawn place.
    """
    usable = docs.where(F.col(id).isNotNull() & ~held_out(id) & F.col(lang).isNotNull() & (F.length(text) > 0))
    sizes = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], None
    drawn = draw(SEED, F.col(id), F.col(text))
    # A little more than is kept of each, so that the sort sees few rows.
    limit = F.lit(0.0)
    for name, n in sizes.items():
        share = min(1.0, 2 * SAMPLE_DOCS / n + 20 / n)
        limit = F.when(F.col(lang) == name, F.lit(share * 2.0**62)).otherwise(limit)
    room = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    place = (F.pmod(drawn, room) + 1).cast("int")
    sample = (
        usable.withColumn("_draw", drawn)
        .where(F.col("_draw") <= limit)
        .select(F.col(lang).alias("lang"), F.substring(F.col(text), place, F.lit(SAMPLE_CHARS)).alias("part"), "_draw")
        .orderBy("_draw", "part")
        .limit(3 * SAMPLE_DOCS * len(languages))
        .collect()
    )
    parts: list[bytes] = []
    owners: list[int] = []
    for number, name in enumerate(languages):
        own = [r["part"].encode() for r in sample if r["lang"] == name][:SAMPLE_DOCS]
        parts += own
        owners += [number] * len(own)
    present = sorted(set(owners))
    stretches, owner, filled = cut_bytes(parts)
    labels = np.searchsorted(present, np.array(owners)[owner])
    full = filled == STRETCH
    # Short leftovers only where a language has nothing longer.
    use = full | np.array([not (full & (labels == x)).any() for x in range(len(present))])[labels]
    network = train(stretches[use], labels[use], len(present), steps)
    return [languages[x] for x in present], network


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", steps: int = STEPS) -> DataFrame:
    """(id, held_out, lang_pred, score) for every document.

    `und` with score 0 for a NULL text, a text without letters, or when there was nothing to learn
    from. Repeated rows are all returned; only id, text and lang are read, lang only to learn.
    """
    languages, network = learn(docs, id, text, lang, steps)
    rows = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [bool(languages) and t is not None and LETTER.search(t) is not None for t in batch["text"]]
            texts = [t.encode("utf-8", "replace") for t, ok in zip(batch["text"], told) if ok]
            names = np.full(len(batch), UNDETERMINED, object)
            scores = np.zeros(len(batch))
            if texts:
                shares = document_probabilities(network, texts)
                best = shares.argmax(axis=1)
                names[told] = np.array(languages, object)[best]
                scores[told] = np.clip(shares[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    shape = f"id {kind}, held_out boolean, lang_pred string, score double"
    return rows.mapInPandas(predict, shape).withColumnRenamed("id", id)
