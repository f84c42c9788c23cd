"""Mixing sources to target weights with exact quotas.

Every source gets a target number of words: its share by weight, but at most `most` times its own
size; what that cuts off is shared again by weight among the others. A source's words are cut into
blocks, and its blocks are taken in whole passes and one part pass, each in an order of its own
that is drawn by hash; the part pass ends at the block that comes nearest to the target.

The blocks taken from a source are its exact quota. A tree splits the quotas among the output
shards: a node's left half receives a multivariate hypergeometric draw from the node's blocks,
its right half the rest, down to single shards. So every shard has the same number of blocks
(give or take one), and its mix is that of a random sample without replacement. A shard then
draws its quota of each source as the next blocks of the source's order, which no other shard
draws, and is shuffled by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import WORD, bins_for, draw, draw_bin, own_names, running_totals, small_table, word_count
from itemlab.plans.staging import stage

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 128
SHARDS = 16
SEED = 4


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """The target of each source: `weights` share the sum of all sizes, none above `most` times
    its size. In the order in which sources reach their bound, the free ones share the rest."""
    out = [0.0] * len(sizes)
    rest, shares = float(sum(sizes)), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(most * sizes[i], rest * weights[i] / shares)
        rest -= out[i]
        shares -= weights[i]
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw, at every size by the inverse of the distribution function.

    The chances follow from the mode by the ratios of neighbours; what lies more than 40 standard
    deviations and 60 off has none in double precision.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (good + 1) * (n + 1) // (total + 2)))
    spread = (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    reach = int(40 * spread) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) blocks: exact quotas split by the tree; rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, own: list[int]) -> None:
        if high - low == 1:
            out[low] = own
            return
        half = (low + high) // 2
        total = sum(own)
        # The first shards of a node have one block more if blocks and shards don't go evenly.
        small, more = divmod(total, high - low)
        wanted = small * (half - low) + min(more, half - low)
        rng = np.random.default_rng([seed, low, high])
        left = []
        for blocks in own:
            total -= blocks
            left.append(_drawn(rng, blocks, total, wanted))
            wanted -= left[-1]
        split(low, half, left)
        split(half, high, [a - b for a, b in zip(own, left)])

    split(0, shards, list(quotas))
    return out


def sized_rows(docs: DataFrame, id: str, text: str, source: str, keep: list[str]) -> DataFrame:
    """`keep` with _row, _source, _size and _tie; written down, as row numbers must not change."""
    sized = docs.withColumns({"_row": F.monotonically_increasing_id(), "_size": word_count(F.col(text))})
    sized = sized.withColumns({"_source": F.col(source), "_tie": F.xxhash64(id, source, "_size")})
    return stage(sized.select(*keep, "_row", "_source", "_size", "_tie"), "mix-rows")


def source_table(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[tuple]:
    """(source, size, target) by code point, NULL last: one row for each source."""
    sizes = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    own = [sizes[s] for s in names]
    repeated = [weights[i % len(weights)] for i in range(len(names))]
    return list(zip(names, own, targets(own, repeated, most)))


def mix_blocks(
    rows: DataFrame, sources: list[tuple], block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """The blocks that the mix takes: (_row, pass, block, words, shard, place).

    `rows` has _row, _source, _size and `_tie`, which names a row in a rerun. `place` orders a
    shard. A document of n words has ceil(n / block_words) blocks, the last one shorter.
    """
    spark = rows.sparkSession
    passes = [
        (name, p, float(target) - p * size)
        for name, size, target in sources
        for p in range(int(-(-target // size)) if size else 0)
        if target - p * size > 0
    ]
    if not passes:
        return rows.select(
            "_row",
            *[F.lit(0).cast("long").alias(c) for c in ("pass", "block", "words", "shard", "place")],
        ).where("false")
    wanted = small_table(spark, passes, "_wanted string, pass long, rest double")
    number = F.ceil(F.col("_size") / F.lit(block_words))
    blocks = (
        rows.where("_size > 0")
        .select("_row", "_source", "_size", "_tie", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("block"))
        .withColumn("words", F.least(F.lit(block_words), F.col("_size") - F.col("block") * block_words).cast("long"))
        .join(wanted, F.col("_source").eqNullSafe(F.col("_wanted")))
        .drop("_wanted", "_size")
        .withColumn("_draw", draw(seed, "pass", "_tie", "block", "words"))
    )
    count = rows.agg(F.sum(number)).first()[0] or 0
    order = ["_draw", "_tie", "block"]
    ranked = running_totals(
        blocks, ["_source", "pass"], order, {"before": F.col("words"), "nth": F.lit(1)}, draw_bin(F.col("_draw"), bins_for(count))
    )
    # The last block is the one that ends nearest to what is wanted.
    taken = stage(ranked.where(F.col("before") + F.col("words") / 2 <= F.col("rest")), "mix-blocks")

    drawn = {
        (r["_source"], r["pass"]): r["n"]
        for r in taken.groupBy("_source", "pass").agg(F.count("*").alias("n")).collect()
    }
    names = [name for name, *_ in sources]
    quotas = [sum(n for (s, _), n in drawn.items() if s == name) for name in names]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    shares = []
    for i, name in enumerate(names):
        for p in sorted(p for s, p in drawn if s == name):
            earlier = sum(drawn[name, q] for s, q in drawn if s == name and q < p)
            shares.append((name, p, earlier, ends[:, i].tolist()))
    shares = small_table(spark, shares, "_s string, _p long, earlier long, ends array<long>")
    at = F.col("nth") + F.col("earlier")
    return (
        taken.join(shares, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= at)).cast("long"))
        .select("_row", "pass", "block", "words", "shard", draw(seed + 1, "shard", "_tie", "pass", "block").alias("place"))
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken, shard_words) for every document.

    `taken` counts the words of its blocks in the mix, repeats included; it is 0 for documents
    without words and at most `most` times the size, rounded up to a whole pass. `shard_words` has, for
    each output shard, the words that the splitting tree gave it of the document. NULL is a source
    of its own. Repeated rows are documents of their own. Very long texts are many blocks, an empty
    table gives no row, and other columns of `docs` are not read.
    """
    narrow = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    rows = sized_rows(narrow, "_id", "_text", "_from", ["_id"])
    sources = source_table(rows, weights, most)
    blocks = mix_blocks(rows, sources, block_words, shards, seed)
    by_shard = blocks.groupBy("_row", "shard").agg(F.sum("words").alias("_words"))
    taken = by_shard.groupBy("_row").agg(
        F.sum("_words").alias("_taken"),
        F.map_from_entries(F.collect_list(F.struct("shard", "_words"))).alias("_shards"),
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    facts = small_table(docs.sparkSession, sources, "_name string, source_size long, target double")
    return (
        rows.join(facts, F.col("_source").eqNullSafe(F.col("_name")))
        .join(taken, "_row", "left")
        .select(
            F.col("_id").alias(id),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
            F.transform(numbers, lambda s: F.coalesce(F.try_element_at("_shards", s), F.lit(0)).cast("long")).alias(
                "shard_words"
            ),
        )
    )


def cut_blocks(text: str, taken: list[int], block_words: int) -> str:
    """The taken blocks of a text in its own order: all of them are the text, and blocks in a row
    are one stretch of it; stretches that are apart go on separate lines."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    number = -(-len(spans) // block_words)
    if len(taken) == number:
        return text
    parts, blocks = [], sorted(taken)
    for i, block in enumerate(blocks):
        start, stop = block * block_words, min(len(spans), (block + 1) * block_words)
        if i and blocks[i - 1] == block - 1:
            begin = parts.pop()[0]
        else:
            begin = spans[start][0]
        parts.append((begin, spans[stop - 1][1]))
    return "\n".join(text[a:b] for a, b in parts)


def mixed_shards(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The output shards: (shard, place, id, source, text), a row for each block, shuffled in its shard.

    Rows are dealt by ranges of (shard, place) and sorted, so that files hold the shards one after the
    other, each in its own order, and a large shard lies in several. NULL texts have no blocks, and an
    empty table gives no row.
    """
    narrow = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    rows = sized_rows(narrow, "_id", "_text", "_from", ["_id", "_text"])
    facts = rows.select("_row", "_source", "_size", "_tie")
    blocks = mix_blocks(facts, source_table(facts, weights, most), block_words, shards, seed)
    takes = blocks.groupBy("_row").agg(F.collect_list(F.struct("shard", "place", "block")).alias("_takes"))
    wide = rows.select("_id", "_source", "_text", "_row").join(takes, "_row").drop("_row")
    kind = wide.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], {"shard": [], "place": [], "text": []}
            for i, (body, takes) in enumerate(zip(batch["_text"].to_pylist(), batch["_takes"].to_pylist())):
                spans = [m.span() for m in re.finditer(WORD, body)]
                for take in takes:
                    own = spans[take["block"] * block_words : (take["block"] + 1) * block_words]
                    owners.append(i)
                    out["shard"].append(take["shard"])
                    out["place"].append(take["place"])
                    out["text"].append(body[own[0][0] : own[-1][1]])
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["shard"], pa.int64()), pa.array(out["place"], pa.int64()),
                    batch["_id"].take(at), batch["_source"].take(at), pa.array(out["text"], pa.string()),
                ],
                ["shard", "place", "_id", "_source", "text"],
            )

    pieces = wide.mapInArrow(cut, f"shard long, place long, _id {kind}, _source string, text string")
    ordered = pieces.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return ordered.select("shard", "place", F.col("_id").alias(id), F.col("_source").alias(source), "text")


def mixed_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: str = "n_chars",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as documents: a row per document and pass, with the text that was taken.

    The columns are those of `docs`, `size` counted anew; others may have any names. Documents without words are not in it.
    """
    named = own_names(docs.columns)
    own_text, own_size = f"own_{text}", f"own_{size}"
    rows = sized_rows(docs.toDF(*named), f"own_{id}", own_text, f"own_{source}", named)
    narrow = rows.select("_row", "_source", "_size", "_tie")
    blocks = mix_blocks(narrow, source_table(narrow, weights, most), block_words, shards, seed)
    takes = blocks.groupBy("_row", "pass").agg(F.collect_list("block").alias("_taken"))
    takes = takes.groupBy("_row").agg(F.collect_list("_taken").alias("_takes"))
    wide = rows.select(*named, "_row").join(takes, "_row").drop("_row")
    at, sized_at = named.index(own_text), named.index(own_size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts = [], []
            for i, (body, takes) in enumerate(zip(batch[own_text].to_pylist(), batch["_takes"].to_pylist())):
                for taken in takes:
                    owners.append(i)
                    texts.append(cut_blocks(body, taken, block_words))
            columns = [batch[c].take(pa.array(owners, pa.int64())) for c in named]
            columns[at] = pa.array(texts, pa.string())
            columns[sized_at] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, named)

    mixed = wide.mapInArrow(cut, wide.select(*named).schema)
    return mixed.select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns)])
