"""Near-duplicate documents by simhash and multi-index hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in more than half of the hashes of the
document's 3-word shingles. Two documents are linked when their fingerprints differ in at most
two bits; the classes are the connected groups of links.

Search: a fingerprint has two segments of 32 bits. If two of them differ in at most two bits,
then either the first segments differ in at most one, or the second segments are equal. So a
table holds every fingerprint under both its segments, and a fingerprint asks for the 33 values
in the ball of radius 1 around its first segment and for its own second one; what it finds is
verified on all 64 bits. Equal fingerprints are one entry, so groups of copies cost nothing.

Entries under one segment value are unlike texts that happen to share 32 bits. Should there be
more than `crowded` of them, pairs would grow with the square; then all fingerprints that ask
for that value take a second way, as exact: each is put under the 65 values of its ball of
radius 1 over all 64 bits. Two fingerprints differ in at most two bits exactly if such balls
meet, so linking every one to the smallest under a value loses nothing and lists no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import own_names
from itemlab.plans.staging import stage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
HALF = 32
LOW_HALF = (1 << HALF) - 1
BLOCK = 1 << 16
#: Entries under one segment value beyond which they take the second way.
CROWDED = 64


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; 0 without words. Texts are hashed in blocks of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    first = starts[:count].tolist()
    last = ends[SHINGLE_WORDS - 1 :].tolist() if len(words) >= SHINGLE_WORDS else [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, count, BLOCK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * ones > count, bitorder="little")
    return int(chosen.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint as a signed number; NULL text counts as empty."""
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch["_text"]], dtype=np.uint64)
            columns = [*[batch[c] for c in keep], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "fp"])

    return rows.mapInArrow(hashed, rows.select(*keep).schema.add("fp", "long"))


def _ball(value: Column, bits: int) -> Column:
    """`value` and the values that differ from it in one of its lowest `bits` bits."""
    one = F.lit(1).cast("long")
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: value.bitwiseXOR(F.call_function("shiftleft", one, i)),
    )
    return F.concat(F.array(value), flips)


def similar_links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b, that join all fingerprints within two bits of one another.

    `fps` has distinct `fp`. Every returned pair is within two bits; among crowded values only
    the links to the smallest are returned, which leave the connected groups as they are.
    """
    first = F.shiftrightunsigned("fp", HALF)
    second = F.col("fp").bitwiseAND(F.lit(LOW_HALF))
    # The segment's number is bit 32 of the key.
    own = F.array(first, second + (1 << HALF))
    entries = fps.select("fp", F.explode(own).alias("value"))
    full = (
        entries.groupBy("value").agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select("value")
    )
    full = stage(full, "simhash-crowded")
    asked = fps.select("fp", F.explode(F.concat(_ball(first, HALF), F.array(second + (1 << HALF)))).alias("value"))

    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    table = entries.join(full, "value", "left_anti").withColumnRenamed("fp", "b")
    pairs = (
        asked.withColumnRenamed("fp", "a")
        .join(table, "value")
        .where((F.col("a") != F.col("b")) & (apart <= MAX_BITS))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )

    dense = asked.join(full, "value", "left_semi").select("fp").distinct()
    around = stage(dense.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("value")), "simhash-dense")
    centres = around.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("_n"))
    stars = (
        around.join(centres.where("_n > 1"), "value")
        .where(F.col("a") != F.col("fp"))
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.unionByName(stars).distinct()


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) can reach.

    Rounds of taking the smallest neighbour's root and then the root's root; a round writes its
    labels to the shared folder. Groups are joined by their nodes, whose neighbours are counted
    together before they are shuffled; a node with very many rows is split by adaptive joins.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("_b")).select(
            F.col("a").alias("node"), F.least("a", "_b").alias("root")
        ),
        "labels",
    )
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("_near"))
            .withColumnRenamed("a", "node")
        )
        hooked = labels.join(near, "node").select("node", F.least("root", "_near").alias("_root"), F.col("root").alias("_old"))
        # A root hands what its members have found to all of them.
        best = hooked.groupBy("_old").agg(F.min("_root").alias("_best"))
        moved = hooked.join(best, "_old").select("node", F.least("_root", "_best").alias("root"), "_old")
        moved = stage(moved, "labels")
        if moved.where("root <> _old").isEmpty():
            return moved.select("node", "root")
        # One jump: the root's own root.
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        labels = stage(
            moved.join(jump, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "labels"
        )
    raise RuntimeError("the groups did not settle")


def classes(marked: DataFrame, id: str, crowded: int = CROWDED) -> DataFrame:
    """(fp, component) for the fingerprints of `marked`: the smallest id of each class."""
    nodes = stage(marked.groupBy("fp").agg(F.min(id).alias("least")), "simhash-nodes")
    roots = connected(similar_links(nodes.select("fp"), crowded))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(named, "root").select("fp", "component", "root")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(id, fp, component) for every document: its class is the smallest id that it can reach.

    Repeated rows are all returned. Documents without words share fingerprint 0 and are linked
    like any other. A NULL id gets its class, and no class is named after it unless all are NULL.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_words"))
    marked = stage(with_fingerprints(rows, "_words", ["_id"]), "fingerprints")
    found = classes(marked, "_id", crowded)
    return marked.join(found, "fp").select(F.col("_id").alias(id), "fp", "component")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One document of each class, the one with the smallest id, with its own columns.

    Decisions are made on (id, hash of the text) alone, so texts are read twice and not written
    down. Rows that agree in both are repeats, of which one stays.
    """
    name, words = F.col(f"`{id}`"), F.col(f"`{text}`")
    key = [name.alias("_id"), F.sha2(F.coalesce(words, F.lit("")), 256).alias("_key")]
    marked = stage(with_fingerprints(docs.select(*key, words.alias("_words")), "_words", ["_id", "_key"]), "fingerprints")
    found = marked.groupBy("_id", "_key", "fp").agg(F.count("*").alias("_n"))
    found = stage(found.join(classes(marked, "_id", crowded), "fp"), "simhash-members")
    return first_of_each(docs, found, id, text)


def first_of_each(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of `docs` that come first in their group; `found` has (_id, _key, root) and the count _n.

    `_key` is the hash of the text.
    """
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).alias("_first"))
    judged = found.join(first, "root")
    stays = F.col("_first._id").eqNullSafe(F.col("_id")) & (F.col("_first._key") == F.col("_key"))
    gone = stage(judged.where(~stays).select(F.col("_id").alias("_gone"), F.col("_key").alias("_gone_key")), "copies-gone")
    again = judged.where(stays & (F.col("_n") > 1))
    again = stage(again.select(F.col("_id").alias("_again"), F.col("_key").alias("_again_key")), "copies-again")

    named = own_names(docs.columns)
    own = dict(zip(docs.columns, named))
    words = F.col(f"`{own.get(text, f'own_{text}')}`")
    rows = docs.toDF(*named).withColumns({"_id": F.col(f"`{own.get(id, f'own_{id}')}`"), "_key": F.sha2(F.coalesce(words, F.lit("")), 256)})
    # What goes grows with the corpus, so it is shuffled like the documents at every size.
    left = rows.join(gone.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    if not again.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_key") == F.col("_again_key"))
        repeats = left.join(again, same, "left_semi").dropDuplicates(["_id", "_key"])
        left = left.join(again, same, "left_anti").unionByName(repeats)
    return left.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(named, docs.columns)])


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
