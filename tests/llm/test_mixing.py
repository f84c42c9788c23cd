from collections import Counter, defaultdict
from math import comb, prod

import numpy as np
import pytest
from helpers import AWKWARD, WORD, documents, rows
from pyspark.sql import functions as F

from itemlab.llm import mixing


def brute_targets(sizes, weights, most=3):
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else share[i]
        free -= over or free
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 100], [0, 5, 7, 900], [0, 0], [3], [1, 2, 3, 4, 5, 6]])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_quotas_are_split_exactly_and_like_a_sample():
    quotas = [1000, 10, 0, 1, 300]
    split = mixing.split_quotas(quotas, 7)
    assert split.sum(axis=0).tolist() == quotas
    assert np.ptp(split.sum(axis=1)) <= 1 and (split >= 0).all()
    many = np.stack([mixing.split_quotas([500, 500], 10, seed)[3, 0] for seed in range(300)])
    # 100 of 1000 blocks, half of them from the first source: mean 50, variance 100/4 * 900/999.
    assert abs(many.mean() - 50) < 1 and 18 < many.var() < 28
    big = mixing.split_quotas([3 * 10**9, 10**9], 4)
    assert big.sum(axis=0).tolist() == [3 * 10**9, 10**9] and np.ptp(big.sum(axis=1)) <= 1


def test_awkward_documents(spark):
    docs = documents(spark, AWKWARD)
    found = mixing.mix(docs, block_words=4)
    got = found.collect()
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in AWKWARD]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for (i, *_), n in zip(AWKWARD, sizes))
    own = Counter()
    for (_, _, _, s), n in zip(AWKWARD, sizes):
        own[s] += n
    names = sorted(own, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([own[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(own[s], round(want[s], 6)) for s in names}
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs, block_words=4).collect()))
    assert rows(mixing.mix(docs.limit(0))) == []
    assert all(r.taken == 0 for r in mixing.mix(docs.where("doc_id < 4")).collect())


def test_sources_come_near_their_targets_and_shards_hold_disjoint_blocks(spark):
    texts = [(i, " ".join([f"w{i}"] * (i % 40 * 10)), "en", "big" if i % 3 else f"s{i % 5}") for i in range(600)]
    docs = documents(spark, texts)
    source = {i: s for i, _, _, s in texts}
    taken = defaultdict(int)
    target = {}
    for r in mixing.mix(docs, block_words=16).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)

    sized = mixing.sized_rows(docs.toDF(*[f"own_{c}" for c in docs.columns]), "own_doc_id", "own_text", "own_source", [])
    blocks = mixing.mix_blocks(sized, mixing.source_table(sized), 16, 8).collect()
    assert len({(r._row, r["pass"], r.block) for r in blocks}) == len(blocks)
    shards = Counter(r.shard for r in blocks)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1


def test_mixed_documents_hold_what_was_taken(spark):
    docs = documents(spark, AWKWARD)
    mixed = mixing.mixed_documents(docs, block_words=4)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[repr(r.doc_id)] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    taken = defaultdict(int)
    for r in mixing.mix(docs, block_words=4).collect():
        taken[repr(r.doc_id)] += r.taken
    assert words == {k: n for k, n in taken.items() if n}


def test_cut_blocks_keeps_the_text_between():
    text = "  a  b\nc d\te f g "
    assert mixing.cut_blocks(text, [0, 1, 2, 3], 2) == text
    assert mixing.cut_blocks(text, [2, 0], 2) == "a  b\ne f"
    assert mixing.cut_blocks(text, [1, 2], 2) == "c d\te f"


@pytest.mark.parametrize("good, bad, n", [(3, 2 * 10**9 - 3, 10**8), (5, 7, 6), (40, 3, 20)])
def test_draws_have_the_exact_chances_at_every_size(good, bad, n):
    rng, times = np.random.default_rng(1), 20_000
    found = Counter(mixing._drawn(rng, good, bad, n) for _ in range(times))
    chances = {}
    for k in range(max(0, n - bad), min(good, n) + 1):
        # Ways to place the k drawn and the other ones, over all ways to place them.
        ways = comb(good, k) * prod(n - i for i in range(k)) * prod(good + bad - n - i for i in range(good - k))
        chances[k] = ways / prod(good + bad - i for i in range(good))
    assert abs(sum(chances.values()) - 1) < 1e-9 and set(found) <= set(chances)
    for k, p in chances.items():
        assert abs(found[k] - times * p) <= 5 * (times * p * (1 - p)) ** 0.5 + 1


def test_shards_hold_what_the_tree_gave_them(spark):
    """The words by shard add up to those taken, and the written shards have just these words."""
    texts = [(i, " ".join(f"w{i}_{k}" for k in range(i % 40 * 10)), "en", "big" if i % 3 else f"s{i % 5}") for i in range(300)]
    texts += [(300, None, "en", "big"), (301, "", "en", None), (302, "a b  c\n" * 50, "en", None)]
    docs = documents(spark, texts)
    mixed = mixing.mix(docs, block_words=16, shards=5).collect()
    assert all(len(r.shard_words) == 5 and sum(r.shard_words) == r.taken for r in mixed)
    want = {(s, r.doc_id): n for r in mixed for s, n in enumerate(r.shard_words) if n}
    rows_of = mixing.mixed_shards(docs, block_words=16, shards=5)
    got, bodies = Counter(), {i: t for i, t, *_ in texts}
    written = rows_of.collect()
    for r in written:
        got[r.shard, r.doc_id] += len(WORD.findall(r.text))
        assert r.text in bodies[r.doc_id]
    assert got == want
    blocks = Counter(r.shard for r in written)
    assert max(blocks.values()) - min(blocks.values()) <= 1
    order = [(r.shard, r.place) for r in written]
    assert order == sorted(order) and [r.doc_id for r in written] != sorted(r.doc_id for r in written)


def test_what_is_taken_equals_a_plain_version(spark):
    """Blocks by the order drawn for them, until the one that ends nearest to the target."""
    texts = [(i, " ".join(["w"] * (i * 7 % 90)), "en", f"s{i % 4}") for i in range(120)]
    docs = documents(spark, texts)
    narrow = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("source").alias("_from"))
    sized = mixing.sized_rows(narrow, "_id", "_text", "_from", ["_id"])
    sources = mixing.source_table(sized)
    cut = []
    for r in sized.collect():
        for block in range(-(-r._size // 16)):
            words = min(16, r._size - 16 * block)
            cut += [(p, r._id, r._source, r._tie, block, words) for p in range(3)]
    cut = spark.createDataFrame(cut, "pass long, id long, source string, tie long, block long, words long")
    drawn = cut.withColumn("draw", mixing.draw(mixing.SEED, "pass", "tie", "block", "words")).collect()
    taken = Counter()
    for name, size, target in sources:
        for p in range(3):
            at, rest = 0, target - p * size
            for b in sorted((b for b in drawn if b.source == name and b["pass"] == p), key=lambda b: (b.draw, b.tie, b.block)):
                if rest > 0 and at + b.words / 2 <= rest:
                    taken[b.id] += b.words
                at += b.words
    assert {r.doc_id: r.taken for r in mixing.mix(docs, block_words=16).collect() if r.taken} == dict(taken)
