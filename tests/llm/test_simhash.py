import random
import re

import xxhash
from helpers import AWKWARD, documents, rows

from itemlab.llm import simhash


def brute_print(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", plain)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids):
    """The smallest id that each can reach over links of at most two bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for x, i in zip(label, ids):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_awkward_documents(spark):
    found = simhash.near_duplicates(documents(spark, AWKWARD)).withColumn("hex", simhash.hex_fingerprint())
    got = sorted((repr(r.doc_id), r.hex, r.component) for r in found.collect())
    prints = [brute_print(t) for _, t, _, _ in AWKWARD]
    names = groups(prints, [i for i, *_ in AWKWARD])
    assert got == sorted((repr(i), f"{p:016x}", n) for (i, *_), p, n in zip(AWKWARD, prints, names))
    assert rows(simhash.near_duplicates(documents(spark, AWKWARD).limit(0))) == []


def planted(seed):
    """Chains of small changes, full stars around a point, and far points."""
    rng = random.Random(seed)
    prints = {0, 3}
    for _ in range(12):
        at = rng.getrandbits(64)
        prints.add(at)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 4)):
                at ^= 1 << rng.randrange(64)
            prints.add(at)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << b for b in range(0, 64, 3)} | {centre ^ 1 << b ^ 1 << 63 for b in range(32, 50)}
    return sorted(prints)


def classes_of(spark, prints, crowded):
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    marked = spark.createDataFrame(signed, "fp long, id long")
    found = simhash.classes(marked, "id", crowded).join(marked, "fp")
    return [r.component for r in found.orderBy("id").collect()]


def test_links_against_brute_force_on_both_ways(spark):
    prints = planted(5)
    want = groups(prints, range(len(prints)))
    assert classes_of(spark, prints, 64) == want
    assert classes_of(spark, prints, 1) == want


def test_every_pair_is_linked_where_nothing_is_crowded(spark):
    prints = planted(6)
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    mask = (1 << 64) - 1
    got = {frozenset((a & mask, b & mask)) for a, b in rows(simhash.similar_links(fps))}
    assert got == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.connected(links).collect()} == {0}


def test_one_of_each_class_stays(spark):
    docs = documents(spark, [*AWKWARD, (9, "Two words\nTwo words\nand Über été ñ 漢字", None, None)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    names = [r.doc_id for r in kept.collect()]
    assert sorted(map(repr, names)) == sorted(map(repr, [1, 4, 5, None, 6, 7]))
