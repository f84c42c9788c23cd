import random
import zlib

import numpy as np
from helpers import AWKWARD, documents, rows

from itemlab.llm import langid

SYLLABLES = {"aa": "ka to mi ru se no".split(), "bb": "strum blik kraz fnord".split(), "cc": "ñé çã õa üö ßx".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(10)
    made = [(i, text(rng, lang, rng.randrange(1, 200)), lang, "a") for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(400))]
    extra = [(1000, None, "aa", "a"), (1001, "", "bb", "a"), (1002, "123 !? \n", "cc", None), (None, "kato mi", None, "a"), (1003, text(rng, "bb", 30_000), None, "a"), (1003, text(rng, "aa"), "bb", "a")]
    found = langid.identify(documents(spark, made + extra), steps=80).collect()
    assert len(found) == len(made) + len(extra)
    truth = {i: lang for i, _, lang, _ in made}
    held = [(r.lang_pred, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 50
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in found if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert "bb" in {r.lang_pred for r in found if r.doc_id == 1003}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text", None, "a"), (2, None, "en", "a")])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert rows(langid.identify(docs.limit(0))) == []
    assert len(langid.identify(documents(spark, AWKWARD), steps=5).collect()) == len(AWKWARD)


def test_gradients_against_differences():
    rng = np.random.default_rng(11)
    network = langid.Network(3, hidden=4)
    for name in ("inputs", "states", "shift", "out", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    data, labels = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = network.gradients(data, labels)
    for p, g in zip(network.parameters(), grads):
        for at in zip(*[rng.integers(0, s, 12) for s in p.shape]):
            at = (at[0], data.flat[0], *at[2:]) if p.shape[1:2] == (256,) else at
            old, step = p[at], 1e-5
            p[at] = old + step
            up, _ = network.gradients(data, labels)
            p[at] = old - step
            down, _ = network.gradients(data, labels)
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_both_forms_of_the_forward_pass_agree():
    rng = np.random.default_rng(12)
    network = langid.Network(3)
    data, labels = rng.integers(0, 256, (20, 9)).astype(np.uint8), rng.integers(0, 3, 9)
    loss, _ = network.gradients(data, labels)
    share = network.positions(data)
    assert np.allclose(share.sum(axis=2), 1, atol=1e-5)
    assert abs(-np.log(share[:, np.arange(9), labels] + 1e-9).mean() - loss) < 1e-4


def test_whole_texts_are_pooled():
    network = langid.Network(2)
    texts = [bytes(range(65, 91)) * 20, b"", b"x", bytes(64), bytes(65)]
    together = langid.document_probabilities(network, texts)
    alone = np.concatenate([langid.document_probabilities(network, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert np.allclose(together.sum(axis=1), [1, 0, 1, 1, 1], atol=1e-5)
