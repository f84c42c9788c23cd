"""The compression classifier: held-out accuracy, what it may learn from, and awkward tables."""

import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents
from itemlab.llm import compression
from itemlab.llm.common import table
from itemlab.llm.queries import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def judged(spark):
    found = compression.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    return found.join(table(spark, SF, "labels"), "doc_id").toPandas()


def test_held_out_accuracy(judged):
    unseen = judged[judged.held_out & judged.quality.notna()]
    good, bad = unseen[unseen.quality == 1], unseen[unseen.quality == 0]
    assert len(good) > 600 and len(bad) > 100
    assert (good.predicted == 1).mean() >= 0.99
    assert (bad.predicted == 0).mean() >= 0.85
    ranks = unseen.score.rank()
    area = (ranks[good.index].mean() - (len(good) + 1) / 2) / len(bad)
    assert area >= 0.98


def test_scores_are_calibrated(judged):
    """Over the held-out texts the mean score is near the share of good ones."""
    unseen = judged[judged.held_out & judged.quality.notna()]
    assert abs(unseen.score.mean() - unseen.quality.mean()) < 0.03
    assert ((unseen.score - unseen.quality) ** 2).mean() < 0.02


def test_held_out_rows_are_those_of_the_rule(judged):
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(judged.doc_id, judged.held_out))
    assert ((judged.score >= 0.3) == (judged.predicted == 1)).all()
    assert judged.score.between(0, 1).all()


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    turned = F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    a = compression.score_quality(docs, labels).orderBy("doc_id").collect()
    b = compression.score_quality(docs, labels.withColumn("quality", turned)).orderBy("doc_id").collect()
    assert a == b


def test_awkward_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (4, 1), (4, 0), (4, None), (None, 1), (5, 1), (6, 0), (7, 0), (99, 1), (5, 3)], "doc_id long, quality int"
    )
    found = compression.score_quality(documents(spark, AWKWARD), labels).toPandas()
    assert len(found) == len(AWKWARD) and found.score.between(0, 1).all()
    assert found[found.doc_id == 4].score.nunique() == 1
    assert not found[found.doc_id.isna()].held_out.any()


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert set(compression.score_quality(documents(spark, AWKWARD), none).toPandas().score) == {0.5}
    assert compression.score_quality(documents(spark, []), none).count() == 0
    one_class = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert compression.score_quality(documents(spark, AWKWARD), one_class).toPandas().score.nunique() == 1


def test_names_with_dots(spark):
    docs = documents(spark, AWKWARD).withColumnsRenamed({"doc_id": "a.id", "text": "a.text"})
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0)], "`a.id` long, `the.label` int")
    found = compression.score_quality(docs, labels, "a.id", "a.text", "the.label")
    assert found.columns == ["a.id", "held_out", "score", "predicted"] and found.count() == len(AWKWARD)


def test_measures_against_plain_sizes():
    """Pieces cover the whole text, each compressed alone."""
    good, bad = [b"the quick brown fox jumps " * 40] * 9, [b"### &&& %%% $$$ " * 60] * 9
    contents = [compression.dictionary(x) for x in (good, bad)]
    text = good[0] + bad[0]
    sizes = [
        sum(len(compression.compressor(c).compress(text[i : i + compression.PIECE])) for i in range(0, len(text), compression.PIECE))
        for c in contents
    ]
    want = [(sizes[1] - sizes[0]) / len(text), min(sizes) / len(text)]
    assert np.allclose(compression.measures([text], *contents)[0], want)
    assert (compression.measures([b""], *contents) == [[0.0, 1.0]]).all()


def test_query_returns_every_row(spark):
    found = registry.functions["op13_quality_classifier"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == table(spark, "/root/testdata/sf0.001", "documents").count()
