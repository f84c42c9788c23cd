"""Scalar expressions, crop windows and batch scoring of unreadable rows."""

import random

from pyspark.sql import functions as F

from itemlab.functions import scalars
from itemlab.functions.hashing import tokens, word_histogram
from itemlab.operators import learning, quality


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_paths(spark):
    path = F.lit("/data/root/a.b/Photo.one.JPG")
    assert value(spark, scalars.base_name(path)) == "Photo.one.JPG"
    assert value(spark, scalars.extension_of(path)) == ".JPG"
    assert value(spark, scalars.stem_of(scalars.base_name(path))) == "Photo.one"
    assert value(spark, scalars.extension_of(F.lit("/a.b/.hidden"))) == ""
    assert value(spark, scalars.extension_of(F.lit("/a.b/none"))) == ""
    assert value(spark, scalars.relative_to(path, "/data/root/")) == "a.b/Photo.one.JPG"
    assert value(spark, scalars.relative_to(path, "/data/ro")) == "/data/root/a.b/Photo.one.JPG"
    assert value(spark, scalars.has_extension(path, (".jpg", ".png"))) is True


def test_numbers(spark):
    assert value(spark, scalars.ratio(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, scalars.ratio(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, scalars.finite(F.lit(float("inf")))) is None
    assert value(spark, scalars.finite(F.lit(2.5))) == 2.5
    assert value(spark, scalars.percent_text(F.lit(0.94298))) == "94.3%"


def test_histogram_counts_every_word(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(500)]
    df = spark.createDataFrame([(words,), ([],)], "words array<string>")
    full, empty = [r[0] for r in df.select(word_histogram(F.col("words"))).collect()]
    assert len(full) == len(empty) == 257
    assert sum(full) == 500 and sum(empty) == 0


def test_crop_windows_fit_and_keep_their_aspect(spark):
    sizes = [(640, 360), (100, 100), (10, 300), (300, 10), (1, 1), (399, 360)]
    items = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "id long, w int, h int")
    for r in quality.center_crop_window(items).collect():
        assert 1 <= r.crop_w <= r.w and 1 <= r.crop_h <= r.h
        assert r.crop_w in (r.w, round(r.h * 4 / 3)) and r.crop_h in (r.h, round(r.w * 4 / 3))
        assert r.top == (r.h - r.crop_h) // 2 and r.left == (r.w - r.crop_w) // 2
    plan = quality.random_crop_plan(items, epochs=4)
    rows = plan.collect()
    assert len(rows) == 4 * len(sizes)
    assert all(0 <= r.top <= r.h - r.crop_h and 0 <= r.left <= r.w - r.crop_w for r in rows)
    again = quality.random_crop_plan(items.repartition(5), epochs=4).select(*plan.columns)
    assert plan.exceptAll(again).count() == 0


def test_unreadable_rows_stay_in_the_batch(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(i % 2, 0.3), rng.random()]) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, y int, embedding array<double>")
    model = learning.fit_scorer(items)
    broken = spark.createDataFrame([(99, None, None)], items.schema)
    scored = learning.batch_score(items.unionByName(broken), model, 0.5, F.lit(12.34))
    last = scored.where("id = 99").first()
    assert (last["class"], last.p, last.attention_pct) == ("unreadable", None, None)
    summary = learning.batch_summary(scored).first()
    assert (summary.items, summary.positive + summary.other) == (61, 61)
    assert summary.positive == scored.where("p >= 0.5").count()


def test_words_and_buckets_need_no_function_for_a_comparison(spark):
    """The histogram sorts numbers as they are; words are split at blanks and line ends alone."""
    rows = spark.createDataFrame([(1, "a  b\n\nc \n a\td"), (2, " \n "), (3, ""), (4, None)], "id int, text string")
    words = rows.select("id", tokens(F.col("text")).alias("w"))
    assert {r.id: r.w for r in words.collect()} == {1: ["a", "b", "c", "a\td"], 2: [], 3: [], 4: None}
    plan = words.select(word_histogram(F.col("w")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
