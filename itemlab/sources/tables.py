"""Item, hash and prediction records built from parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlab.functions.hashing import (
    WORDS,
    difference_words,
    tokens,
    word_histogram,
)
from itemlab.functions.scalars import has_extension
from itemlab.plans.staging import spread, stage

TEXT_EXTENSIONS = (".txt",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six_digits(score: Column) -> Column:
    """A score cut to six decimals, as prediction files hold it."""
    return F.floor(score * 1e6) / 1e6


def split_by_draw(identity: Column) -> Column:
    """An existing split, as a table delivers it: 11/16 train, 2/16 val, 3/16 test."""
    digit = F.substring(F.md5(identity.cast("string")), 1, 1)
    return F.when(digit < "b", "train").when(digit < "d", "val").otherwise("test")


def items_from_table(
    df: DataFrame,
    id: str,
    cls: str,
    text: str,
    folder: str,
    min_chars: int = 20,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The item record of a text table: one row per item with the columns the audits read.

    (w, h) are the longest line and the number of lines. A text shorter than `min_chars` counts
    as unreadable: its mode is 'CORRUPT' and its w and h are 0.
    """
    body = F.col(text)
    lines = F.split(body, "\n")
    readable = F.length(body) >= min_chars
    height = F.size(lines)
    width = F.array_max(F.transform(lines, F.length))
    item_id = F.col(id).cast("long")
    name = F.concat(F.col(folder), F.lit("_"), height.cast("string"), F.lit(".txt"))
    mode = F.when(~readable, "CORRUPT").when(body.rlike("[^\\x00-\\x7F]"), "WIDE").otherwise("ASCII")
    return df.select(
        item_id.alias("id"),
        split_by_draw(item_id).alias("split"),
        F.col(cls).cast("string").alias("cls"),
        F.concat_ws(
            "/", F.col(folder), F.lpad(item_id.cast("string"), 12, "0"), name
        ).alias("path"),
        name.alias("name"),
        F.md5(body).alias("md5"),
        F.length(body).cast("long").alias("size"),
        F.when(readable, width).otherwise(0).cast("int").alias("w"),
        F.when(readable, height).otherwise(0).cast("int").alias("h"),
        mode.alias("mode"),
        has_extension(name, TEXT_EXTENSIONS).alias("loadable"),
        F.col(folder).alias("grp"),
        *keep,
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as items; the language is the class, the source is the folder."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return items_from_table(docs, id="doc_id", cls="lang", text="text", folder="source")


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carry a label; the class is good (quality 1) or poor (quality 0)."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("cls"),
    )
    # The record is built before the join, so that no text is shuffled.
    records = document_items(spark, sf_dir)
    return records.drop("cls").join(labels, "id").select(*records.columns)


def hash_words_of_text(df: DataFrame, text: str) -> DataFrame:
    """Add the four hash words of a text column; NULL for texts without a word."""
    words = tokens(F.col(text))
    counted = df.withColumn("_words", words).withColumn(
        "_hist", F.when(F.size("_words") > 0, word_histogram(F.col("_words")))
    )
    return counted.select(*df.columns, *difference_words(F.col("_hist")))


def hashed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as items with their hash words, read and hashed once and then staged.

    The staged record holds no text, so the passes of the copy search read little.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    hashed = hash_words_of_text(docs, "text")
    records = items_from_table(
        hashed, id="doc_id", cls="lang", text="text", folder="source", keep=WORDS
    )
    return stage(records, "items")


def letter_share(text: Column) -> Column:
    """The share of lower-case letters and blanks: the score of a text."""
    return six_digits(F.try_divide(F.length(F.regexp_replace(text, "[^a-z ]", "")), F.length(text)))


def document_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores for every labelled document: (id, split, y, p, p2).

    p is the share of lower-case letters and blanks, p2 the share of distinct words; y is the
    quality label. Half of the rows, by draw, form the validation split.
    """
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y")
    )
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    words = tokens(F.col("text"))
    first_digit = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    # Scored before the join, so that no text is shuffled.
    scored = docs.select(
        "id",
        F.when(first_digit < "8", "val").otherwise("test").alias("split"),
        letter_share(F.col("text")).alias("p"),
        six_digits(F.try_divide(F.size(F.array_distinct(words)), F.size(words))).alias("p2"),
    )
    return scored.join(labels, "id").select("id", "split", F.col("y").cast("int").alias("y"), "p", "p2")


def line_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large prediction table from the order lines: (split, y, p).

    y marks returned lines; p mixes the discount, the tax and the quantity into 0..1.
    """
    lines = table(spark, sf_dir, "lineitem")
    score = (
        F.col("l_discount") * 4 + F.col("l_tax") * 3 + (F.col("l_extendedprice") % 1000) / 2000
    ) / 1.2
    return lines.select(
        F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        six_digits(F.least(score, F.lit(1.0))).alias("p"),
    )
