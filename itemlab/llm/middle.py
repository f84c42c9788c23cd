"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which then change places.

A text's tokens are its runs of ASCII letters and each other character. Two of the places between
tokens are drawn from the id. A pattern made for the row takes the prefix as the first `a` tokens,
the middle as the next `b - a` and the suffix as the rest, in one match; the match's groups are
put in their new order at once. The counted groups are possessive, so the match never goes back
and takes time and memory in proportion to the text, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: A token that gives nothing back once it has matched.
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
#: Of a hundred texts, how many change, and how many of these put the suffix first.
CHANGED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
SEED = "1"


def numbers(id: str, seed: str = SEED) -> list[Column]:
    """Four repeatable numbers below 2^32 for a row; a NULL id counts as an empty one."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_pattern(first: Column, second: Column) -> Column:
    """The pattern whose groups are the first `first` tokens, the next up to `second`, and the rest."""
    return F.format_string(f"(?s)\\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*+)\\z", first, second - first)


def restore(output: Column, form: Column) -> Column:
    """The text that `output` was made from."""
    part = F.split(output, MARK, -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """The id, n (tokens of the text), form (plain, psm or spm), prefix_chars, middle_chars (code
    points; NULL if plain) and output for every row.

    A NULL text is an empty one. Empty texts, texts that hold a mark and a tenth of the rest stay
    plain: their output is the text. Rows that agree in id and text get the same result, and all are
    returned; equal texts under different ids are cut in different places. An empty table gives an
    empty one. Other columns, whatever their names, are not read.
    """
    h1, h2, h3, h4 = numbers("_id", seed)
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(TOKEN)).cast("long"))
    stays = (F.col("_text") == "") | F.col("_text").rlike(MARK) | (h3 % 100 >= CHANGED_PERCENT)
    form = F.when(stays, "plain").when(h4 % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "_one": h1 % (F.col("n") + 1), "_two": h2 % (F.col("n") + 1)})
    pattern = cut_pattern(F.least("_one", "_two"), F.greatest("_one", "_two"))
    places = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    moved = F.regexp_replace("_text", pattern, places)
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(moved))
    at = {mark: F.locate(mark, F.col("output")) for mark in (PREFIX, SUFFIX, MIDDLE)}
    after = F.when(F.col("form") == "psm", at[SUFFIX]).when(F.col("form") == "spm", at[MIDDLE])
    return rows.select(
        F.col("_id").alias(id), "n", "form",
        (after - at[PREFIX] - len(PREFIX)).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length("output") - at[MIDDLE] - len(MIDDLE) + 1).cast("long").alias("middle_chars"),
        "output",
    )
