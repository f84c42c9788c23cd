"""Items from folders of files, and their output names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS
from itemlab.functions.headers import header_of
from itemlab.functions.scalars import extension_of, has_extension, stem_of
from itemlab.plans.groups import attach
from itemlab.plans.staging import stage

IGNORED_FOLDERS = ("__MACOSX",)


def _listing(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path, size, parts): visible files below `root` with one of the extensions.

    Only names and sizes are read: the binary source leaves out the content it is not asked for.
    `parts` is the path below the root; a folder written by a partitioned sink ('split=train')
    counts by its value.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size"))
    )
    start = files.select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("_p"), "path", "size")
    prefix = root.rstrip("/").split("://")[-1].lstrip("/")
    below = F.element_at(F.split("_p", f"\\Q{prefix}/\\E", 2), 2)
    parts = F.transform(F.split(below, "/"), lambda p: F.regexp_replace(p, "^[A-Za-z_]+=", ""))
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED_FOLDERS))
    return (
        start.withColumn("parts", parts)
        .where(~hidden & has_extension(F.col("path"), extensions))
        .select("path", "size", "parts")
    )


def scan_items(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = DEFAULTS.extensions,
    splits: Sequence[str] = DEFAULTS.splits,
) -> DataFrame:
    """(split, cls, path, name, size) of `<root>/<class>/*` or `<root>/<split>/<class>/*`.

    With one folder level the split is 'all'. Where all split folders exist, only those are read.
    """
    files = _listing(spark, root, extensions).where(F.size("parts") > 1)
    top = F.element_at("parts", 1)
    one_level = F.size("parts") == 2
    all_splits = files.agg(
        F.count_distinct(F.when(top.isin(*splits), top)) == len(splits)
    ).scalar()
    return files.where(~all_splits | top.isin(*splits)).select(
        F.when(one_level, "all").otherwise(top).alias("split"),
        F.when(one_level, top).otherwise(F.element_at("parts", 2)).alias("cls"),
        "path",
        F.element_at("parts", -1).alias("name"),
        "size",
    )


def scan_source(
    spark: SparkSession,
    root: str,
    class_folders: Mapping[str, str],
    extensions: Sequence[str] = DEFAULTS.extensions,
) -> DataFrame:
    """As `scan_items` for a source whose folder names stand for classes: {class: folder}."""
    files = _listing(spark, root, extensions).where(F.size("parts") > 1)
    folder = F.element_at("parts", 1)
    wanted = files.where(folder.isin(*class_folders.values()))
    present = {row[0] for row in wanted.select(folder).distinct().collect()}
    absent = sorted(set(class_folders.values()) - present)
    if absent:
        raise FileNotFoundError(f"no files in {absent} below {root}")
    names = F.create_map(*[F.lit(x) for c, f in class_folders.items() for x in (f, c)])
    return wanted.select(
        F.lit("all").alias("split"),
        F.get(F.array(names[folder]), 0).alias("cls"),
        "path",
        F.element_at("parts", -1).alias("name"),
        "size",
    )


def read_item_metadata(
    spark: SparkSession, items: DataFrame, root: str, extensions: Sequence[str] = DEFAULTS.extensions
) -> DataFrame:
    """Add md5, w, h, mode, format, loadable and error to scanned image items.

    One scan reads every file once; its bytes stay in the task that reads them. Size, mode and
    format are those of the file's header, whatever the name says. A cut, damaged or unknown file
    stays as a row: mode 'CORRUPT', w and h 0, and an error that says which. Files without a byte
    are not listed: Spark's file scans leave them out.
    """
    contents = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.md5("content").alias("md5"), header_of(F.col("content")).alias("_head"))
    )
    return items.join(contents, "path", "left").select(
        *items.columns,
        "md5",
        *[F.col(f"_head.{c}") for c in ("w", "h", "mode", "format")],
        has_extension(F.col("path"), extensions).alias("loadable"),
        "_head.error",
    )


def output_name(name: Column, md5: Column) -> Column:
    """The name of a later file of the same name: stem, first eight md5 digits, extension."""
    return F.concat(stem_of(name), F.lit("_"), F.substring(md5, 1, 8), extension_of(name))


def assign_output_names(items: DataFrame, hot_rows: int = DEFAULTS.hot_rows) -> DataFrame:
    """Add `file`: the name inside (split, cls). The first path keeps its own name.

    Later ones get eight digits of their md5, and all digits of their path's md5 where eight do
    not tell them apart, so that no two files have the same name.
    """

    def renamed(named: DataFrame, other: Column) -> DataFrame:
        """`other` as `file` for all but the first path of each name that occurs again."""
        keyed = named.withColumn("_target", F.concat_ws("/", "split", "cls", "file"))
        groups = (
            keyed.groupBy("_target")
            .agg(F.count("*").alias("_n"), F.min(F.struct("path", "md5")).alias("_first"))
            .where("_n > 1")
        )
        marked = attach(keyed, groups, "_target", "_n", hot_rows=hot_rows)
        keeps = F.col("_n").isNull() | (F.struct("path", "md5") == F.col("_first"))
        file = F.when(keeps, F.col("file")).otherwise(other)
        return marked.select(*items.columns, file.alias("file"))

    short = renamed(items.withColumn("file", F.col("name")), output_name(F.col("name"), F.col("md5")))
    whole = F.concat(stem_of(F.col("name")), F.lit("_"), F.md5("path"), extension_of(F.col("name")))
    return renamed(stage(short, "named"), whole)
