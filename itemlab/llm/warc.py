"""Pages to WARC archives and back.

Writing: one record per page. Of pages with equal payloads the one with the smallest id is a
`response`; the others are `revisit` records without a payload that name it.

Reading: an archive is cut at every occurrence of the magic line, also at those inside a payload.
Tasks parse what follows each into a candidate record: its own offset and, by its declared length,
the offset of its successor. Only candidates that the chain reaches from the file's start are
records; so a payload that holds whole records changes nothing. The chain is verified by pointer
jumping. Most candidates lead to the very next one, so such runs are contracted first, and the
jumps go over runs: as many rounds as the logarithm of the runs in a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlab.plans.staging import scratch_path, stage

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
MAGIC_BYTES, BLANK_BYTES = len(MAGIC), len(BLANK)
#: Base-32 digits as `conv` writes them, and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 as 32 base-32 digits. Fifteen hexadecimal digits are twelve of them."""
    digest = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digest, start, size), 16, 32), size * 4 // 5, "0")
        for start, size in ((1, 15), (16, 15), (31, 10))
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def _record_id(id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write a record per page below `folder`, one archive per task.

    The smallest id of each payload that occurs again is found on digests alone and staged, so
    that Catalyst broadcasts it when it is small and joins by sorting when it is not.
    """
    rows = pages.select(
        F.col(id).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html")
    )
    rows = rows.withColumns({"_digest": sha1_base32(F.encode("_html", "utf-8")), "_bytes": F.octet_length("_html")})
    first = (
        rows.where(F.col("_bytes") >= min_bytes)
        .groupBy(F.col("_digest").alias("_again"))
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_again", "_first")
    )
    first = stage(first, "warc-first")
    known = rows.join(first, F.col("_digest") == F.col("_again"), "left")
    revisit = F.col("_again").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))

    # A line break in a URL would end its header line.
    target = F.regexp_replace("_url", r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("_id"), F.col("_digest"))),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("_first"), F.col("_digest")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("_bytes")).cast("string")),
        F.lit(BLANK),
    )
    body = F.when(revisit, "").otherwise(F.col("_html"))
    known.select(F.concat(head, body).alias("value")).write.option("lineSep", BLANK).text(folder)


def _header(name: str) -> Column:
    found = F.regexp_extract("_head", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each magic line, with the file, the split and the order of reading."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate: file, at, succ (offsets), its header fields, `whole` and `digest`.

    `whole` says that the payload ends in this segment; then `digest` is the payload's.
    """
    raw = F.encode("value", "utf-8")
    parsed = (
        _segments(spark, folder)
        .withColumn("_cut", F.locate(BLANK, F.col("value")))
        .withColumn("_head", F.when(F.col("_cut") > 0, F.substring_index("value", BLANK, 1)))
        .withColumn("size", F.octet_length("value").cast("long"))
        .withColumn("head", (F.octet_length("_head") + BLANK_BYTES).cast("long"))
        .withColumn("length", F.expr("try_cast(regexp_extract(_head, '(?i)(?:^|\\\\r\\\\n)Content-Length: *([0-9]+)', 1) AS BIGINT)"))
        .withColumn("whole", F.coalesce(F.col("head") + F.col("length") + BLANK_BYTES <= F.col("size"), F.lit(False)))
    )
    body = F.substring(raw, F.col("head").cast("int") + 1, F.col("length").cast("int"))
    parsed = parsed.select(
        "file",
        "block",
        "seq",
        "size",
        "head",
        "length",
        "whole",
        F.when(F.col("whole"), sha1_base32(body)).alias("digest"),
        _header("WARC-Type").alias("type"),
        _header("WARC-Record-ID").alias("record"),
        _header("WARC-Refers-To").alias("refers"),
    )
    order = Window.partitionBy("file").orderBy("block", "seq")
    ends = F.sum(F.col("size") + MAGIC_BYTES).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = parsed.withColumn("end", ends - MAGIC_BYTES).withColumn("at", F.col("end") - F.col("size") - MAGIC_BYTES)
    return (
        placed.where("at >= 0")
        .withColumn("succ", F.col("at") + MAGIC_BYTES + F.col("head") + F.col("length") + BLANK_BYTES)
        .drop("head")
    )


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain of successors reaches from offset 0 of their file."""
    spark_order = Window.partitionBy("file").orderBy("at")
    linked = stage(
        found.withColumn("_next", F.lead("at").over(spark_order)).withColumn(
            "_before", F.coalesce(F.lag("succ").over(spark_order) == F.col("at"), F.lit(False))
        ),
        "warc-linked",
    )
    # Where a link skips candidates, it lands on a new run.
    landed = linked.where(F.col("succ") != F.coalesce("_next", F.lit(-1))).select("file", F.col("succ").alias("at"))
    landed = landed.distinct().withColumn("_landed", F.lit(True))
    heads = ~F.col("_before") | F.col("_landed").isNotNull()
    run = F.sum(heads.cast("long")).over(spark_order.rowsBetween(Window.unboundedPreceding, 0))
    run_of = stage(linked.join(landed, ["file", "at"], "left").withColumn("run", run).drop("_landed", "_next", "_before"), "warc-runs")
    runs = run_of.groupBy("file", "run").agg(F.min("at").alias("head"), F.max_by("succ", "at").alias("exit"))
    starts = runs.select("file", F.col("head").alias("exit"), F.col("run").alias("to"))
    jump = stage(runs.join(starts, ["file", "exit"]).select("file", F.col("run").alias("from"), "to"), "warc-jump")
    reached = stage(runs.where("head = 0").select("file", "run"), "warc-reached")
    known = reached.count()
    while not jump.isEmpty():
        further = reached.join(jump.withColumnRenamed("from", "run"), ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = stage(reached.unionByName(further).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            break
        known = now
        second = jump.select("file", F.col("from").alias("to"), F.col("to").alias("_further"))
        jump = stage(jump.join(second, ["file", "to"]).select("file", "from", F.col("_further").alias("to")), "warc-jump")
    return run_of.join(reached, ["file", "run"], "left_semi").drop("run")


def _split_payloads(spark: SparkSession, folder: str, records: DataFrame, found: DataFrame) -> DataFrame:
    """(file, at, digest) of records whose payload holds the magic and so lies in many segments."""
    starts = records.select("file", "at", F.struct("at", "succ", "length", "whole").alias("_own"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = found.select("file", "block", "seq", "at").join(starts, ["file", "at"], "left")
    span = (
        within.withColumn("_in", F.last("_own", ignorenulls=True).over(order))
        .where(~F.col("_in.whole") & (F.col("at") < F.col("_in.succ")))
        .select("file", "block", "seq", "at", F.col("_in.at").alias("_start"), F.col("_in.length").alias("_length"))
    )
    texts = _segments(spark, folder).join(span, ["file", "block", "seq"])
    whole = texts.groupBy("file", "_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), MAGIC).alias("_all"),
        F.first("_length").alias("_length"),
    )
    body = F.encode("_all", "utf-8")
    start = F.octet_length(F.substring_index("_all", BLANK, 1)) + BLANK_BYTES + 1
    return whole.select(
        "file", F.col("_start").alias("at"), sha1_base32(F.substring(body, start, F.col("_length").cast("int"))).alias("_digest")
    )


def read_archives(spark: SparkSession, folder: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every true record.

    Sizes and digests are those of the payloads read. A response that repeats an id and payload
    read before is reported as a revisit of that id, so a payload has one response.
    """
    found = stage(candidates(spark, folder), "warc-candidates")
    records = stage(reachable(found), "warc-records")
    if not records.where(~F.col("whole")).isEmpty():
        mended = _split_payloads(spark, folder, records, found)
        records = records.join(mended, ["file", "at"], "left").withColumn("digest", F.coalesce("_digest", "digest")).drop("_digest")
    page = F.expr("try_cast(regexp_extract(record, '^<urn:page:([^:]*):', 1) AS BIGINT)")
    named = records.withColumns({"page_id": page, "_key": F.regexp_extract("record", r":([^:>]*)>$", 1)})
    responses = named.where("type = 'response'")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "at")
    payloads = responses.groupBy("digest").agg(F.min(rank).alias("_first"), F.max("length").alias("_bytes"))
    payloads = payloads.withColumnRenamed("digest", "_payload")
    meant = F.when(F.col("type") == "response", F.col("digest")).otherwise(F.col("_key"))
    told = named.withColumn("_meant", meant).join(payloads, F.col("_meant") == F.col("_payload"), "left")
    own = (F.col("_first.file") == F.col("file")) & (F.col("_first.at") == F.col("at"))
    response = (F.col("type") == "response") & (own | (F.col("_bytes") < min_bytes))
    return told.select(
        "page_id",
        F.col("_bytes").alias("payload_bytes"),
        F.col("_meant").alias("payload_digest"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("_first.page_id")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages to a new folder of archives and read them back.

    NULL html is an empty payload, and empty payloads are equal like any other. A NULL id sorts
    last. Rows that repeat id and html are one response and revisits of it. Ids are whole numbers.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, id, url, html, min_bytes)
    return read_archives(pages.sparkSession, folder, min_bytes).withColumnRenamed("page_id", id)
