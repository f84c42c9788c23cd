"""Secrets in texts, told apart by who has them.

Three base kinds are found by pattern wherever they stand: assignments to a password-like name,
access keys, and long runs of hexadecimal digits. Besides, every long mixed token is a candidate.
The hash of every value, found by pattern or candidate, is followed through the whole corpus: how many
owners (sources) have it, and in how many documents. What many owners share is an example that was
copied about; what one owner has to itself, in however many documents, is live-looking. Candidates of
one owner are added to the base spans as `owned`; every span that is reported has a verdict.

Spans come from column functions alone: the pieces between the matches and the matches themselves
alternate, so their lengths give every start. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import own_names
from itemlab.plans.groups import attach
from itemlab.plans.staging import stage

NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""{NAME}["']?\x20*[:=]\x20*["']?({VALUE})"""
#: Only runs that are long enough: a run is always matched whole, so shorter ones hide nothing.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: A whole run of token characters that has a digit, a small and a capital letter.
TOKEN = (
    "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])"
    "[A-Za-z0-9+/_=-]{20,}"
)
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: A candidate with more owners than this is an example.
MOST_OWNERS = 1


def _matches(text: Column, pattern: str, kind: int, worth: Column | None = None) -> Column:
    """Spans of a pattern's matches, leftmost and apart; `worth` says which to keep."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    keep = worth if worth is not None else F.transform(found, lambda m: F.lit(True))
    parts = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"), keep.alias("k"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(seen: Column, part: Column) -> Column:
        begin = seen["at"] + F.length(part["b"])
        stop = begin + F.length(part["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        out = F.when(part["k"], F.concat(seen["out"], F.array(span))).otherwise(seen["out"])
        return F.struct(stop.alias("at"), out.cast(SPAN).alias("out"))

    spans = F.aggregate(parts, start, step, lambda seen: seen["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def _values_long(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    return F.transform(values, lambda v: F.length(v) >= LEAST_VALUE)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three base kinds in a text, each ordered by start."""
    return {
        "assign": _matches(text, ASSIGN, 0, _values_long(text)),
        "access": _matches(text, ACCESS, 1),
        "hex": _matches(text, HEX, 2),
    }


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
    )


def scan(docs: DataFrame, text: str, owner: str, keep: list[str], most_owners: int = MOST_OWNERS) -> DataFrame:
    """The columns `keep`, `base_spans`, `all_spans` and `verdicts` for every row of `docs`.

    Rows without an owner count as one owner, and each row is a document. Spans are (start, kind
    number, stop). A verdict, one for each of all spans, says who has the span's value: `shared` by more
    than `most_owners` owners, `owned` by so few in several documents, or in a `single` document. The
    value of an assignment is what is assigned. Rows that may have a span are written down with a
    number for each; all others go straight through, so the bulk of the texts is neither written nor moved.
    """
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    names = [f"keep_{c}" for c in keep]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(owner).alias("_owner"))
    base = F.array_sort(F.concat(*base_spans(F.col("_text")).values()))
    may_hold = F.lit(False)
    for pattern in (ASSIGN, ACCESS, HEX, TOKEN):
        may_hold = may_hold | F.regexp_like("_text", F.lit(pattern))
    none = F.array().cast(SPAN)
    plain = rows.where(~may_hold).select(
        *names, none.alias("_base"), none.alias("_all"), F.array().cast("array<string>").alias("_verdicts")
    )

    def apart(span: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))

    def hashed(span: Column) -> Column:
        piece = F.substring(F.col("_text"), span["start"] + 1, span["stop"] - span["start"])
        value = F.when(span["kind"] == 0, F.regexp_extract(piece, ASSIGN, 1)).otherwise(piece)
        return F.struct(span.alias("span"), F.sha2(value, 256).alias("hash"))

    holding = rows.where(may_hold).withColumns({"_base": base, "_row": F.monotonically_increasing_id()})
    tokens = F.filter(_matches(F.col("_text"), TOKEN, 3), apart)
    holding = holding.withColumn("_candidates", F.transform(F.concat("_base", tokens), hashed))
    holding = stage(holding.select(*names, "_row", "_owner", "_base", "_candidates"), "secrets")

    # A row counts once for a hash; documents are counted by (hash, owner) first, so that a hash in
    # many rows is small by then.
    hashes = F.array_distinct(F.transform("_candidates", lambda c: c["hash"]))
    per_owner = holding.select("_owner", F.explode(hashes).alias("hash")).groupBy("hash", "_owner")
    holders = per_owner.agg(F.count("*").alias("_n")).groupBy("hash")
    holders = holders.agg(F.count("*").alias("_owners"), F.sum("_n").alias("_documents"))
    candidates = holding.select("_row", F.explode("_candidates").alias("_c")).select("_row", "_c.span", "_c.hash")
    counted = attach(candidates, holders, "hash", "_documents", row_id="_row")
    verdict = F.when(F.col("_owners") > most_owners, "shared").when(F.col("_documents") > 1, "owned").otherwise("single")
    told = counted.where((F.col("span.kind") < 3) | (F.col("_owners") <= most_owners))
    told = told.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("span", verdict.alias("verdict")))).alias("_told"))
    held = holding.join(told, "_row", "left").withColumn("_told", F.coalesce("_told", F.array()))
    held = held.select(*names, "_base", F.col("_told.span").cast(SPAN).alias("_all"), F.col("_told.verdict").alias("_verdicts"))
    return plain.unionByName(held).select(
        *[F.col(f"keep_{c}").alias(c) for c in keep],
        F.col("_base").alias("base_spans"),
        F.col("_all").alias("all_spans"),
        F.col("_verdicts").alias("verdicts"),
    )


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, verdicts) for every document.

    `verdicts` has one for each of `spans`, comma-joined like them. NULL texts count as empty and have
    no spans; very long ones are searched whole. Repeated rows are all returned, each a document; one NULL
    owner stands for all documents without one. An empty table gives none. Other columns of `docs`
    are not read, whatever their names.
    """

    def number(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, text, owner, [id]).select(
        id,
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        F.array_join("verdicts", ",").alias("verdicts"),
    )


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with every span, and what overlapping spans cover together, replaced by a mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(seen: Column, span: Column) -> Column:
        new = span["start"] >= seen["at"]
        piece = F.substring(text, seen["at"] + 1, span["start"] - seen["at"])
        out = F.when(new, F.concat(seen["out"], F.array(piece, F.lit(mark)))).otherwise(seen["out"])
        return F.struct(F.greatest(seen["at"], span["stop"]).alias("at"), out.alias("out"))

    def close(seen: Column) -> Column:
        rest = F.substring(text, seen["at"] + 1, F.length(text))
        return F.concat(F.array_join(seen["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, close)).otherwise(text)


def hide_secrets(docs: DataFrame, text: str = "text", owner: str = "source", size: str = "n_chars") -> DataFrame:
    """The documents with all their secrets replaced by a mark, and `size` counted anew.

    Base spans are hidden whatever their verdict, candidates only where one owner has them. NULL texts
    stay empty ones, an empty table gives none. Other columns may have any names.
    """
    named = own_names(docs.columns)
    found = scan(docs.toDF(*named), f"own_{text}", f"own_{owner}", named)
    hidden = found.withColumn(f"own_{text}", redact(F.col(f"own_{text}"), F.col("all_spans")))
    hidden = hidden.withColumn(f"own_{size}", F.length(f"own_{text}").cast("long"))
    return hidden.select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns)])
