"""Small column expressions: ratios, rounding, paths, file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def finite(value: Column) -> Column:
    """The value, or NULL when it is infinite or not a number."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether a path ends in one of the extensions, in any letter case."""
    lowered = F.lower(path)
    found = F.lit(False)
    for extension in extensions:
        found = found | lowered.endswith(extension)
    return found


def extension_of(path: Column) -> Column:
    """The extension with its dot; '' when the last path element has none."""
    return F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)


def stem_of(name: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def base_name(path: Column) -> Column:
    """The last element of a path."""
    return F.element_at(F.split(path, "/"), -1)


def relative_to(path: Column, root: str) -> Column:
    """A path without the folder `root` in front of it; unchanged when it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(
        path
    )


def percent_text(share: Column, digits: int = 1) -> Column:
    """A share in 0..1 as a percentage with a fixed number of digits."""
    return F.format_string(f"%.{digits}f%%", share * 100)
