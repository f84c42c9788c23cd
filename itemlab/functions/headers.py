"""Image formats, sizes and modes from a file's bytes, as column functions.

Nothing is decoded: the fields are read where a format has them, and what a format lets one check
without decoding is checked, so that a cut or damaged file is told from a whole one. PNG: every
chunk up to the end chunk is there with its checksum. JPEG: the segments lead to a frame header,
and a scan and the end mark follow. GIF: a picture follows the screen header. BMP: the file is
long enough for its rows. WebP: the file is as long as it says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlab.functions.hashing import once

#: How the files of a format begin, in hexadecimal; a dot stands for any digit.
SIGNATURES = {
    "PNG": "89504E470D0A1A0A",
    "JPEG": "FFD8FF",
    "GIF": "47494638",
    "BMP": "424D",
    "WEBP": "52494646........57454250",
}
#: PNG colour types and JPEG component counts by the mode they stand for.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
#: JPEG markers that start a frame, and those that stand without a length.
JPEG_FRAMES = tuple(0xFFC0 + k for k in range(16) if k not in (4, 8, 12))
JPEG_ALONE = (0xFF01, *range(0xFFD0, 0xFFD8))
FEW_STEPS = 64


def format_of(content: Column) -> Column:
    """The image format that a file's first bytes tell, NULL for none of SIGNATURES."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for name, start in SIGNATURES.items():
        found = F.when(head.rlike(f"^{start}"), name).otherwise(found)
    return found


def _bytes(content: Column, at: Column | int, n: Column | int) -> Column:
    at, n = (x.cast("int") if isinstance(x, Column) else F.lit(x) for x in (at, n))
    return F.substring(content, at, n)


def _number(content: Column, at: Column | int, n: int) -> Column:
    """n bytes from place `at` (from 1) as a number, the highest first; NULL past the end."""
    return F.conv(F.hex(_bytes(content, at, n)), 16, 10).cast("long")


def _low_first(content: Column, at: int, n: int) -> Column:
    turned = F.concat(*[_bytes(content, at + k, 1) for k in reversed(range(n))])
    return F.conv(F.hex(turned), 16, 10).cast("long")


def _has(content: Column, digits: str) -> Column:
    return F.contains(content, F.unhex(F.lit(digits)))


def _fields(w: Column, h: Column, mode: Column | str, whole: Column) -> Column:
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    return F.struct(
        w.cast("long").alias("w"), h.cast("long").alias("h"), mode.alias("mode"), whole.alias("whole")
    )


def _named(number: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit("OTHER"))


def _walk(start: Column, step: Callable[[Column], Column], most: Column) -> Column:
    """`step` from state to state until `done`, at most `most` times; few files need many steps."""

    def run(state: Column, steps: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), steps), state, lambda s, _: F.when(s["done"], s).otherwise(step(s))
        )

    def rest(state: Column) -> Column:
        return F.when(state["done"], state).otherwise(run(state, most))

    return once(run(start, F.lit(FEW_STEPS)), rest)


def _png(content: Column) -> Column:
    size = F.length(content)

    def step(state: Column) -> Column:
        at, body = state["at"], _number(content, state["at"], 4)
        fits = F.coalesce(at + 11 + body <= size, F.lit(False))
        sum_of = F.crc32(_bytes(content, at + 4, body + 4))
        right = F.when(fits, sum_of == _number(content, at + 8 + body, 4)).otherwise(False)
        end = F.hex(_bytes(content, at + 4, 4)) == "49454E44"
        return F.struct(
            F.when(right, at + 12 + body).otherwise(at).alias("at"),
            right.alias("right"),
            (end | ~right).alias("done"),
        )

    start = F.struct(F.lit(9).cast("long").alias("at"), F.lit(False).alias("right"), F.lit(False).alias("done"))
    most = F.greatest(F.lit(1), F.floor(size / 12).cast("int"))
    read = _walk(start, step, most)
    head = F.hex(_bytes(content, 13, 4)) == "49484452"
    mode = _named(_number(content, 26, 1), PNG_MODES)
    return _fields(_number(content, 17, 4), _number(content, 21, 4), mode, head & read["right"] & read["done"])


def _jpeg(content: Column) -> Column:
    size = F.length(content)

    def step(state: Column) -> Column:
        at = state["at"]
        marker, long = _number(content, at, 2), _number(content, at + 2, 2)
        frame, alone = marker.isin(*JPEG_FRAMES), marker.isin(*JPEG_ALONE)
        past = (at + 3 > size) | (marker < 0xFF00) | marker.isin(0xFFD9, 0xFFDA)
        onwards = F.when(marker == 0xFFFF, 1).when(alone, 2).otherwise(2 + long)
        stop = frame | past
        return F.struct(
            F.when(stop, at).otherwise(at + onwards).alias("at"),
            (frame & ~past).alias("frame"),
            F.coalesce(stop, F.lit(True)).alias("done"),
        )

    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(False).alias("frame"), F.lit(False).alias("done"))
    read = _walk(start, step, F.greatest(F.lit(1), size))

    def fields(state: Column) -> Column:
        at = state["at"]
        after = _bytes(content, at, size)
        whole = state["frame"] & _has(after, "FFDA") & _has(after, "FFD9")
        return _fields(
            _number(content, at + 7, 2), _number(content, at + 5, 2),
            _named(_number(content, at + 9, 1), JPEG_MODES), whole,
        )

    return once(read, fields)


def _gif(content: Column) -> Column:
    return _fields(_low_first(content, 7, 2), _low_first(content, 9, 2), "P", _has(_bytes(content, 14, F.length(content)), "2C"))


def _bmp(content: Column) -> Column:
    """Both header forms: the old one has 12 bytes and two-byte sizes. A negative height turns the rows."""
    old = _low_first(content, 15, 4) == 12
    height = _low_first(content, 23, 4)
    height = F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height)
    w = F.when(old, _low_first(content, 19, 2)).otherwise(_low_first(content, 19, 4))
    h = F.when(old, _low_first(content, 21, 2)).otherwise(height)
    bits = F.when(old, _low_first(content, 25, 2)).otherwise(_low_first(content, 29, 2))
    plain = old | _low_first(content, 31, 4).isin(0, 3)
    sane = (w < 1 << 24) & (h < 1 << 24) & bits.isin(1, 4, 8, 16, 24, 32)
    row = F.floor((w * bits + 31) / 32) * 4
    needed = _low_first(content, 11, 4) + F.when(plain, row * h).otherwise(1)
    mode = F.when(bits <= 8, "P").otherwise("RGB")
    return _fields(w, h, mode, F.when(sane, needed <= F.length(content)))


def _webp(content: Column) -> Column:
    kind = F.hex(_bytes(content, 13, 4))
    packed = _low_first(content, 22, 4)
    lossy, lossless, extended = (kind == k for k in ("56503820", "5650384C", "56503858"))

    def side(first: int, shift: int, third: int) -> Column:
        return (
            F.when(lossy, _low_first(content, first, 2).bitwiseAND(F.lit(0x3FFF).cast("long")))
            .when(lossless, F.shiftright(packed, shift).bitwiseAND(F.lit(0x3FFF).cast("long")) + 1)
            .when(extended, _low_first(content, third, 3) + 1)
        )

    alpha = F.when(lossless, F.shiftright(packed, 28).bitwiseAND(F.lit(1).cast("long")) == 1).when(
        extended, _number(content, 21, 1).bitwiseAND(F.lit(16).cast("long")) == 16
    )
    mode = F.when(alpha, "RGBA").otherwise("RGB")
    begins = F.when(lossy, F.hex(_bytes(content, 24, 3)) == "9D012A").when(
        lossless, F.hex(_bytes(content, 21, 1)) == "2F"
    ).otherwise(extended)
    fits = _low_first(content, 5, 4) + 8 <= F.length(content) + 1
    return _fields(side(27, 0, 25), side(29, 14, 28), mode, begins & fits)


def header_of(content: Column) -> Column:
    """(format, w, h, mode, error) of a file's bytes.

    Files of no known format, cut ones and damaged ones have mode 'CORRUPT', w and h 0 and an error;
    the format is what the first bytes tell.
    """
    readers = {"PNG": _png, "JPEG": _jpeg, "GIF": _gif, "BMP": _bmp, "WEBP": _webp}

    def read(name: Column) -> Column:
        fields = _fields(F.lit(0), F.lit(0), "CORRUPT", F.lit(False))
        for known, reader in readers.items():
            fields = F.when(name == known, reader(content)).otherwise(fields)
        return once(fields, lambda f: checked(name, f))

    def checked(name: Column, f: Column) -> Column:
        good = F.coalesce(f["whole"] & (f["w"] > 0) & (f["h"] > 0), F.lit(False))
        return F.struct(
            name.alias("format"),
            F.when(good, f["w"]).otherwise(0).cast("int").alias("w"),
            F.when(good, f["h"]).otherwise(0).cast("int").alias("h"),
            F.when(good, f["mode"]).otherwise("CORRUPT").alias("mode"),
            F.when(good, None)
            .when(name.isNull(), "the first bytes are those of no known format")
            .otherwise(F.concat(name, F.lit(" data that is cut off or damaged")))
            .alias("error"),
        )

    return once(format_of(content), read)
