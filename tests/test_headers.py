"""Headers of generated pictures, held against Spark's own image source, and damaged ones."""

import struct
import zlib

import pytest

from itemlab.sources.files import read_item_metadata, scan_items

NAMES = {"png": "PNG", "jpg": "JPEG", "gif": "GIF", "bmp": "BMP"}


def encoded(spark, kind, w, h, grey=False):
    """A picture with some content, encoded by the image writer of the Java runtime."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 5)
    for x in range(w):
        image.setRGB(x, x % h, 0xFF0000 + x * 7)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(colour, extra=()):
    head = struct.pack(">IIBBBBB", 7, 5, 8, colour, 0, 0, 0)
    data = zlib.compress(bytes(400))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(extra) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def webp(kind, body):
    body = kind + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def found(spark, folder, files):
    (folder / "x").mkdir()
    for name, data in files.items():
        (folder / "x" / f"{name}.png").write_bytes(data)
    rows = read_item_metadata(spark, scan_items(spark, str(folder)), str(folder)).collect()
    return {r.name[:-4]: r for r in rows}


def test_sizes_equal_those_of_the_decoded_pictures(spark, tmp_path):
    files = {f"{k}_{w}x{h}": encoded(spark, k, w, h) for k in NAMES for w, h in ((1, 1), (33, 7), (300, 260))}
    files["jpg_grey"] = encoded(spark, "jpg", 20, 30, grey=True)
    rows = found(spark, tmp_path, files)
    decoded = {
        r.image.origin.rsplit("/", 1)[1][:-4]: r.image for r in spark.read.format("image").load(f"{tmp_path}/x").collect()
    }
    assert set(rows) == set(files) == set(decoded)
    for name, row in rows.items():
        assert (row.w, row.h) == (decoded[name].width, decoded[name].height) and row.error is None
        assert row.format == NAMES[name[:3]]
    assert rows["jpg_grey"].mode == "L" and rows["jpg_33x7"].mode == rows["bmp_33x7"].mode == "RGB"


def test_modes_and_long_files(spark, tmp_path):
    files = {f"png{c}": png(c) for c in (0, 2, 3, 4, 6)}
    # More chunks than the first round of steps reads, and bytes after the end.
    files["many"] = png(2, [chunk(b"tEXt", b"k%d" % i) for i in range(500)]) + b"rest"
    jpeg = encoded(spark, "jpg", 40, 30)
    files["segments"] = jpeg[:2] + b"".join(b"\xff\xe5\x00\x04ab" for _ in range(200)) + b"\xff\xff" + jpeg[3:]
    files["lossy"] = webp(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 640, 0x4000 | 480))
    files["lossless"] = webp(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28))
    files["extended"] = webp(b"VP8X", b"\x10\0\0\0" + (1999).to_bytes(3, "little") + (999).to_bytes(3, "little"))
    upside = bytearray(encoded(spark, "bmp", 33, 7))
    upside[22:26] = struct.pack("<i", -7)
    files["upside"] = bytes(upside)
    rows = found(spark, tmp_path, files)
    assert [rows[f"png{c}"].mode for c in (0, 2, 3, 4, 6)] == ["L", "RGB", "P", "LA", "RGBA"]
    sizes = {n: (r.w, r.h, r.mode) for n, r in rows.items() if not n.startswith("png")}
    assert sizes == {
        "many": (7, 5, "RGB"), "segments": (40, 30, "RGB"), "lossy": (640, 480, "RGB"), "lossless": (100, 50, "RGBA"),
        "extended": (2000, 1000, "RGBA"), "upside": (33, 7, "RGB"),
    }


def test_cut_and_damaged_files_are_rows_with_errors(spark, tmp_path):
    whole = {k: encoded(spark, k, 60, 40) for k in NAMES}
    files = {f"{k}_{cut}": data[:cut] for k, data in whole.items() for cut in (1, 3, 9, 20)}
    files |= {f"{k}_half": whole[k][: len(whole[k]) // 2] for k in ("png", "jpg", "bmp")}
    files["png_flipped"] = whole["png"][:50] + bytes([whole["png"][50] ^ 1]) + whole["png"][51:]
    files["png_long"] = whole["png"][:8] + b"\xff\xff\xff\xff" + whole["png"][12:]
    files["bmp_wide"] = whole["bmp"][:18] + b"\xff\xff\xff\x7f" * 2 + whole["bmp"][26:]
    files["webp_cut"] = webp(b"VP8X", bytes(10))[:-4]
    files["text"] = b"no picture at all"
    rows = found(spark, tmp_path, files)
    assert set(rows) == set(files)
    for name, row in rows.items():
        assert (row.mode, row.w, row.h) == ("CORRUPT", 0, 0) and row.error, name
        assert row.error.startswith(row.format or "the first bytes"), name
    assert rows["png_half"].format == "PNG" and rows["text"].format is None


def test_files_are_scanned_once(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.png").write_bytes(png(2))
    items = spark.createDataFrame([(f"file:{tmp_path}/x/a.png",)], "path string")
    read = read_item_metadata(spark, items, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
    assert read.first().w == 7


@pytest.mark.parametrize("data", [b"\xff\xd8\xff", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc0", b"GIF89a", b"BM", b"\x89PNG\r\n\x1a\n"])
def test_heads_alone(spark, tmp_path, data):
    assert found(spark, tmp_path, {"one": data})["one"].mode == "CORRUPT"
