"""Image folders, pixels, report files and streams."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.functions.images import difference_bits, image_features, image_hash
from itemlab.operators.quality import image_rules, with_reason
from itemlab.sources import reports
from itemlab.operators.audit import quality_audit
from itemlab.sources.files import assign_output_names, read_item_metadata, scan_items, scan_source
from itemlab.streaming.scoring import read_stream


def png(pixels):
    """An 8-bit RGB picture as PNG bytes."""
    height, width, _ = pixels.shape

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    lines = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def picture(seed, height=40, width=60):
    """A smooth random picture."""
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 255, (5, 6, 3)).astype(float)
    return np.kron(coarse, np.ones((height // 5, width // 6, 1)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for split in ("train", "val", "test", "rejected"):
        for cls in ("a", "b"):
            place = root / split / cls
            place.mkdir(parents=True)
            (place / "one.png").write_bytes(png(picture(hash((split, cls)) % 1000)))
    (root / "train" / "a" / "broken.PNG").write_bytes(b"not a picture")
    (root / "train" / "a" / "flat.png").write_bytes(png(np.full((30, 30, 3), 9)))
    (root / "train" / "a" / "notes.txt").write_text("text")
    (root / "train" / "a" / ".hidden.png").write_bytes(b"x")
    (root / "train" / "__MACOSX").mkdir()
    (root / "train" / "__MACOSX" / "x.png").write_bytes(b"x")
    return str(root)


def test_scan_reads_only_the_splits(spark, folder):
    found = scan_items(spark, folder).collect()
    assert len(found) == 8
    assert {(r.split, r.cls) for r in found} == {(s, c) for s in ("train", "val", "test") for c in "ab"}
    single = scan_items(spark, folder + "/rejected").collect()
    assert {(r.split, r.cls, r.name) for r in single} == {("all", c, "one.png") for c in "ab"}


def test_scan_source_names_missing_folders(spark, folder):
    got = scan_source(spark, folder + "/train", {"first": "a", "second": "b"})
    assert {(r.cls, r.name) for r in got.collect()} == {
        ("first", "one.png"), ("first", "broken.PNG"), ("first", "flat.png"), ("second", "one.png")
    }
    with pytest.raises(FileNotFoundError, match="nowhere"):
        scan_source(spark, folder + "/train", {"first": "a", "second": "nowhere"})


def test_metadata_keeps_broken_files_as_rows(spark, folder):
    meta = read_item_metadata(spark, scan_items(spark, folder), folder)
    rows = {(r.split, r.cls, r.name): r for r in meta.collect()}
    good, bad = rows[("train", "b", "one.png")], rows[("train", "a", "broken.PNG")]
    assert (good.w, good.h, good.mode, good.loadable, len(good.md5)) == (60, 40, "RGB", True, 32)
    assert (bad.w, bad.h, bad.mode, bad.loadable) == (0, 0, "CORRUPT", True)


def test_pixels_and_rules(spark, folder):
    pictures = spark.read.format("image").option("dropInvalid", "false").load(folder + "/train/a")
    images = pictures.select(F.col("image.origin").alias("id"), "image.*")
    features = {r.id.rsplit("/")[-1]: r for r in image_features(images, "squash").collect()}
    assert features["flat.png"].contrast == 0 and features["one.png"].contrast > 1
    assert features["broken.PNG"].blur is None
    hashes = {r.id.rsplit("/")[-1]: r for r in image_hash(images).collect()}
    assert hashes["flat.png"].h0 == 0 and hashes["broken.PNG"].h0 is None
    meta = read_item_metadata(spark, scan_items(spark, folder), folder).where("split = 'train' AND cls = 'a'")
    contrast = image_features(images, "centre_crop").select(
        F.element_at(F.split("id", "/"), -1).alias("name"), "contrast"
    )
    reasons = with_reason(meta.join(contrast, "name"), image_rules()).collect()
    assert {r.name: r.reason for r in reasons} == {
        "one.png": None, "flat.png": "one plain colour", "broken.PNG": "damaged picture"
    }


def test_the_hash_survives_resizing():
    small, large = picture(5)[:, :, 0], picture(5, 80, 120)[:, :, 0]
    assert (difference_bits(small) != difference_bits(large)).sum() <= 5
    other = picture(6)[:, :, 0]
    assert (difference_bits(small) != difference_bits(other)).sum() > 25


def test_reports(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="made by the sweep"):
        reports.read_report_csv(spark, str(tmp_path / "none"), "a int", made_by="the sweep")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert not reports.outputs_exist(spark, [one, two])
    spark.range(3).write.parquet(one)
    with pytest.raises(RuntimeError, match="interrupted"):
        reports.outputs_exist(spark, [one, two])
    spark.range(3).write.parquet(two)
    assert reports.outputs_exist(spark, [one, two])
    counts = spark.createDataFrame([("a", 5), ("b", 5)], "cls string, n long")
    with pytest.raises(Exception, match="cannot tell"):
        reports.infer_class_order(counts, 5).collect()
    with pytest.raises(Exception, match="no saved threshold"):
        reports.load_threshold(None, spark, default=None).collect()


def test_a_restarted_stream_writes_each_row_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.range(10).write.parquet(source)

    def run():
        rows = read_stream(spark, source)
        query = rows.writeStream.format("parquet").option("checkpointLocation", progress)
        query.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == list(range(10))
    spark.range(10, 15).write.mode("append").parquet(source)
    assert run() == list(range(15))
    assert run() == list(range(15))


def test_names_stay_apart_when_eight_digits_do_not(spark):
    rows = [(i, "train", "a", f"{folder}/x.png", "x.png", "0123456789" + folder) for i, folder in enumerate("bcd")]
    items = spark.createDataFrame(rows, "id int, split string, cls string, path string, name string, md5 string")
    names = {r.path: r.file for r in assign_output_names(items).collect()}
    assert names["b/x.png"] == "x.png" and names["c/x.png"] == "x_01234567.png"
    assert len(set(names.values())) == 3


def test_formats_and_errors_come_from_the_first_bytes(spark, tmp_path):
    heads = {
        "a.png": b"\x89PNG\r\n\x1a\n", "b.png": b"\xff\xd8\xff\xe0 but no picture", "c.png": b"GIF89a", "d.png": b"BM1234",
        "e.png": b"RIFF\x00\x01\x02\x03WEBPVP8 ", "f.png": b"RIFF\x00\x01\x02\x03WAVE",
    }
    (tmp_path / "x").mkdir()
    for name, head in heads.items():
        (tmp_path / "x" / name).write_bytes(head)
    found = read_item_metadata(spark, scan_items(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {r.name: r.format for r in found} == dict(
        zip(heads, ["PNG", "JPEG", "GIF", "BMP", "WEBP", None])
    )
    said = {r.name: r.error for r in found}
    assert all(r.mode == "CORRUPT" and r.error for r in found)
    assert "no known format" in said["f.png"] and said["b.png"].startswith("JPEG")
    audited = {r.key: r.value for r in quality_audit(spark.createDataFrame(found)).collect()}
    assert audited["format.PNG"] == 1 and audited["format.unknown"] == 1


def test_the_document_has_every_part_or_says_which_is_missing(spark, tmp_path):
    one = spark.createDataFrame([("a", 0.1)], "name string, x double")
    some = spark.createDataFrame([("b", 1.0), ("a", None)], "name string, x double")
    parts = {key: one if form == "row" else some for key, form in reports.PARTS.items()}
    path = str(tmp_path / "whole")
    read = reports.read_document(spark, path, reports.write_document(spark, parts, path))
    assert set(read) == set(parts)
    for key, frame in read.items():
        assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, parts[key].collect()))
    with pytest.raises(ValueError, match="lacks .'headline'.* know .'other'"):
        reports.write_document(spark, {"other": one} | {k: p for k, p in parts.items() if k != "headline"}, path)
    with pytest.raises(Exception, match="headline needs one row, it has 2 rows"):
        reports.write_document(spark, parts | {"headline": some}, str(tmp_path / "two"))
    with pytest.raises(Exception, match="history must not be empty"):
        reports.write_document(spark, parts | {"history": some.limit(0)}, str(tmp_path / "none"))
    empty = parts | {"roc": some.limit(0)}
    path = str(tmp_path / "empty")
    assert reports.read_document(spark, path, reports.write_document(spark, empty, path))["roc"].count() == 0
