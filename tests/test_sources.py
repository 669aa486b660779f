"""Readers and sinks on files that the tests write."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlens.sources import files, readers, sinks


def png(width, height):
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def jpeg(width, height, *before, start=0xC0):
    """The head of a JPEG file with the given segments before its frame."""
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes(9)
    segments = [*before, (start, frame)]
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(x) + 2) + x for m, x in segments) + b"\xff\xda"


def test_sizes_of_pictures_from_their_heads(spark, tmp_path):
    thumbnail = jpeg(7, 9)
    pictures = {
        "a.png": png(640, 480), "b.jpg": jpeg(300, 200), "c.jpeg": jpeg(65000, 3, (0xE1, thumbnail + bytes(60_000)), (0xC4, bytes(30)), start=0xC2),
        "d.JPG": b"\xff\xd8\xff\xff" + jpeg(5, 6)[3:], "text.jpg": b"no picture at all", "cut.jpg": jpeg(300, 200)[:8], "endless.jpg": b"\xff\xd8\xff\xe0\x00\x00" + bytes(20),
        "left out.gif": b"GIF89a",
    }
    for name, data in (pictures | {"none.png": b""}).items():  # Spark lists no file without bytes
        (tmp_path / name).write_bytes(data)
    found = {r.doc_id: (r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    assert found == {"a": (640, 480), "b": (300, 200), "c": (65000, 3), "d": (5, 6), "text": (None, None), "cut": (None, None), "endless": (None, None)}


def test_array_rows_by_ranges(spark, tmp_path):
    draw = np.random.default_rng(1)
    arrays = {"a": draw.normal(size=(1000, 7)).astype("<f4"), "b": draw.normal(size=(3, 2)).astype(">f8"), "c": np.arange(5), "empty": np.zeros((0, 4))}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "other.txt").write_text("x")
    files.register(spark)
    rows = spark.read.format("npy_rows").option("rangeBytes", 28 * 64).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 16 + 1 + 1
    found = {(r.file, r.row): r["values"] for r in rows.collect()}
    assert found == {(f"{n}.npy", i): np.atleast_1d(v).astype(float).tolist() for n, x in arrays.items() for i, v in enumerate(x)}
    assert readers.array_rows(spark, f"{tmp_path}/b.npy").count() == 3
    assert readers.array_rows(spark, f"{tmp_path}/empty.npy").count() == 0


@pytest.mark.parametrize("bad", [np.zeros((2, 2, 2)), np.asfortranarray(np.ones((3, 2))), np.array(["x"])])
def test_arrays_without_rows_of_numbers_are_refused(spark, tmp_path, bad):
    np.save(tmp_path / "bad.npy", bad)
    with pytest.raises(Exception, match="has no rows of numbers"):
        readers.array_rows(spark, str(tmp_path)).collect()


def lines_of(folder):
    return {p.stem: p.read_text().splitlines() for p in folder.glob("part=*/*.txt")}


def test_one_text_file_a_document(spark, tmp_path):
    rows = [(f"doc {d}/ü", i, f"{d} {i}") for d in range(20) for i in range(50)] + [("null", 0, None)]
    lines = spark.createDataFrame(rows, "doc_id string, idx int, value string").orderBy(F.rand(3))
    sinks.text_labels(lines, str(tmp_path), position="idx", batch="one")
    wanted = {f"doc {d}%2F%C3%BC": [f"{d} {i}" for i in range(50)] for d in range(20)} | {"null": [""]}
    assert lines_of(tmp_path) == wanted
    sinks.text_labels(lines, str(tmp_path), position="idx", batch="one")  # a rerun
    assert lines_of(tmp_path) == wanted
    sinks.text_labels(spark.createDataFrame([(7, "x")], "doc_id int, value string"), str(tmp_path), batch="two")
    assert lines_of(tmp_path) == wanted | {"7": ["x"]}
    found = readers.detection_text(spark, str(tmp_path))
    assert found.count() == 1002 and found.filter("file_name = '7'").first().value == "x"


def test_a_failed_write_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    lines = spark.range(200).select((F.col("id") % 40).alias("doc_id"), "id", F.col("id").cast("string").alias("value"))
    broken = lines.withColumn("doc_id", F.when(F.col("id") != 133, F.col("doc_id")))  # a row without a document
    with pytest.raises(Exception, match="a file needs a name"):
        sinks.text_labels(broken, str(tmp_path), position="id")
    assert lines_of(tmp_path) == {} and not list(tmp_path.glob("_*"))
    half = tmp_path / "part=all-0"  # as left by a commit that was broken off
    half.mkdir()
    (half / "stale.txt").write_text("old\n")
    sinks.text_labels(lines, str(tmp_path), position="id")
    assert lines_of(tmp_path) == {str(d): [str(i) for i in range(d, 200, 40)] for d in range(40)}


def test_catalogues_names_metrics_and_label_tools(spark, tmp_path):
    (tmp_path / "catalogue.json").write_text(json.dumps([{"file_name": "a.pdf", "date": "2024-05-06 07:08:09", "split": "test"}, {"file_name": "b.pdf", "date": "never"}]))
    found = {r.file_id: r for r in readers.catalogue(spark, f"{tmp_path}/catalogue.json").collect()}
    assert found["a"].date.isoformat() == "2024-05-06T07:08:09" and found["b"].date is None and found["b"].split is None
    (tmp_path / "names.txt").write_text("one\n\n  two \n")
    assert sorted(r.name for r in readers.names(spark, f"{tmp_path}/names.txt").collect()) == ["one", "two"]
    (tmp_path / "runs").mkdir()
    for run, value in (("r1.csv", 0.5), ("r2.csv", 1.0)):
        (tmp_path / "runs" / run).write_text(f"class,precision,recall\niban,{value},0.25\n")
    assert sorted(map(tuple, readers.run_metrics(spark, f"{tmp_path}/runs").collect())) == [("r1.csv", "iban", 0.5, 0.25), ("r2.csv", "iban", 1.0, 0.25)]
    (tmp_path / "tool.json").write_text(json.dumps([{"image": "/x/1-a.png", "label": [{"rectanglelabels": ["iban"], "x": 1.5, "original_width": 9}]}]))
    assert readers.label_tool(spark, f"{tmp_path}/tool.json").first().label[0].x == 1.5
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.bin").write_bytes(b"\x00\xff")
    assert readers.encoded_files(spark, f"{tmp_path}/raw").first().content == "AP8="


def test_pools_splits_and_catalogues_are_stored(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "train"), ("a", "y", "test"), ("b", "x", "test"), ("a", "x", "train")], "key string, value string, split string")
    sinks.value_pool(rows, f"{tmp_path}/pool")
    assert {r.key: r["values"] for r in spark.read.json(f"{tmp_path}/pool").collect()} == {"a": ["x", "y"], "b": ["x"]}
    sinks.splits(rows, f"{tmp_path}/splits")
    assert readers.split_dataset(spark, f"{tmp_path}/splits").groupBy("split").count().sort("split").collect() == [("test", 2), ("train", 2)]
    sinks.mapping(rows.select(F.col("key").alias("orig"), F.col("value").alias("aug")), f"{tmp_path}/mapping")
    assert {r.orig: r.aug for r in spark.read.json(f"{tmp_path}/mapping").collect()} == {"a": ["x", "x", "y"], "b": ["x"]}
    sinks.appended(rows, f"{tmp_path}/more")
    sinks.appended(rows, f"{tmp_path}/more")
    assert spark.read.json(f"{tmp_path}/more").count() == 8
    sinks.saved(rows, rows.limit(1).drop("split"), f"{tmp_path}/saved")
    assert sorted(r.known for r in spark.read.json(f"{tmp_path}/saved").collect()) == [False] * 4 + [True]
    sinks.metrics(rows.withColumn("run", F.lit("r1")), f"{tmp_path}/log")
    sinks.metrics(rows.withColumn("run", F.lit("r2")), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 8
    masks = spark.range(1).select(F.array(F.struct(F.lit("NAME").alias("label"), F.lit("Jo").alias("value"))).alias("privacy_mask"))
    masks.write.parquet(f"{tmp_path}/masks")
    assert readers.privacy_masks(spark, f"{tmp_path}/masks").first() == ("NAME", "Jo")
