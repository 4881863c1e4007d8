"""Many small files in archives: the same files, without a block of the disk for each."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from labelloom.plans import catalogue
from labelloom.session import shared_folder
from labelloom.sources import files, writers
from tests.conftest import SF
from tests.test_files import tables  # noqa: F401


def unpacked(root):
    found = {}
    for pack in root.glob("*.zip"):
        with zipfile.ZipFile(pack) as archive:
            assert archive.testzip() is None
            for name in archive.namelist():
                assert name not in found
                found[name] = archive.read(name)
    return found


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.suffix != ".zip"}


def test_archives_unpack_to_the_directory(spark, tables, tmp_path):  # noqa: F811
    images, labels, splits = tables
    writers.write_yolo(labels, images, splits, str(tmp_path / "loose"))
    listed = writers.write_yolo(labels, images, splits, str(tmp_path / "packed"), packed=True)
    loose, rest = tree(tmp_path / "loose"), tree(tmp_path / "packed")
    packed = unpacked(tmp_path / "packed")
    assert {n: d for n, d in loose.items() if n.endswith("img_3-6.txt") or "/labels/" in n} == packed and len(packed) == 40
    assert set(rest) == {"data.yaml", "classes.txt"} and rest["classes.txt"] == loose["classes.txt"]
    assert {r.path: (r.size, r.sha256, r.lines) for r in listed.collect()} == {
        n: (len(d), hashlib.sha256(d).hexdigest(), d.count(b"\n")) for n, d in packed.items()
    }


def test_packed_training_package_says_the_same(spark, tables, tmp_path):  # noqa: F811
    images, labels, splits = tables
    for name, packed in (("loose", False), ("packed", True)):
        writers.write_training_package(labels, images, splits, str(tmp_path / name), "set", packed=packed)
    loose, rest = tree(tmp_path / "loose"), tree(tmp_path / "packed")
    assert unpacked(tmp_path / "packed") == {n: d for n, d in loose.items() if n.startswith("labels/")}
    for name in ("export.json", "dataset_info.json", "classes.txt"):
        assert rest[name] == loose[name]
    same = lambda found: [f for f in json.loads(found["manifest.json"])["files"] if f["path"] != "data.yaml"]
    assert same(rest) == same(loose) and len(same(rest)) == 43


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_long_and_empty_files_and_full_archives(spark, tmp_path, monkeypatch, limit):
    rows = [("a/empty", 0, None), *[("long", i, f"{i:05d}\n") for i in range(3000)], *[(f"s/ä{i}", 0, "x" * (i % 9)) for i in range(60)]]
    table = spark.createDataFrame(rows, "path string, id long, content string").coalesce(1)
    batches = [b for b in table.sort("path", "id").select("path", F.col("content").cast("binary")).toArrow().to_batches(max_chunksize=70)]
    monkeypatch.setattr(files, "PACK_BYTES", limit)
    monkeypatch.setattr(files, "PACK_FILES", 25)
    writer = files._PackWriter(str(tmp_path), True)
    writer.commit([writer.write(iter(batches)), None])
    assert not (tmp_path / files.STAGED).exists() and len(list(tmp_path.glob("*.zip"))) >= 3
    want = {"a/empty": b"", "long": b"".join(b"%05d\n" % i for i in range(3000))} | {f"s/ä{i}": b"x" * (i % 9) for i in range(60)}
    assert unpacked(tmp_path) == want
    lines = files.packed_lines(spark, str(tmp_path)).where("path = 'long'")
    assert [r.line for r in lines.collect()] == [f"{i:05d}" for i in range(3000)]


def test_images_in_archives_are_read_by_range(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x06\0\0\0"
    segment = b"\xff\xe1\xff\xff" + b"\0" * 0xFFFD
    jpeg = b"\xff\xd8" + segment * 5 + b"\xff\xc0\0\x11\x08\0\x07\0\x09\x03"
    table = spark.createDataFrame([("a.png", png), ("b.jpg", jpeg), ("c.bin", b"nothing")], "path string, content binary")
    files.write_packed(table, str(tmp_path / "o"), "path", "content", compress=False)
    found = {r.path: r for r in files.packed_images(spark, str(tmp_path / "o")).collect()}
    assert (found["a.png"].width, found["a.png"].height) == (640, 480)
    assert (found["b.jpg"].width, found["b.jpg"].height) == (9, 7) and found["b.jpg"].bytes_read < len(jpeg) / 8
    assert found["c.bin"].width is None and found["c.bin"].length == 7


def test_nothing_to_pack(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, c string")
    files.write_packed(empty, str(tmp_path / "e"), "path", "c")
    assert files.packed_lines(spark, str(tmp_path / "e")).collect() == []
    with pytest.raises(FileExistsError):
        (tmp_path / "f").mkdir()
        (tmp_path / "f/x").write_text("x")
        files.write_packed(empty, str(tmp_path / "f"), "path", "c")


@pytest.mark.parametrize("name", ["k01_label_files", "k06_training_package", "s17_image_files"])
def test_queries_write_no_file_for_each_image(spark, name):
    from pathlib import Path

    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.iterdir())
    found = catalogue().callables()[name](spark, SF)
    made = [p for d in set(root.iterdir()) - before for p in d.rglob("*") if p.is_file()]
    assert found.count() > 0 and 0 < len(made) < 500
