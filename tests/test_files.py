"""Named files, one document from many writers, and headers read by range."""

import hashlib
import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelloom.sources import files, readers, writers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def tables(spark):
    """40 images in two folders that share stems, three boxes each but for every fifth."""
    images = spark.createDataFrame(
        [(i, "ds0", f"{'ab'[i % 2]}/img_{i // 2}.jpg", 100, 50) for i in range(40)], "id long, dataset string, file_path string, width int, height int"
    )
    labels = spark.createDataFrame(
        [(i * 10 + k, i, "ds0", f"Class {k}", None, 10.0 * k, 5.0, 20.0, 10.0, k, 0, 0) for i in range(40) if i % 5 for k in range(3)],
        "id long, image_id long, dataset string, label string, ontology_class string, x double, y double, width double, height double, seq1 long, seq2 long, seq3 long",
    )
    return images, labels, images.select("id", F.when(F.col("id") < 30, "train").otherwise("val").alias("split"))


def check_manifest(root, manifest):
    listed = {r.path: (r.size, r.sha256) for r in manifest.collect()}
    for path, (size, sha256) in listed.items():
        data = (root / path).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha256)
    return listed


def test_yolo_directory_is_read_back(spark, tables, tmp_path):
    images, labels, splits = tables
    root = tmp_path / "out"
    listed = check_manifest(root, writers.write_yolo(labels, images, splits, str(root)))
    assert len(listed) == 40 and {str(p.relative_to(root)) for p in root.rglob("*.txt")} == {*listed, "classes.txt"}
    assert not (root / files.STAGED).exists()
    assert (root / "train/labels/img_0-0.txt").read_bytes() == b"" and listed["train/labels/img_3-6.txt"][0] > 0
    assert (root / "data.yaml").read_text().splitlines()[1:] == ["train: train/images", "val: val/images", "nc: 3", 'names: ["class_0", "class_1", "class_2"]']
    for classes in ("classes.txt", "data.yaml"):
        found = readers.read_yolo(spark, str(root), "val/labels", classes)
        expected = [(f"img_{i // 2}-{i}", k, f"class_{k}", round(0.1 * k, 6), 0.3) for i in range(30, 40) if i % 5 for k in range(3)]
        assert [(s, c, n, round(x, 6), round(y, 6)) for s, c, n, x, y in rows(found, "stem", "class_id", "class_name", "x1", "y2")] == sorted(expected)


def test_stems_of_their_own_have_no_suffix(spark, tables):
    images, labels, splits = tables
    paths = {r.path for r in writers.label_paths(labels, images.where("id % 2 = 0"), splits).select("path").distinct().collect()}
    assert "train/labels/img_0.txt" in paths and len(paths) == 20


def test_training_package(spark, tables, tmp_path):
    images, labels, splits = tables
    root = tmp_path / "pack"
    listed = check_manifest(root, writers.write_training_package(labels, images, splits, str(root), "set"))
    assert len(listed) == 44 and "labels/val/img_15-30.txt" in listed
    manifest = json.loads((root / "manifest.json").read_text())
    assert manifest["manifest_version"] == "1.0"
    assert [f["path"] for f in manifest["files"]] == sorted(listed)
    assert {f["path"]: (f["size_bytes"], f["sha256"]) for f in manifest["files"]} == listed
    export = json.loads((root / "export.json").read_text())
    assert (export["train_count"], export["val_count"], export["val_annotations"], export["total_annotations"], export["class_count"]) == (30, 10, 24, 96, 3)
    assert json.loads((root / "dataset_info.json").read_text())["splits"] == {"train": {"image_count": 30}, "val": {"image_count": 10}}
    with pytest.raises(FileExistsError):
        writers.write_training_package(labels, images, splits, str(root), "set")


def test_lines_of_one_file_stay_in_order(spark, tmp_path):
    lines = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string"))).alias("path"), "id")
    written = writers.write_labels(lines.withColumn("line", F.col("id").cast("string")).repartition(16), str(tmp_path / "o"))
    assert len(check_manifest(tmp_path / "o", written)) == 51
    assert (tmp_path / "o/hot").read_text().split() == [str(i) for i in range(0, 20_000, 3)]


def test_publishing_again_changes_nothing(spark, tmp_path):
    """A task of the second step may run twice."""
    base = tmp_path / files.STAGED / "try"
    (base / "files/d").mkdir(parents=True)
    (base / "files/d/x").write_text("x")
    (base / "manifest").write_text(json.dumps(["d/x", 1, "h"]) + "\n")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path)], "attempt": ["try"]})
    for _ in range(2):
        assert [b.to_pylist() for b in files._publish([batch])] == [[{"path": "d/x", "size": 1, "sha256": "h"}]]
    assert (tmp_path / "d/x").read_text() == "x"


def test_uncommitted_attempts_are_not_published(spark, tmp_path):
    stray = tmp_path / "o" / files.STAGED / "stray" / "files"
    stray.mkdir(parents=True)
    (stray / "bad.txt").write_text("bad")
    with pytest.raises(FileExistsError):
        files.write_named(spark.createDataFrame([("a", "b")], "path string, c string"), str(tmp_path / "o"), "path", "c")
    empty = files.write_named(spark.createDataFrame([], "path string, c string"), str(tmp_path / "e"), "path", "c")
    assert empty.collect() == []


def coco_parts(images, labels):
    numbered = writers.coco_images(images, F.floor(F.col("id") / 5))
    return numbered, writers.coco_annotations(labels, numbered, ["id"], F.floor(F.col("id") / 50)), writers.coco_categories(labels)


@pytest.mark.parametrize("local", [True, False])
def test_coco_document_is_read_back(spark, tables, tmp_path, monkeypatch, local):
    images, labels, _ = tables
    path = tmp_path / "instances.json"
    if not local:  # the way of stores that are written from front to back only
        real = files.filesystem

        class Stream:
            type_name = "stream"

            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return getattr(self.fs, name)

        monkeypatch.setattr(files, "filesystem", lambda p: (Stream(real(p)[0]), real(p)[1]))
    size = writers.write_coco_document(*coco_parts(images, labels), str(path))
    assert path.stat().st_size == size and not Path(f"{path}.parts").exists()
    document = json.loads(path.read_text())
    assert list(document) == ["images", "annotations", "categories"]
    assert [i["id"] for i in document["images"]] == list(range(1, 41)) and [a["id"] for a in document["annotations"]] == list(range(1, 97))
    expected = [(str(n), f"img_{i // 2}.jpg", f"class_{k}", 10.0 * k) for n, (i, k) in enumerate(((i, k) for i in range(40) if i % 5 for k in range(3)), 1)]
    for split in (False, True):
        found = readers.read_coco(spark, str(path), split=split)
        assert rows(found, "annotation_id", "file_name", "class_name", "x") == sorted(expected)


def test_document_of_empty_lists(spark, tmp_path):
    nothing = spark.createDataFrame([], "section string, line string, n long")
    files.write_document(nothing, str(tmp_path / "e.json"), ["a", "b"], ["n"], {"v": 1})
    assert json.loads((tmp_path / "e.json").read_text()) == {"v": 1, "a": [], "b": []}
    files.write_document(nothing.union(spark.createDataFrame([("b", "{}", 1)], nothing.schema)), str(tmp_path / "f.json"), ["a", "b", "c"], ["n"])
    assert json.loads((tmp_path / "f.json").read_text()) == {"a": [], "b": [{}], "c": []}


def jpeg(segments, size=(480, 640)):
    body = b"".join(b"\xff" + code + (len(data) + 2).to_bytes(2, "big") + data for code, data in segments)
    return b"\xff\xd8" + body + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", *size) + b"\x03"


def test_headers_by_range(spark, tmp_path):
    big = b"\0" * 5_000_000
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x06\0\0\0"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<Ii", 33, -44)
    exif = [(b"\xe1", b"\xff\xc0" * 30_000), (b"\xe2", b"p" * 65_000), (b"\xc4", b"t" * 40)]
    bodies = {
        "a.png": png + big, "b.bmp": bmp + big, "c.jpg": jpeg(exif) + big, "d.jpg": jpeg([], (7, 9)) + big, "e.png": b"\x89PNG", "f.jpg": b"\xff\xd8\xff\xda" + big,
        "g g%20.jpg": jpeg(exif)[:-3], "h.txt": b"text", "i.jpg": b"\xff\xd8\xff\xff\xff\xc0\x00\x11\x08" + struct.pack(">HH", 1, 2), "j.jpg": jpeg(exif)[:70_000],
    }
    for name, data in bodies.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[-1]: r for r in files.image_files(spark, str(tmp_path)).collect()}
    sizes = {k: (r.width, r.height) for k, r in found.items()}
    assert sizes == {
        "a.png": (640, 480), "b.bmp": (33, 44), "c.jpg": (640, 480), "d.jpg": (9, 7), "e.png": (None, None), "f.jpg": (None, None), "g g%20.jpg": (None, None), "h.txt": (None, None),
        "i.jpg": (2, 1), "j.jpg": (None, None),
    }
    assert all(r.bytes_read < 1 << 16 for r in found.values()) and all(r.sha256 == hashlib.sha256(bodies[k]).hexdigest() for k, r in found.items())
    whole = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256, r.width, r.height) for r in readers._read_whole_headers(spark, str(tmp_path)).collect()}
    assert {k: (r.length, r.sha256, r.width, r.height) for k, r in found.items()} == whole


def test_unused_checksums_are_not_computed(spark, tmp_path):
    (tmp_path / "d.jpg").write_bytes(jpeg([]))
    plan = readers.read_image_headers(spark, str(tmp_path)).select("path", "width")._jdf.queryExecution().executedPlan().toString()
    assert "header_of" in plan and "sha256_of" not in plan and "content" not in plan.split("ReadSchema")[1]


def test_many_coco_files_become_one(spark, tmp_path):
    from labelloom.sources import merge

    for k in range(12):
        document = {
            "images": [{"id": 1, "file_name": f"{k}-a.jpg", "width": 10 + k, "height": 5}, {"id": 2, "file_name": f"{k}-b.jpg"}],
            "annotations": [
                {"id": 1, "image_id": 2, "category_id": 1, "bbox": [k, 1, 2, 3]}, {"id": 2, "image_id": 1, "category_id": 2, "bbox": [k, 4, 2, 3], "area": 1.5, "iscrowd": 1},
                {"id": 3, "image_id": 9, "category_id": 7, "bbox": [k, 5, 2, 3]},
            ],
            "categories": [{"id": 1, "name": "odd" if k % 2 else "even", "supercategory": "s"}, {"id": 2, "name": "all"}],
        }
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k:02}.json").write_text(json.dumps(document))
    target = tmp_path / "one.json"
    merge.merge_coco_files(spark, str(tmp_path / "in"), str(target))
    one = json.loads(target.read_text())
    names = {c["id"]: c["name"] for c in one["categories"]}
    assert names == {1: "7", 2: "all", 3: "even", 4: "odd"}
    pictures = {i["id"]: i["file_name"] for i in one["images"]}
    assert list(pictures) == list(range(1, 25)) and pictures[3] == "1-a.jpg"
    assert [a["id"] for a in one["annotations"]] == list(range(1, 37))
    found = {(int(a["bbox"][0]), pictures.get(a["image_id"]), names[a["category_id"]], a["area"], a["iscrowd"]) for a in one["annotations"]}
    assert found == {x for k in range(12) for x in ((k, f"{k}-b.jpg", ("even", "odd")[k % 2], 6.0, 0), (k, f"{k}-a.jpg", "all", 1.5, 1), (k, None, "7", 6.0, 0))}


def test_stems_meet_within_their_source_only(spark):
    from labelloom.operators import joins

    left = spark.createDataFrame([("s1", "a/x.jpg"), ("s2", "b/x.jpg"), (None, "x.jpg")], "source string, path string")
    right = spark.createDataFrame([("s1", "l/x.txt"), (None, "x.txt")], "source string, path string")
    assert rows(joins.by_stem(left, right, within=["source"]).where("source = 's1'"), "path", "other_path") == [("a/x.jpg", "l/x.txt")]
    assert joins.by_stem(left, right, within=["source"]).count() == 2 and joins.by_stem(left, right).count() == 6
    merged = writers.merged_labels(right.withColumn("value", F.lit("v")), left, ["source"])
    assert {(r.image, r.labels) for r in merged.collect()} == {("a/x.jpg", "v"), ("b/x.jpg", ""), ("x.jpg", "v")}
