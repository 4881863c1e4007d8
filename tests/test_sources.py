"""Readers and writers on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from labelloom.operators import hierarchy, merge_split
from labelloom.sources import detect, readers, writers


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_detect_format_and_layout(spark):
    listing = spark.createDataFrame(
        [
            ("y1", "data.yaml"), ("y2", "images/a.jpg"), ("y2", "labels/a.txt"), ("y3", "images/a.jpg"), ("y3", "deep/x.json"),
            ("c", "my_annotations.json"), ("c", "b.xml"), ("v", "ann/b.xml"), ("v", "t.csv"), ("g", "t.geojson"), ("g", "t.csv"),
            ("t", "t.csv"), ("t", "u.json"), ("j", "u.json"), ("n", "readme.md"),
            ("coco", "train2017/a.jpg"), ("coco", "val2017/b.jpg"), ("coco", "annotations/instances_train2017.json"), ("coco", "annotations/instances_val2017.json"),
            ("oi", "train/a"), ("oi", "validation/b"), ("oi", "test/c"), ("sn", "AOI_1/x"), ("ss", "train/a"), ("ss", "val/b"), ("ld", "Train/a"), ("ld", "Val/a"), ("ld", "Test/a"),
        ],
        "root string, rel string",
    )
    formats = {r.root: r.format for r in detect.detect_format(listing).collect()}
    assert [formats[k] for k in ("y1", "y2", "y3", "c", "v", "g", "t", "j", "n")] == ["yolo", "yolo", None, "coco", "voc", "geojson", "csv", "json", None]
    layouts = {r.root: r.layout for r in detect.detect_layout(listing).collect()}
    assert [layouts[k] for k in ("coco", "oi", "sn", "ss", "ld", "y1")] == ["coco", "open_images_v7", "spacenet", "seaships", "loveda", None]


def test_listing_and_conversion_format(spark, tmp_path):
    put(tmp_path / "d/a.JPG", b"x")
    put(tmp_path / "d/sub/b.png", b"yy")
    put(tmp_path / "d/c.txt", b"z")
    files = detect.list_files(spark, str(tmp_path / "d"), [".jpg", ".png"])
    assert rows(files, "rel", "length") == [("a.JPG", 1), ("sub/b.png", 2)]
    df = spark.createDataFrame([("coco", "x.xml"), (None, "my_yolo_set"), (None, "a/pascal.csv"), (None, "a.xml"), (None, "a.bin")], "l string, p string")
    got = [r.r for r in df.select(detect.conversion_format(F.col("l"), F.col("p")).alias("r")).collect()]
    assert got == ["coco_json", "yolo_txt", "pascal_voc", "pascal_voc", "coco_json"]


def test_read_yolo(spark, tmp_path):
    put(tmp_path / "labels/img1.txt", "0 0.5 0.5 0.2 0.4\n1 0.25 0.25 0.5 0.5\n\n7 0.5 0.5 1 1\nbad line\n0 0.1 0.1\n")
    put(tmp_path / "classes.txt", "car\n\nperson\n")
    got = rows(readers.read_yolo(spark, str(tmp_path)), "stem", "class_id", "class_name", "x1", "y2")
    assert got == [("img1", 0, "car", 0.4, 0.7), ("img1", 1, "person", 0.0, 0.5), ("img1", 7, "7", 0.0, 1.0)]
    unknown = readers.read_yolo(spark, str(tmp_path), unknown="unknown").where("class_id = 7").first()
    assert unknown.class_name == "unknown"


def coco_text():
    return json.dumps(
        {
            "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 0, "height": 10}],
            "annotations": [
                {"id": 5, "image_id": 1, "category_id": 3, "bbox": [10, 5, 20, 10], "area": 200, "iscrowd": 0, "segmentation": [[1, 2, 3, 4]]},
                {"id": 6, "image_id": 1, "category_id": 9, "bbox": [0, 0, 50, 25], "segmentation": []},
                {"id": 7, "image_id": 2, "category_id": 3, "bbox": [1, 1, 1, 1]},
                {"id": 8, "image_id": 99, "category_id": 3},
            ],
            "categories": [{"id": 3, "name": "car", "supercategory": "v"}],
        }
    )


def test_read_coco(spark, tmp_path):
    put(tmp_path / "instances.json", coco_text())
    got = {r.annotation_id: r for r in readers.read_coco(spark, str(tmp_path / "instances.json")).collect()}
    assert (got["5"].class_name, got["5"].geometry_type, got["5"].x1, got["5"].y2) == ("car", "segmentation", 0.1, 0.3)
    assert (got["6"].class_name, got["6"].geometry_type) == ("9", "bbox")
    assert got["7"].x1 is None and got["7"].y1 == 0.1
    assert got["8"].image_width is None and got["8"].x == 0.0


def test_read_voc_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "d/a.jpg", 100, 50), (2, "d/b.jpg", 10, 10)], "id long, file_path string, width int, height int")
    labels = spark.createDataFrame(
        [(1, "Car", None, 10.0, 5.0, 20.0, 10.0, i, 0, 0) for i in range(5)] + [(1, "Van", "x.van", 1.0, 1.0, 2.0, 2.0, 9, 0, 0)],
        "image_id long, label string, ontology_class string, x double, y double, width double, height double, id long, seq1 int, seq2 int",
    )
    docs = writers.voc_documents(labels, images)
    assert docs.where("filename = 'a.jpg'").count() == 1
    assert docs.select(F.sum(F.when(F.col("object").isNull(), 0).otherwise(F.size("object")))).first()[0] == 6
    writers.write_voc(docs, str(tmp_path / "voc"))
    back = readers.voc_annotations(spark.read.format("xml").option("rowTag", "annotation").schema(readers.VOC_SCHEMA).load(str(tmp_path / "voc")))
    assert back.count() == 6
    assert set(rows(back, "image_id", "class_name", "x", "width", "x2")) == {("a", "car", 10.0, 20.0, 0.3), ("a", "x.van", 1.0, 2.0, 0.03)}


def test_read_csv_alternatives(spark, tmp_path):
    put(tmp_path / "boxes.csv", "filename,class,xmin,y_min,xmax,y_max,width,height\na.jpg,car,10,5,30,15,100,50\n,car,1,1,2,2,10,10\nb.jpg,,1,1,2,2,0,10\n")
    got = rows(readers.read_csv(spark, str(tmp_path / "boxes.csv")), "filename", "class_name", "x1", "y2")
    assert got == [("a.jpg", "car", 0.1, 0.3), ("b.jpg", "unknown", None, 0.2)]


def test_read_open_images(spark, tmp_path):
    head = "ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax,IsOccluded\n"
    put(tmp_path / "oi.csv", head + "i1,x,/m/1,1,0.1,0.5,0.2,0.4,0\ni2,x,/m/2,0.7,0,1,0,1,0\nshort,row\n")
    put(tmp_path / "names.csv", "/m/1,Car\n")
    got = rows(readers.read_open_images(spark, str(tmp_path / "oi.csv"), str(tmp_path / "names.csv")), "image_id", "class_name", "x", "width", "height")
    assert got == [("i1", "Car", 0.1, 0.4, 0.2), ("i2", "/m/2", 0.0, 1.0, 1.0)]
    conf = {r.image_id: r.confidence for r in readers.read_open_images(spark, str(tmp_path / "oi.csv")).collect()}
    assert conf == {"i1": None, "i2": 0.7}


def test_json_and_geojson(spark, tmp_path):
    entry = {"file_name": "a.jpg", "width": 10, "height": 10, "annotations": [{"class": "car", "bbox": [1, 1, 2, 2], "bbox_format": "xywh_absolute"}, {"class_name": "van", "bbox": [0.1, 0.1, 0.2, 0.2]}]}
    put(tmp_path / "list.json", json.dumps([entry]))
    put(tmp_path / "held.json", json.dumps({"images": [entry]}))
    for name in ("list", "held"):
        got = rows(readers.read_json_images(spark, str(tmp_path / f"{name}.json")), "filename", "class_name", "x2")
        assert [(f, c, round(x, 9)) for f, c, x in got] == [("a.jpg", "car", 0.3), ("a.jpg", "van", 0.2)]
    feature = {"properties": {"filename": "g.tif", "class": "road", "bbox": [0, 0, 1, 1]}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 0]]]}}
    put(tmp_path / "Train/t.geojson", json.dumps({"features": [feature, {"properties": {"label": "x"}, "geometry": {"type": "Point"}}]}))
    put(tmp_path / "Val/v.geojson", json.dumps({"features": [feature]}))
    assert rows(readers.read_geojson(spark, str(tmp_path / "Val/v.geojson")), "filename", "class_name", "x2") == [("g.tif", "road", 1.0)]
    got = rows(readers.extract_loveda(spark, str(tmp_path)), "stem", "class_id", "cx", "cy", "w", "h", "split")
    assert got == [("t", 2, 2.0, 1.0, 4.0, 2.0, "train"), ("v", 2, 2.0, 1.0, 4.0, 2.0, "val")]


def test_corpora(spark, tmp_path):
    coco = tmp_path / "coco"
    for split in ("train", "val"):
        put(coco / f"annotations/instances_{split}2017.json", coco_text())
    got = rows(readers.extract_coco2017(spark, str(coco)).where("split = 'val'"), "stem", "class_id", "cx", "cy", "w", "h")
    assert got[0] == ("a", 0, 0.2, 0.2, 0.2, 0.2) and len(got) == 3
    vis = tmp_path / "vis"
    put(vis / "VisDrone2019-DET-train/annotations/i.txt", "10,20,4,8,1,4,0,0\n1,2,3\n1,1,2,2,1,99,0,0\n")
    put(vis / "VisDrone2019-DET-val/annotations/j.txt", "0,0,2,2,1,0,0,0\n")
    assert rows(readers.extract_visdrone(spark, str(vis)), "stem", "class_id", "cx", "split") == [("i", 3, 12.0, "train"), ("i", 11, 2.0, "train"), ("j", 0, 1.0, "val")]
    oi = tmp_path / "oi"
    put(oi / "class-descriptions-boxable.csv", "/m/1,Car\n/m/2,Van\n")
    put(oi / "train-annotations-bbox.csv", "ImageID,S,L,C,XMin,XMax,YMin,YMax,O\na,x,/m/2,1,0,1,0,1,0\nb,x,/m/1,1,2,4,0,1,0\n")
    put(oi / "val-annotations-bbox.csv", "ImageID,S,L,C,XMin,XMax,YMin,YMax,O\n")
    assert rows(readers.extract_open_images(spark, str(oi)), "stem", "class_id", "cx") == [("a", 1, 0.5)]
    sea = tmp_path / "sea"
    xml = "<annotation><filename>s1.jpg</filename><size><width>10</width><height>20</height></size><object><name>ship</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>6</ymax></bndbox></object></annotation>"
    put(sea / "train/s1.xml", xml)
    put(sea / "val/s2.xml", xml)
    assert rows(readers.extract_seaships(spark, str(sea)), "stem", "cx", "h", "split") == [("s1", 0.2, 0.2, "train"), ("s1", 0.2, 0.2, "val")]
    space = tmp_path / "space"
    ring = {"features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2]]]}}]}
    put(space / "train/t.geojson", json.dumps(ring))
    put(space / "val/v.geojson", json.dumps(ring))
    assert rows(readers.extract_spacenet(spark, str(space)), "stem", "class_id", "cx") == [("t", 0, 1.0), ("v", 0, 1.0)]


def test_documents(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps([{"document_id": "1", "name": "n", "category": "c", "extra": [1]}]))
    put(tmp_path / "b.json", json.dumps({"documents": [{"metadata": {"document_id": "2"}}]}))
    put(tmp_path / "c.json", "{broken")
    got = sorted((r.document_id or "", r.name or "", r.is_bad) for r in readers.read_documents(spark, str(tmp_path)).collect())
    assert got == [("", "", True), ("1", "n", False), ("2", "", False)]


def test_image_headers_of_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x06\0\0\0" + b"x" * 500
    bmp = b"BM" + b"\0" * 16 + struct.pack("<Ii", 33, -44) + b"\0" * 50
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 111, 222) + b"\x03"
    for name, data in (("a.png", png), ("b.bmp", bmp), ("c.jpg", jpeg), ("d.jpg", b""), ("e.png", b"\x89PNG")):
        put(tmp_path / name, data)
    got = {r.path.split("/")[-1]: (r.width, r.height) for r in readers.read_image_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (640, 480), "b.bmp": (33, 44), "c.jpg": (222, 111), "e.png": (None, None)}


@pytest.fixture
def small(spark):
    images = spark.createDataFrame(
        [(i, "ds0", f"ds0/img_{i}.jpg", 100, 50) for i in range(6)], "id long, dataset string, file_path string, width int, height int"
    )
    labels = spark.createDataFrame(
        [(i * 10 + k, i, "ds0", f"Class {k}", None, 10.0 * k, 5.0, 20.0, 10.0, k, 0, 0) for i in range(5) for k in range(3)],
        "id long, image_id long, dataset string, label string, ontology_class string, x double, y double, width double, height double, seq1 long, seq2 long, seq3 long",
    )
    return images, labels


def test_label_files_and_training_export(spark, small, tmp_path):
    images, labels = small
    assigned = merge_split.random_split(images, digits=2)
    lines = writers.label_lines(labels, images).join(assigned.select(F.col("id").alias("image_id"), "split"), "image_id")
    manifest = writers.write_training_export(lines, labels, str(tmp_path / "out"), "small")
    assert manifest.count() == 5 and manifest.where("size > 0 AND length(sha256) = 64").count() == 5
    written = spark.read.text(str(tmp_path / "out/labels"))
    assert written.count() == 15
    assert written.where("image_id = 2").count() == 3
    assert "0 0.100000 0.200000 0.200000 0.200000" in {r.value for r in written.collect()}
    names = {r.class_id: r.class_name for r in spark.read.json(str(tmp_path / "out/classes")).collect()}
    assert names == {0: "class_0", 1: "class_1", 2: "class_2"}
    assert spark.read.json(str(tmp_path / "out/dataset_info")).agg(F.sum("annotations")).first()[0] == 15
    assert "nc: 2" in writers.data_yaml(["a", "b"], ["train"], "/x")


def test_coco_canonical_and_rules(spark, small, tmp_path):
    images, labels = small
    numbered = writers.coco_images(images, F.floor(F.col("id") / 2))
    boxes = writers.coco_annotations(labels, numbered, ["id"], F.floor(F.col("id") / 20))
    assert rows(boxes, "coco_id")[-1] == (15,)
    sections = writers.coco_json(numbered, boxes, writers.coco_categories(labels))
    writers.write_coco(sections, str(tmp_path / "coco"))
    back = spark.read.json(str(tmp_path / "coco/section=annotations"))
    assert back.count() == 15 and back.where("size(bbox) = 4 AND area = 200").count() == 15
    writers.write_canonical(images, labels, str(tmp_path / "can"))
    tables = readers.read_canonical(spark, str(tmp_path / "can"))
    assert tables["images"].count() == 6 and tables["annotations"].where("class_id IS NOT NULL").count() == 15
    rules = spark.createDataFrame([("r1", "d", "Car", "v.car", "exact", 0.9, "1.0.0")], "rule_id string, dataset_name string, source_label string, canonical_value string, match_type string, confidence double, version string")
    writers.write_rules(rules, str(tmp_path / "rules"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "rules")).first().canonical_value == "v.car"
    with pytest.raises(ValueError):
        writers.write_rules(rules, str(tmp_path / "x"), "yaml")


def test_merged_labels_keep_bare_images(spark):
    images = spark.createDataFrame([("i/a.jpg",), ("i/b.png",)], "path string")
    labels = spark.createDataFrame([("l/a.txt", "0 1 1 1 1"), ("l/zz.txt", "1")], "path string, value string")
    assert rows(writers.merged_labels(labels, images), "stem", "labels") == [("a", "0 1 1 1 1"), ("b", "")]


def test_closure_and_cycles(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")], "node string, parent string")
    up = hierarchy.closure(chain.where("node LIKE 'n%'"))
    assert up.where("node = 'n0'").count() == 12
    assert up.where("node = 'n0' AND ancestor = 'n12'").first().distance == 12
    assert rows(hierarchy.cycles(chain), "node") == [("x",), ("y",), ("z",)]
    four = hierarchy.ancestors(chain)
    assert four.where("node = 'n0'").count() == 4
    assert rows(four.where("node = 'w'"), "ancestor", "distance") == [("x", 1), ("y", 2), ("z", 3)]


def test_jpeg_header_after_long_segments(spark):
    size = (480).to_bytes(2, "big") + (640).to_bytes(2, "big")
    exif = b"\xff\xe1" + (4002).to_bytes(2, "big") + b"\xff\xc0" * 2000
    frame = b"\x00\x11\x08" + size + b"\x03"
    bodies = [b"\xff\xd8" + exif + fill + b"\xff" + code + frame for code in (b"\xc0", b"\xc1", b"\xc2", b"\xcf") for fill in (b"", b"\xff\xff")]
    bodies += [b"\xff\xd8" + exif + b"\xff\xc4\x00\x04ab" + b"\xff\xda\x00\x02\xff\xc0" + frame, b"\xff\xd8", b"", None]
    files = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, content binary")
    got = {r.id: (r.width, r.height) for r in readers.image_headers(files).collect()}
    assert [got[i] for i in range(8)] == [(640, 480)] * 8
    assert [got[i] for i in range(8, 12)] == [(None, None)] * 4


def test_coco_files_keep_their_own_ids(spark, tmp_path):
    for name, width, kind in (("a", 100, "car"), ("b", 50, "ship")):
        put(tmp_path / f"{name}.json", json.dumps({
            "images": [{"id": 1, "file_name": f"{name}.jpg", "width": width, "height": 10}],
            "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 5, 5]}],
            "categories": [{"id": 1, "name": kind}],
        }))
    found = readers.read_coco(spark, str(tmp_path))
    assert rows(found, "file_name", "image_width", "class_name") and sorted(rows(found, "file_name", "image_width", "class_name")) == [("a.jpg", 100, "car"), ("b.jpg", 50, "ship")]


def test_visdrone_boxes_follow_image_sizes(spark, tmp_path):
    for split in ("train", "val"):
        put(tmp_path / f"VisDrone2019-DET-{split}/annotations/i.txt", "10,20,4,8,1,4,0,0\n")
    folder = tmp_path / "VisDrone2019-DET-train/images"
    folder.mkdir()
    (folder / "i.jpg").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + (240).to_bytes(2, "big") + (48).to_bytes(2, "big") + b"\x03")
    got = {r.split: (r.cx, r.cy, r.w, r.h) for r in readers.extract_visdrone(spark, str(tmp_path)).collect()}
    assert got == {"train": (0.25, 0.1, 4 / 48, 8 / 240), "val": (12.0, 24.0, 4.0, 8.0)}


def test_csv_documents(spark, tmp_path):
    put(tmp_path / "d.csv", 'document_id,name,category,note\nd1,First,air,"two\nlines"\nd2,,sea,\n')
    got = {r.document_id: r for r in readers.read_csv_documents(spark, str(tmp_path / "d.csv")).collect()}
    assert (got["d1"].name, got["d1"].category, json.loads(got["d1"].document)["note"]) == ("First", "air", "two\nlines")
    assert got["d2"].name is None and not got["d2"].is_bad
