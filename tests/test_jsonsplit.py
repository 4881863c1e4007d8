"""Splitting of JSON documents against reading them whole."""

import json
import random

import pytest

from labelloom.sources import jsonsplit, readers

NASTY = ['}', '{', '"', '\\', '\\"', '[', ']', '"}', '{"a":[', '],"images":[', "é", "日本", "\n", " ", ":", ",", "x" * 30, "\\\\", '}}}', '\\}"']


def value(pick, depth):
    kind = pick.random()
    if depth and kind < 0.25:
        return {nasty(pick): value(pick, depth - 1) for _ in range(pick.randint(0, 3))}
    if depth and kind < 0.5:
        return [value(pick, depth - 1) for _ in range(pick.randint(0, 3))]
    return pick.choice([None, True, 1.5, -7, nasty(pick), nasty(pick)])


def nasty(pick):
    return "".join(pick.choice(NASTY) for _ in range(pick.randint(0, 5)))


def element(pick):
    return {nasty(pick): value(pick, 3) for _ in range(pick.randint(0, 4))}


def document(pick, rows):
    parts = {nasty(pick) + str(k): pick.choice([value(pick, 2), {"deep": [element(pick)]}, 3, "t"]) for k in range(pick.randint(0, 3))}
    lists = {f"{nasty(pick)}list{k}": [element(pick) for _ in range(pick.randint(0, rows))] for k in range(3)}
    items = [*parts.items(), *lists.items()]
    pick.shuffle(items)
    return dict(items)


def expected(doc):
    if isinstance(doc, list):
        return sorted(json.dumps(["", e], sort_keys=True) for e in doc if isinstance(e, (dict, list)))
    return sorted(json.dumps([k, e], sort_keys=True) for k, v in doc.items() if isinstance(v, list) for e in v if isinstance(e, (dict, list)))


def cut(raw, sizes):
    """Elements of ``raw`` read in blocks that end after the first brace past each size."""
    borders, at = [0], 0
    for size in sizes:
        at = raw.find(b"}", at + size) + 1
        if at <= 0 or at >= len(raw):
            break
        borders.append(at)
    blocks = [raw[a:b] for a, b in zip(borders, [*borders[1:], len(raw)], strict=True)]
    state, found, pieces = jsonsplit.START, [], {}
    import numpy as np

    for start, block in zip(borders, blocks, strict=True):
        cases = []
        for inside in (False, True):
            case = jsonsplit.Summary(inside)
            middle = block.find(b"}", len(block) // 2) + 1
            for part in (block[:middle], block[middle:]):
                case.add(np.frombuffer(part, dtype=np.uint8))
            cases.append(case.text())
        cutter = jsonsplit.Cutter(start, json.loads(json.dumps(state)))
        for name, text, first in [*cutter.add(block[:middle]), *cutter.add(block[middle:]), *cutter.close()]:
            if first is None:
                found.append((name, text))
            else:
                pieces.setdefault(first, [name, b""])[1] += text
        state = jsonsplit.advance(state, start, *cases)
    found += [tuple(p) for p in pieces.values()]
    return sorted(json.dumps([name, json.loads(text)], sort_keys=True) for name, text in found)


@pytest.mark.parametrize("seed", range(60))
def test_cuts_anywhere(seed):
    pick = random.Random(seed)
    doc = document(pick, 12) if seed % 4 else [element(pick) for _ in range(20)]
    raw = json.dumps(doc, ensure_ascii=bool(seed % 2), indent=[None, 2][seed % 3 == 0]).encode()
    for size in (1, 7, 40, 300, 10**9):
        assert cut(raw, [pick.randint(1, size) for _ in range(len(raw))]) == expected(doc)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("states", [jsonsplit.BROADCAST_STATES, 0])
def test_elements_of_files(spark, tmp_path, small_splits, monkeypatch, states):
    monkeypatch.setattr(jsonsplit, "BROADCAST_STATES", states)
    docs = {}
    for k in range(6):
        pick = random.Random(1000 + k)
        docs[f"{k}.json"] = document(pick, 40) if k != 2 else [element(pick) for _ in range(30)]
        (tmp_path / f"{k}.json").write_text(json.dumps(docs[f"{k}.json"]) + "\n" * (k % 2), encoding="utf-8")
    found = {}
    for row in jsonsplit.read_elements(spark, str(tmp_path)).collect():
        found.setdefault(row.source_file.split("/")[-1], []).append(json.dumps([row.section or "", json.loads(row.element)], sort_keys=True))
    assert {k: sorted(v) for k, v in found.items()} == {k: e for k, v in docs.items() if (e := expected(v))}
    assert jsonsplit.fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def coco(n):
    boxes = [
        {"id": i, "image_id": i % 50, "category_id": i % 4, "bbox": [i, 1, 2.5, 3], "segmentation": [[1, 2]] if i % 3 else [], "note": '}]"{' * (i % 2)} for i in range(n)
    ]
    images = [{"id": i, "file_name": f"{i}}}.jpg", "width": 100, "height": i} for i in range(50)]
    return {"info": {"images": [{"id": 1}]}, "images": images, "annotations": boxes, "categories": [{"id": i, "name": f"c{i}"} for i in range(3)]}


def test_readers_agree(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps(coco(200)))
    path = str(tmp_path / "a.json")
    whole, split = readers.read_coco(spark, path, split=False), readers.read_coco(spark, path)
    assert split.columns == whole.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 200
    entry = [{"filename": f"{i}.jpg", "width": 10, "height": 10, "annotations": [{"class": "}", "bbox": [1, 1, 2, i]}]} for i in range(60)]
    for name, doc in (("list.json", entry), ("held.json", {"images": entry})):
        (tmp_path / name).write_text(json.dumps(doc))
        path = str(tmp_path / name)
        assert sorted(map(str, readers.read_json_images(spark, path).collect())) == sorted(map(str, readers.read_json_images(spark, path, split=False).collect()))
    features = [{"properties": {"filename": f"{i}", "class": "r]", "bbox": [0, 0, 1, i]}, "geometry": {"type": "Point", "coordinates": []}} for i in range(60)]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    path = str(tmp_path / "g.geojson")
    assert sorted(map(str, readers.read_geojson(spark, path).collect())) == sorted(map(str, readers.read_geojson(spark, path, split=False).collect()))
