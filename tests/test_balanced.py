"""Split that balances every label."""

import random

from labelloom.operators import merge_split


def test_every_label_has_the_ratios(spark):
    pick = random.Random(6)
    names = [f"k{i}" for i in range(14)]
    pictures = [(i, "ds0", f"{i}.jpg", 10, 10) for i in range(4000)]
    # label k has about 2000 / 1.7**k images; an eighth of the images have none
    carried = {i: [n for k, n in enumerate(names) if pick.random() < 0.5 / 1.7**k] if i % 8 else [] for i in range(4000)}
    boxes = [(i, n, None, 100 * i + k) for i, own in carried.items() for k, n in enumerate(own)]
    images = spark.createDataFrame(pictures, "id long, dataset string, file_path string, width int, height int")
    labels = spark.createDataFrame(boxes, "image_id long, label string, ontology_class string, id long")
    split = {r.id: r.split for r in merge_split.balanced_split(images, labels, 0.7, 0.2, 0.1).collect()}
    sizes = {s: list(split.values()).count(s) for s in ("train", "validation", "test")}
    assert sizes == {"train": 2800, "validation": 800, "test": 400}
    for name in names:
        own = [split[i] for i, c in carried.items() if name in c]
        for part, ratio in (("train", 0.7), ("validation", 0.2), ("test", 0.1)):
            # within four images, or two in a hundred, of the label's share
            assert abs(own.count(part) - ratio * len(own)) <= max(4, 0.02 * len(own)), (name, part, own.count(part), len(own))
    again = {r.id: r.split for r in merge_split.balanced_split(images.repartition(5), labels.repartition(3), 0.7, 0.2, 0.1).collect()}
    assert again == split
