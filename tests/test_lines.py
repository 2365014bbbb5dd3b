"""Merged boxes: stated results, and what must hold of any."""

import numpy as np

from pagegrain.operators.lines import SAME_LINE, absorb, components
from pagegrain.plans import registry

DIR = "/root/testdata/sf0.001"


def row(y0, y1, n):
    return [[10 + 9 * i, y0, 18 + 9 * i, y1] for i in range(n)]


def test_long_row_is_one_component():
    assert components(np.array(row(20, 30, 260), float), 2).tolist() == [[10, 20, 2349, 30]]


def test_two_rows_stay_two():
    boxes = np.array(row(20, 30, 130) + row(44, 54, 130), float)
    for merge in (components, absorb):
        assert merge(boxes, 2).tolist() == [[10, 20, 1179, 30], [10, 44, 1179, 54]]


def test_gap_and_height_keep_boxes_apart():
    assert len(absorb(np.array([[0, 0, 10, 10], [13, 0, 20, 10]], float), 2)) == 2
    assert len(absorb(np.array([[0, 0, 10, 10], [11, 7, 20, 17]], float), 2)) == 2
    assert absorb(np.array([[0, 0, 10, 10]] * 2, float), 0).tolist() == [[0, 0, 10, 10]]


def test_merged_pages_hold_every_box_and_merge_no_further(spark):
    from pagegrain.sources.tables import boxes

    out = {}
    for r in registry.queries()["q_merge_boxes"](spark, DIR).collect():
        out.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    for r in boxes(spark, DIR).collect():
        assert any(b[0] <= r.x0 and b[1] <= r.y0 and b[2] >= r.x1 and b[3] >= r.y1 for b in out[r.page])
    for found in out.values():
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                height = min(a[3], b[3]) - max(a[1], b[1])
                line = height >= SAME_LINE * max(1, min(a[3] - a[1], b[3] - b[1]))
                assert not (line and max(a[0], b[0]) - min(a[2], b[2]) <= 4)


def test_page_shift_of_stated_sizes(spark):
    from pagegrain.operators.alignment import page_shift

    sizes = "doc long, page long, width double, height double"
    own = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 1200.0, 800.0)], sizes)
    payload = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 1200.0, 800.0)], sizes)
    assert sorted((r.page, r.target) for r in page_shift(payload, own).collect()) == [(1, 0), (2, 1)]
    assert page_shift(payload, own.where("false")).where("target is not null").count() == 0
