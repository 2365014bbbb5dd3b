"""Records out of damaged JSON, by stated results."""

import json

from pagegrain.functions import recovery

A, B = {"text": "a", "bbox": [1, 2, 3, 4]}, {"text": "b", "bbox": [5, 6, 7, 8]}
ITEMS = json.dumps([A, B])


def test_whole_texts():
    assert recovery.from_text(ITEMS) == [A, B]
    assert recovery.from_text(json.dumps({"page": 1, "results": {"items": [A]}})) == [A]
    assert recovery.from_text(json.dumps(A)) == [A]
    assert recovery.from_text(f"```json\n{ITEMS}\n```") == [A, B]
    assert recovery.from_text(f"Here they are: {ITEMS} and no more") == [A, B]
    for text in ("", "plain", "[1, 2]", "{", '"', "[[[[[["):
        assert recovery.from_text(text) == []


def test_cut_texts():
    for cut in range(len(ITEMS)):
        want = [A] if cut >= len(json.dumps(A)) + 1 else []
        assert recovery.from_text(ITEMS[:cut])[: len(want)] == want
        assert len(recovery.from_text(ITEMS[:cut])) == len(want) + (cut >= len(ITEMS) - 1)


def test_parts():
    assert recovery.from_parts(f"{json.dumps(A)} then {json.dumps(B)}") == [A, B]
    assert recovery.from_parts("{'text': 'a', 'bbox': (1, 2)} {broken") == [{"text": "a", "bbox": (1, 2)}]
    assert recovery.from_parts('"{" {\'text\': \'}\'}') == []
    assert len(recovery.from_parts(json.dumps([A] * 1200))) == recovery.MOST


def test_depth():
    deep = A
    for _ in range(4):
        deep = {"data": deep}
    assert recovery.records(deep) == [A]
    assert recovery.records({"data": deep}) == []


def test_column(spark):
    rows = spark.createDataFrame([(ITEMS,), ("",), (None,), ("no",)], "t string").select(recovery.recovered("t")).collect()
    assert [[json.loads(v) for v in r[0]] if r[0] is not None else None for r in rows] == [[A, B], None, None, None]
