"""The verification's work: dealt to all cores, and done once a page where it can be."""

import pyarrow as pa
from pyspark.sql import functions as F

from idlattice.operators import boxes
from idlattice.plans import corpus

from .conftest import TINY

WORDS = pa.list_(pa.struct([("text", pa.string()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("conf", pa.float64())]))


def word(text, left, top, conf=0.9):
    return {"text": text, "left": left, "top": top, "width": 48, "height": 20, "conf": conf}


def test_documents_of_a_small_file_are_dealt_to_all_cores(spark):
    tasks = corpus.documents(spark, TINY).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 150 and len({r.task for r in tasks}) >= spark.sparkContext.defaultParallelism


def test_words_are_cleaned_once_a_page(monkeypatch):
    """However many values are looked up on a page, each of its words is cleaned once, and each value once."""
    seen = []
    clean = boxes.alike
    monkeypatch.setattr(boxes, "alike", lambda t: seen.append(t) or clean(t))
    page = [word(f"W{i}", 60 * (i % 5), 40 * (i // 5)) for i in range(20)]
    values = [f"W{i} W{i + 1}" for i in range(15)] * 2
    got = boxes.locate_all.func(pa.array([values, None], pa.list_(pa.string())), pa.array([page, page], WORDS)).to_pylist()
    assert len(seen) == 20 + 15 + 20
    assert got[1] == [] and got[0] == [boxes.locate(v, page, boxes.page_lines(page)) for v in values] and got[0][0] == {"x": 0, "y": 0, "w": 108, "h": 20}


def test_values_of_columns_in_python():
    column = pa.array([[word("A", 1, 2), word(None, None, 4, None)], None, [], [word("B", 5, 6)]], WORDS)
    texts = pa.array([["a", None], None, [], ["b"]], pa.list_(pa.string()))
    for begin in range(4):
        for c in (column.slice(begin), texts.slice(begin, 2)):
            assert boxes.plain(c) == c.to_pylist()


def test_boxes_of_more_pages_than_are_read_at_once(monkeypatch):
    pages = pa.array([[word("2000", 0, 10), word("0007", 60, 10, None), word(f"{9195 + k}", 120, 10)] if k % 7 else None for k in range(20)], WORDS)
    fields = pa.array([[{"field": "aadhaar_number", "value": f"20000007{9195 + k}", "anchors": ["no"]}, {"field": "name", "value": "NOT_FOUND", "anchors": []}] for k in range(20)], pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("anchors", pa.list_(pa.string()))])))
    whole = [f.func(*a).to_pylist() for f, a in ((boxes.map_all, (fields, pages)), (boxes.digit_runs_of, (pages,)))]
    assert whole[0][1] == [{"x": 0, "y": 10, "w": 168, "h": 20}, None] and whole[1][1][0]["text"] == "200000079196" and whole[0][7] == [None, None]
    monkeypatch.setattr(boxes, "PAGES_AT_ONCE", 3)
    assert [f.func(*a).to_pylist() for f, a in ((boxes.map_all, (fields, pages)), (boxes.digit_runs_of, (pages,)))] == whole
