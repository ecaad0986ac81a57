"""Pictures of passports: dealt to tasks and read as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from idlattice.operators.pixels import grey_values
from idlattice.plans import corpus, passports

from .conftest import TINY


def test_pictures_of_a_small_file_are_dealt_to_all_cores(spark):
    """Keys of all pictures fit one block of a file; drawn where they are read, one task would have them all."""
    pictures = corpus.passport_pictures(spark, TINY)
    tasks = pictures.select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 30 and len({r.task for r in tasks}) >= spark.sparkContext.defaultParallelism


def test_more_pictures_than_are_given_out_at_once(spark, monkeypatch):
    whole = {r.doc_id: r for r in corpus.passport_pictures(spark, TINY).collect()}
    monkeypatch.setattr(corpus, "PICTURES_AT_ONCE", 1)
    assert {r.doc_id: r for r in corpus.passport_pictures(spark, TINY).collect()} == whole
    assert all(len(r.pixels) % r.width == 0 and r.width in (120, 240) for r in whole.values())


def test_grey_values_are_views_of_the_column():
    column = pa.array([[1, 2, 3], None, [], [4, 255]], pa.list_(pa.int32()))
    for begin in range(4):
        got = list(grey_values(column.slice(begin)))
        assert [None if a is None else a.tolist() for a in got] == column.slice(begin).to_pylist()
        assert all(a is None or isinstance(a, np.ndarray) for a in got)


def test_readings_stand_beside_columns_of_any_type(spark):
    """Reading keeps the other columns as they are; a null content and a reading without words are null."""
    rows = spark.createDataFrame([(1, [7, 8], bytearray(b"P5 1 1 255\n\xff")), (2, None, None), (3, [], bytearray(b"P5 2 1 255\nAB"))], "doc_id long, pixels array<int>, content binary")
    got = {r.doc_id: r for r in passports.with_ocr(rows, corpus.read_letters).collect()}
    assert [got[k].pixels for k in (1, 2, 3)] == [[7, 8], None, []]
    assert got[1].word_map is None and got[1].ocr_raw_text == "" and got[1].ocr_confidence == 0.9
    assert got[2].ocr_raw_text is None and got[2].ocr_confidence is None and got[2].word_map is None
    assert [w.asDict() for w in got[3].word_map] == [{"text": "AB", "left": 0, "top": 0, "width": 2, "height": 1, "conf": 0.9}]
