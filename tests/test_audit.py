import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from idlattice.sources import audit, readers

ROW = "'t' timestamp, '{}' document_hash, '' file_path, 'PAN' document_type, 1 risk_score, 'Genuine' verdict, '{{}}' extracted_fields, '1' pipeline_version"


def rows(spark, name, n=5, parts=3):
    return spark.range(0, n, 1, parts).selectExpr(*ROW.format(name).split(", "))


def logged(spark, path):
    return [(r.id, r.document_hash) for r in readers.audit(spark, path).collect()]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "audit")
    with ThreadPoolExecutor(6) as pool:
        assert all(pool.map(lambda k: audit.append_audit(rows(spark, f"w{k}"), path), range(12)))
    found = logged(spark, path)
    assert [i for i, _ in found] == list(range(60, 0, -1))
    for k in range(12):
        own = sorted(i for i, h in found if h == f"w{k}")
        assert own == list(range(own[0], own[0] + 5))  # a batch's ids are together


def test_a_batch_writer_a_stream_and_a_restarted_stream(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit.append_audit(rows(spark, "a"), path) and audit.append_audit(rows(spark, "b"), path)
    for query in ("first", "second"):  # a new checkpoint counts from 0 again
        for batch in (0, 1):
            assert audit.append_audit(rows(spark, f"{query}{batch}"), path, batch, query)
        assert not audit.append_audit(rows(spark, "again"), path, 1, query)
    assert not audit.append_audit(rows(spark, "late"), path, 0, "first")
    found = logged(spark, path)
    assert [i for i, _ in found] == list(range(30, 0, -1)) and {h for _, h in found} == {"a", "b", "first0", "first1", "second0", "second1"}


def test_rows_without_a_commit_are_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    audit.append_audit(rows(spark, "a"), path)
    with monkeypatch.context() as m:
        m.setattr(audit.Log, "put", lambda *_: (_ for _ in ()).throw(OSError("the writer died")))
        with pytest.raises(OSError, match="died"):
            audit.append_audit(rows(spark, "lost"), path, 0, "q")
    assert audit.append_audit(rows(spark, "b"), path, 0, "q")
    assert [h for _, h in logged(spark, path)] == ["b"] * 5 + ["a"] * 5
    assert len(os.listdir(f"{path}/rows")) == 3


def test_commits_by_rename(spark, tmp_path, monkeypatch):
    """The way of stores that aren't mounted."""
    monkeypatch.setattr(audit.Log, "linked", lambda self, draft, name: self.renamed(*(self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}") for n in (draft, name))))
    path = str(tmp_path / "audit")
    assert audit.append_audit(rows(spark, "a"), path) and audit.append_audit(rows(spark, "b"), path)
    assert audit.Log(spark, path).put(2, {"next": 1}) is False
    assert [i for i, _ in logged(spark, path)] == list(range(10, 0, -1))


def test_empty_batches_count_as_logged(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit.append_audit(rows(spark, "a", 0), path, 0, "q") and not audit.append_audit(rows(spark, "a"), path, 0, "q")
    assert audit.append_audit(rows(spark, "b", 2), path, 1, "q")
    assert logged(spark, path) == [(2, "b"), (1, "b")]
