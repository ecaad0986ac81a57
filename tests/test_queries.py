"""Queries against their SQL, and the entry module without the corpus operators."""

import importlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from idlattice.plans import queries as engine

from .conftest import ROOT, TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    def one(v):
        return "" if v is None else repr(round(v, 6) + 0.0).removesuffix(".0") if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", list(engine.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    cursor = con.execute(engine.SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = entry.queries()[name](spark, TINY)
    assert sorted(got.columns) == columns
    rows = [{k: float(v) if type(v).__name__ == "Decimal" else v for k, v in r.items()} for r in want]
    assert plain([r.asDict() for r in got.collect()], columns) == plain(rows, columns)
    assert want


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 3


def test_every_engine_query_is_registered():
    assert set(engine.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    subprocess.run(["cp", "-r", f"{ROOT}/idlattice", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "idlattice/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'q01_verdicts' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_corpus_operators():
    found = subprocess.run(["grep", "-rlE", "idlattice.llm|from \\.*llm", "--include=*.py", f"{ROOT}/idlattice", "--exclude-dir=llm"], capture_output=True, text=True).stdout
    assert not found
    assert importlib.import_module("idlattice.plans.pipeline")


def test_verification_of_the_corpus(spark):
    rows = engine.q29_full_verification(spark, TINY).collect()
    assert len(rows) == 120 and {r.final_decision for r in rows} >= {"Genuine", "Needs Manual Review"}
    assert all(0 <= r.fraud_risk_score <= 100 and 0 <= r.authenticity_score <= 100 for r in rows)


def test_candidates_of_all_types(spark):
    """The best candidate of a number or date is the field's value, for each type; ranks have no gaps and scores fall."""
    rows = engine.q16_candidate_ranks(spark, TINY).collect()
    docs = {r.doc_id: r for r in engine.corpus.documents(spark, TINY).collect()}
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.field_name), []).append((r["rank"], r.score, r.text))
    for own in by.values():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and all(a[1] >= b[1] for a, b in zip(own, own[1:], strict=False))
    assert {docs[k].kind for k, _ in by} == {"AADHAAR", "PAN", "PASSPORT", "DRIVING_LICENCE"}
    for field, column in (("pan_number", "number"), ("passport_number", "number"), ("dl_number", "number"), ("dob", "dob"), ("expiry", "expiry")):
        firsts = [(own[0][2], docs[k][column]) for (k, f), own in by.items() if f == field]
        assert firsts and all(a == b for a, b in firsts), field
