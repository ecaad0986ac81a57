import hashlib
import re
import time

import pytest

from idlattice.llm import decontamination as D

from ..conftest import SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((key, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in D.op5_decontamination(spark, SMALL).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


TEXT = "a b c d e f g h i j k l"
DOCS = [(1, f"x {TEXT} y"), (2, "A, b-C d!e f g H i j"), (3, "short one here"), (4, None), (5, ""), (6, "b c"), (7, TEXT.upper() + " " + TEXT), (7, TEXT.upper() + " " + TEXT), (None, TEXT), (8, "z " * 50_000 + TEXT)]
ITEMS = [(10, TEXT), (11, "Short; One"), (12, ""), (13, None), (14, TEXT), (None, "y z z"), (2, "B c d e f g h i j k")]


@pytest.mark.parametrize("limits", [{}, {"most_grams": 1}, {"most_anchors": 1}])
def test_edges_of_the_input(spark, limits):
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in DOCS], "doc_id long, text string, w string, gram int")
    items = spark.createDataFrame([(k, t, "o") for k, t in ITEMS], "item_id long, text string, offset string")
    assert sorted((tuple(r) for r in D.report(docs, items, **limits).collect()), key=str) == brute(DOCS, ITEMS)
    assert D.report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.report(docs, items.limit(0), **limits).collect()} == {0}


def test_removal(spark):
    docs = spark.createDataFrame([(k, t, "w") for k, t in DOCS], "doc_id long, text string, anchor string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = D.remove(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, None], key=str)
    cut = {r.doc_id: r.text for r in D.remove(docs, items, "spans").collect()}
    assert cut[1] == "x y" and cut[2] == "" and cut[3] == "here" and cut[4] is None and cut[6] == "b c" and cut[None] == ""
    with pytest.raises(ValueError):
        D.remove(docs, items, "else")


def test_plan_is_native(spark):
    plan = D.op5_decontamination(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("part", [1, 7, 200])
def test_parts_lose_no_window(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART", part)
    docs = spark.createDataFrame(DOCS[:9], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in D.report(docs, items).collect()), key=str) == brute(DOCS[:9], ITEMS)


def test_common_anchor_in_a_long_text(spark):
    """The work is linear: a text of 500,000 words, half of them an anchor, takes seconds."""
    docs = spark.createDataFrame([(1, "the cat " * 250_000 + "so the"), (2, "none")], "doc_id long, text string")
    begin = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit) for r in D.report(docs, spark.createDataFrame([(1, "so the")], "item_id long, text string")).collect()}
    assert got == {1: (500_002, 2), 2: (1, 0)} and time.perf_counter() - begin < 60
