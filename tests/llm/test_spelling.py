import random
import re
import zlib
from collections import Counter

import pytest

from idlattice.llm import spelling

from ..conftest import TINY


def plain_words(docs, least_length=6, least_count=5):
    """Each run by itself, in plain Python."""
    counts = Counter()
    for key, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            k = h % len(run)
            counts[run if h % 199 else run[:k] + run[k + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_near(words):
    """All pairs, by cutting one code point out of each word."""
    cuts = {w: [w[:k] + w[k + 1 :] for k in range(len(w))] for w in words}
    near = {w: set() for w in words}
    for a in words:
        for b in words:
            if a != b and (b in cuts[a] or a in cuts[b] or (len(a) == len(b) and any(x == y for x, y in zip(cuts[a], cuts[b], strict=True)))):
                near[a].add(b)
    return near


def plain_variants(words, times=5):
    near = plain_near(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.op11_spelling(spark, TINY).collect()} == plain_variants(plain_words(docs))


@pytest.mark.parametrize("most", [3, 1000])
def test_words_that_are_close_to_many(spark, most):
    """Small limits deal groups again, down to single code points; nothing is lost."""
    rng = random.Random(most)
    words = {}
    for base in ("aaaaaa", "abcabcab", "prefixprefix", "éêàéêà"):
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice(["", "a", "b", "ab", "ÿ"])
            if len(w := "".join(w)) >= 5:
                words[w] = rng.choice([5, 9, 30, 200, 1100])
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    near = plain_near(words)
    pairs = [(r.a, r.a_n, r.b, r.b_n) for r in spelling.near_pairs(counted, 5, most).collect()]
    assert sorted(pairs) == sorted((a, words[a], b, words[b]) for a in words for b in near[a] if a < b)
    assert {tuple(r) for r in spelling.variants(counted, 5, 5, most).collect()} == plain_variants(words)


def test_short_words(spark):
    words = {w: 5 for w in ("ab", "abc", "ac", "bc", "abd", "bé", "zz")}
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    near = plain_near(words)
    assert sorted((r.a, r.b) for r in spelling.near_pairs(counted, 2, 1).collect()) == sorted((a, b) for a in words for b in near[a] if a < b)


def test_forms_follow_to_the_last(spark):
    counted = spark.createDataFrame([("letter", 625), ("lettr", 125), ("lttr", 25), ("ltr", 5), ("lt", 1), ("alone", 7)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(counted, 5, 2).collect()}
    assert got == {"letter": (None, "letter", 1), "lettr": ("letter", "letter", 2), "lttr": ("lettr", "letter", 2), "ltr": ("lttr", "letter", 2), "lt": ("ltr", "letter", 1), "alone": (None, "alone", 0)}


def test_ties_take_the_least_word(spark):
    counted = spark.createDataFrame([("abcdef", 5), ("abcdeg", 50), ("abcdeé", 50), ("abcde", 50)], "word string, n long")
    assert {r.word: r.form for r in spelling.variants(counted, 5, 5).collect()}["abcdef"] == "abcde"


def test_edges_of_the_input(spark):
    schema = "text string, doc_id long, word string, n string, path string, run string"
    texts = [(None, 1), ("", 2), ("Straße STRASSE " * 3, None), ("straße " * 2, 4), ("wörter " * 40_000, 5), ("straße " * 2, 4), ("123 !? ĀĀ", 6)]
    docs = spark.createDataFrame([(t, k, "w", "n", "p", "r") for t, k in texts], schema)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == plain_words([(k, t) for t, k in texts])
    assert spelling.words(docs.limit(0)).count() == 0
    empty = spelling.variants(spelling.words(docs.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
