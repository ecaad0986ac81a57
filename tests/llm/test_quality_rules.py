import random
import re
from collections import Counter

import numpy as np
import pytest

from idlattice.llm import quality_rules as Q

from ..conftest import SMALL


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def brute_references(docs, rules):
    """Common words, and mean shares by language, in plain Python."""
    sums = {}
    for lang, text in docs:
        if lang is not None and not base(text)[5]:
            own = sums.setdefault(lang, [Counter(), Counter(), 0])
            words = lowered(text)
            for k, v in plain_classes(text).items():
                own[0][k] += v
            for w, v in Counter(words).items():
                own[1][w] += v / len(words)
            own[2] += 1
    sums = {x: own for x, own in sums.items() if own[2] >= rules.least_documents}
    common = {w for _, words, n in sums.values() for w, v in words.items() if v >= rules.common_share * n}
    out = {}
    for x, (classes, words, n) in sums.items():
        bins = {w: words[w] / n for w in common}
        out[x] = ({k: v / n for k, v in classes.items()}, bins | {None: 1 - sum(bins.values())})
    return common, out


def kind(c):
    for name, test in (("lower", "a" <= c <= "z"), ("upper", "A" <= c <= "Z"), ("digit", "0" <= c <= "9"), ("space", c in " \t\n\r\x0b\x0c"), ("point", c in ".,;:!?'\"()-"), ("symbol", c in "#*$%&|<>"), ("control", c < " " or c == "\x7f"), ("beyond", c >= "\x80")):
        if test:
            return name
    return "other"


def lowered(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain_classes(text):
    kinds = Counter(map(kind, text))
    return {k: v / sum(kinds.values()) for k, v in kinds.items()}


def plain_bins(text, common):
    bins = Counter(w if w in common else None for w in lowered(text))
    return {k: v / sum(bins.values()) for k, v in bins.items()}


def distance(p, q):
    total = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        total += (a * np.log2(a / m) if a else 0) + (b * np.log2(b / m) if b else 0)
    return (max(total, 0) / 2) ** 0.5


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rules = Q.Rules()
    common, known = brute_references([(r.lang, r.text) for r in docs], rules)
    assert len(known) == 4
    got = {r.doc_id: r for r in Q.op4_quality_rules(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want, row = base(r.text), got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == want
        kinds, bins = plain_classes(r.text), plain_bins(r.text, common)
        one, two = min(((distance(kinds, known[x][0]), distance(bins, known[x][1])) for x in sorted(known)), key=sum)
        assert row.class_distance == pytest.approx(one, abs=1e-6) and row.word_distance == pytest.approx(two, abs=1e-6)
        root = max(want[0], 1) ** 0.5
        assert row.kept == (not want[5] and one <= rules.class_limit + rules.class_slack / root and two <= rules.word_limit + rules.word_slack / root)


def test_clean_documents_stay_and_junk_goes(spark):
    got = Q.op4_quality_rules(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed")
    rows = got.groupBy("quality").agg({"*": "count", "kept": "count"}).collect()
    kept = {r.quality: r["count"] for r in got.where("kept").groupBy("quality").count().collect()}
    whole = {r.quality: r["count(1)"] for r in rows}
    assert kept[1] / whole[1] > 0.99 and kept.get(0, 0) / whole[0] < 0.15


def test_edges_of_the_input(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "word " * 60, "xx"), (4, "\n\n \t", "en"), (5, "the cat " * 100_000, "en"), (5, "the cat " * 100_000, "en"), (None, "é" * 30, "fr")]
    docs = spark.createDataFrame([(k, t, x, 0) for k, t, x in rows], "doc_id long, text string, lang string, kept int")
    got = Q.verdicts(docs, Q.references(docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.base_failed) for r in got) == sorted((str(k), *(base(t)[i] for i in (0, 4, 5))) for k, t, _ in rows)
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.verdicts(docs.limit(0), Q.NO_REFERENCES).count() == 0 and Q.references(docs.limit(0)) == Q.NO_REFERENCES and Q.keep_good(docs.limit(0)).count() == 0


def test_a_fifth_language(spark):
    """A language of the data gets its own reference; texts of one without a reference pass the comparison."""
    rng = random.Random(1)
    common = ["zu", "va", "ri", "mo", "ke", "lat", "in", "po"]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abdeiklmnoprstuv") for _ in range(7)) for _ in range(120))
    docs = [(k, r.text, r.lang) for k, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").collect())]
    own = [(10**6 + k, text(), "zz") for k in range(40)]
    few = [(2 * 10**6 + k, text(), "yy") for k in range(3)]
    rows = spark.createDataFrame(docs + own + few, "doc_id long, text string, lang string")
    known = Q.references(rows)
    assert known.languages == ["de", "en", "es", "fr", "zz"] and {b"zu", b"lat"} <= {*known.bins}
    got = {r.doc_id: r for r in Q.verdicts(rows, known).collect()}
    assert all(got[k].kept and got[k].language == "zz" for k, _, _ in own) and all(got[k].kept for k, _, _ in few)
    alone = Q.references(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.kept for r in Q.verdicts(spark.createDataFrame(own[:20], "doc_id long, text string, lang string"), alone).collect()}
    assert all(got.values())
    assert Q.keep_good(spark.createDataFrame(own[:20], "doc_id long, text string, lang string")).count() == 20


def test_repeated_words_in_large_vocabularies():
    words = [b"%d" % k for k in range(3000)] + [b"1", b"2", b"3", b"x"]
    assert Q.repeated_words(words) == 6 and Q.repeated_words([b"a"] * 5) == 5 and Q.repeated_words([b"a", b"b"]) == 0
