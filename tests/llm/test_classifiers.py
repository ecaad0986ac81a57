import numpy as np
import pytest
from pyspark.sql import functions as F

from idlattice.llm import language_id, quality_classifier, toxicity

D = "/root/testdata/sf0.1"
EDGES = [(1, None, "en", None), (2, "", None, "s"), (3, "word " * 100_000, "en", "s"), (3, "word " * 100_000, "en", "s"), (None, "the end", "xx", "t"), (4, " \n\t", "en", "s")]


def held(spark, query, label):
    rows = query(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([(r.score, r.predicted, r[label]) for r in rows])


def test_toxicity_on_held_out_documents(spark):
    got = held(spark, toxicity.op6_toxicity, "toxic")
    assert len(got) > 500 and (got[:, 1] == got[:, 2]).mean() > 0.97
    assert got[got[:, 2] == 1, 1].mean() > 0.85 and got[got[:, 2] == 0, 1].mean() < 0.01


def test_quality_on_held_out_documents(spark):
    got = held(spark, quality_classifier.op7_quality_classifier, "quality")
    assert (got[:, 1] == got[:, 2]).mean() > 0.97
    assert got[got[:, 2] == 1, 1].mean() > 0.99 and got[got[:, 2] == 0, 1].mean() < 0.15


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(4), 0.0, rng.normal(size=(2, 2)), np.zeros(3))
    scores = rng.normal(size=7)
    starts = np.array([0, 4, 5])
    want = []
    for a, b in ((0, 4), (4, 5), (5, 7)):
        n = b - a
        weights = np.zeros((2,) * n)
        for labels in np.ndindex(*weights.shape):
            e = sum(scores[a + k] for k in range(n) if labels[k]) + sum(field.moves[labels[k], labels[k + 1]] for k in range(n - 1))
            weights[labels] = np.exp(e)
        weights /= weights.sum()
        want += [weights.take(1, axis=k).sum() for k in range(n)]
    assert field.marginals(scores, starts) == pytest.approx(want)


def test_chains_are_sentences_of_any_length():
    ends = np.zeros(300, bool)
    ends[[10, 150]] = True
    assert toxicity.chains(ends, np.array([200, 0, 100])).tolist() == [0, 11, 151, 200]


def test_long_chains_keep_their_messages():
    """A chain alone and the same chain among others have equal marginals; its ends feel each other through all of it."""
    rng = np.random.default_rng(3)
    field = toxicity.Field(np.zeros(4), 0.0, np.array([[8.0, 0.0], [0.0, 8.0]]), np.zeros(3))
    scores = rng.normal(size=3000) * 0.01
    scores[0] = 40
    alone = field.marginals(scores, np.array([0]))
    five = field.marginals(np.tile(scores, 5), np.arange(5) * 3000)
    assert five == pytest.approx(np.tile(alone, 5)) and alone[100] > alone[2000] + 0.05


def brute_score(field, text):
    """A document's score with its chains' marginals by enumeration of all labellings."""
    tokens, top, total = text.split(), 0.0, 0.0
    sentences, begin = [], 0
    for k, t in enumerate(tokens):
        if t.endswith(toxicity.FINAL) or k == len(tokens) - 1:
            sentences.append(tokens[begin : k + 1])
            begin = k + 1
    for own in sentences:
        weight = [field.bias + sum(field.weights[f] for f in toxicity.own_features(t)) for t in own]
        for k in range(len(own) - 1):
            weight[k + 1] += field.weights[toxicity.near_feature(own[k], "before")]
            weight[k] += field.weights[toxicity.near_feature(own[k + 1], "after")]
        mass = np.zeros((len(own), 2))
        for labels in np.ndindex(*(2,) * len(own)):
            e = np.exp(sum(w for w, y in zip(weight, labels, strict=True) if y) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            for k, y in enumerate(labels):
                mass[k, y] += e
        p = mass[:, 1] / mass.sum(axis=1)
        top, total = max(top, p.max()), total + p[p > 0.05].sum()
    top = min(max(top, 1e-4), 1 - 1e-4)
    z = field.fold @ [1, np.log(top / (1 - top)), np.log1p(total)]
    return 1 / (1 + np.exp(-z))


def test_document_scores_equal_enumeration(spark):
    rng = np.random.default_rng(4)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS) * 0.3, -0.5, rng.normal(size=(2, 2)), np.array([-1.0, 0.7, 0.5]))
    words = "you are a clown and the worst. idiot! Of it? so".split()
    texts = [" ".join(rng.choice(words, size=n)) for n in (1, 3, 7, 12, 12, 12)]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()
    assert [r.score for r in sorted(rows)] == pytest.approx([brute_score(field, t) for t in texts])


def test_spans_are_character_offsets():
    text = "You utter  idiot clown, go"
    assert toxicity.spans(text, np.array([0, 0, 0.9, 0.7, 0])) == [{"start": 11, "stop": 23, "p": 0.9}]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(k, t, x) for k, t, x, _ in EDGES], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit([], [])).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, t, x) for k, t, x, _ in EDGES], "doc_id long, text string, features string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.train(docs.limit(0), labels) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}


def test_class_prior_is_found():
    rng = np.random.default_rng(2)
    positive, corpus = rng.normal(0, 1, (2000, 5)), np.concatenate((rng.normal(0, 1, (2000, 5)), rng.normal(3, 1, (800, 5))))
    halves = [rng.random((len(x), 6)) < 0.5 for x in (positive, corpus)]
    found = quality_classifier.halvings(positive, halves[0], corpus, halves[1])
    shares = [(h.net.probability(corpus[~halves[1][:, k]])[:, None] >= h.cuts).mean(axis=0) for k, h in enumerate(found)]
    assert quality_classifier.class_prior(found, shares) == pytest.approx(2000 / 2800, abs=0.04)


def test_shares_are_counted_over_all_documents(spark):
    """The distributed counts equal a plain loop over every document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", quality_classifier.fitted_half(F.col("doc_id")).alias("half")).collect()
    x = np.array([quality_classifier.features((r.text or "").encode()) for r in rows])
    half = np.array([r.half for r in rows])
    yes = np.arange(len(rows)) % 3 == 0
    found = quality_classifier.halvings(x[yes], half[yes], x, half)
    for k, (h, share) in enumerate(zip(found, quality_classifier.shares_above(docs, found, "text", "doc_id"), strict=True)):
        scores = [h.net.probability(v[None])[0] for v in x[~half[:, k]]]
        assert share == pytest.approx([sum(s >= c - 1e-12 for s in scores) / len(scores) for c in h.cuts], abs=0.03)


def test_gradient_of_the_risk():
    """The net's gradient equals differences of the risk, in both of its cases."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(size=(40, 6)), rng.normal(size=(50, 6)) + 0.5
    net = quality_classifier.Net.start(np.concatenate((p, u)), rng)
    zp, zu = net.scaled(p), net.scaled(u)
    for prior in (0.2, 0.9):
        def second(prior=prior):
            return quality_classifier.softplus(net.forward(zu)[1]).mean() - prior * quality_classifier.softplus(net.forward(zp)[1]).mean()

        def risk(prior=prior):
            return prior * quality_classifier.softplus(-net.forward(zp)[1]).mean() + second()

        z = np.concatenate((zp, zu))
        hidden, out = net.forward(z)
        sp, su = quality_classifier.sigmoid(out[:40]), quality_classifier.sigmoid(out[40:])
        for f, slope in ((risk, np.concatenate((prior * (sp - 1) / 40 - prior * sp / 40, su / 50))), (lambda: -second(), np.concatenate((prior * sp / 40, -su / 50)))):
            for layer, g in zip(net.layers, net.backward(z, hidden, slope), strict=True):
                at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
                old, e = layer[at], 1e-5
                layer[at] = old + e
                up = f()
                layer[at] = old - e
                down = f()
                layer[at] = old
                assert (up - down) / (2 * e) == pytest.approx(g[at], rel=1e-3)


def test_clashing_columns_of_the_sample(spark):
    docs = spark.createDataFrame([(k, f"text {k} of the day", 1, 2, 3) for k in range(30)], "doc_id long, text string, p int, u int, k int")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 30, 2)], "doc_id long, quality int")
    assert quality_classifier.score(docs, quality_classifier.train(docs, labels)).count() == 30


def test_languages_of_documents_and_pages(spark):
    got = language_id.op1_language_id(spark, D)
    docs = got.where("kind = 'document'").join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").selectExpr("count(*) n", "avg(cast(language = lang as double)) a").first()
    pages = got.where("kind = 'page'").selectExpr("count(*) n", "avg(cast(language = declared as double)) a").first()
    assert docs.n == 10_000 and docs.a > 0.995 and pages.n == 2500 and pages.a > 0.995


def test_evidence_decides_without_text(spark):
    rows = [("page", f"h{i}", "com", None, [5.0, 0.0]) for i in range(4)] + [("page", "x", "de", None, [0.0, 4.0])] * 30 + [("page", "x", "de", None, [0.0, 0.0]), ("page", "y", "com", "b", [0.0, 0.0])] + [("page", "z", "com", "b", [0.0, 6.0])] * 30
    scored = spark.createDataFrame(rows, "kind string, host string, suffix string, declared string, scores array<double>")
    got = language_id.fuse(scored, ["a", "b"]).collect()
    assert {r.language for r in got if r.host == "x"} == {"b"}
    assert {r.language for r in got if r.host == "y"} == {"b"} and next(r for r in got if r.host == "y").text_language is None
    assert language_id.fuse(scored, []).count() == len(rows)


def test_language_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, None, None), (2, "http://u@h.example.DE:80/fr/x", "<html lang=EN-us><p>the end of the day</p>"), (2, "::", ""), (None, "//h/", "<p>")], "page_id long, url string, html string")
    got = language_id.identify(docs, pages)
    assert got.count() == len(EDGES) + 4
    assert got.where("page_id = 2 and declared = 'en'").select("host", "suffix").first() == ("h.example.de", "de/fr")
    assert language_id.identify(docs.limit(0), pages.limit(0)).count() == 0
