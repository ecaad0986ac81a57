"""Operators on small documents, and their invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlattice.operators import boxes, classify, extract, fraud, layout, merge, models, pixels, split, validate
from idlattice.operators.candidates import NOT_FOUND
from idlattice.plans import corpus
from idlattice.sources import readers, sinks

from .conftest import TINY

AS_OF = corpus.AS_OF
WORDS = layout.WORDS


def word(text, left, top, width=None, height=20, conf=0.9):
    return (text, left, top, 12 * len(text) if width is None else width, height, conf)


def page(spark, words, text=""):
    return spark.createDataFrame([(1, text, 0.9, words)], f"doc_id long, ocr_raw_text string, ocr_confidence double, word_map {WORDS}")


def test_reading_order_and_clusters(spark):
    words = [word("c", 0, 50), word("b", 40, 12), word("a", 0, 20), word("d", 0, 64)]
    row = page(spark, words).select(F.transform(layout.reading_order(F.col("word_map")), lambda w: w["text"]).alias("o"), F.size(layout.line_clusters(F.col("word_map"), 10)).alias("n")).first()
    assert row.o == ["a", "b", "c", "d"] or row.o == ["b", "a", "c", "d"]
    assert row.o.index("a") < row.o.index("b") and row.n == 3


def test_box_search():
    words = [dict(zip(("text", "left", "top", "width", "height", "conf"), w, strict=True)) for w in (word("2000", 0, 10), word("0007", 60, 10), word("9195", 120, 12), word("ASHA", 0, 60), word("MEHTA", 60, 60))]
    lines = boxes.page_lines(words)
    assert boxes.locate("2000 0007 9195", words, lines) == {"x": 0, "y": 10, "w": 168, "h": 22}
    assert boxes.locate("2OOO 0007", words, lines) == {"x": 0, "y": 10, "w": 108, "h": 20}
    assert boxes.locate("MEHTA nobody", words, lines) == {"x": 60, "y": 60, "w": 60, "h": 20}
    assert boxes.locate("", words, lines) is None and boxes.locate("x", [], []) is None
    assert boxes.map_field("name", "ASHA MEHTA", words, []) == {"x": 0, "y": 60, "w": 120, "h": 20}
    assert boxes.map_field("name", NOT_FOUND, words, []) is None
    assert [r["text"] for r in boxes.digit_runs(words)] == ["200000079195"]


def test_keyword_and_unknown(spark):
    rows = spark.createDataFrame([("income tax",), ("income tax pan card",), ("hello",), (None,)], "t string")
    got = [(r.b.document_type, round(r.b.score, 4)) for r in rows.select(classify.by_keywords(F.col("t")).alias("b")).collect()]
    assert got == [("PAN", 0.7914), ("PAN", 0.9907), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0)]


def test_sparse_words_do_not_break(spark):
    got = classify.classify(page(spark, [("x", None, None, None, None, 0.5)], "nothing")).select("document_type", "layout").first()
    assert got.document_type == "UNKNOWN" and got.layout.score == 0.0
    assert classify.classify(page(spark, None, None)).first().document_type == "UNKNOWN"


def test_fallback_order(spark):
    rows = spark.createDataFrame([("A1234567",), ("2OOO 0007 9195",), ("ABCDE1234F",), ("none",)], "t string")
    assert [r.f for r in rows.select(classify.fallback_type(F.col("t")).alias("f")).collect()] == ["PASSPORT", "AADHAAR", "PAN", None]


@pytest.mark.parametrize("kind", list(extract.BUILDERS))
def test_extraction_of_blank_documents(spark, kind):
    docs = spark.createDataFrame([(1, kind, None, None), (2, kind, "", [])], f"doc_id long, document_type string, ocr_raw_text string, word_map {WORDS}")
    rows = extract.extract(docs, AS_OF, [kind]).collect()
    assert {r.value for r in rows if r.field_name != "nationality"} == {NOT_FOUND} and len({r.field_name for r in rows}) >= 4


def test_passport_with_bad_mrz_has_low_confidence(spark):
    docs = corpus.documents(spark, TINY).where("kind = 'PASSPORT'").withColumn("document_type", F.col("kind"))
    rows = extract.extract(docs, AS_OF, ["PASSPORT"]).join(docs.select("doc_id", "m", "dob_zone"), "doc_id").where("field_name = 'passport_number'").collect()
    assert {r.status for r in rows if r.m % 8 == 0 and r.confidence <= 0.55} == {"low_confidence"}
    assert {r.status for r in rows if r.m % 8 != 0} == {"ok"} and min(r.confidence for r in rows if r.m % 8 != 0) >= 0.95


def test_validation_of_missing_fields(spark):
    fields = spark.createDataFrame([(1, "AADHAAR", 0, "name", "Asha Mehta"), (1, "AADHAAR", 1, "dob", "2030-01-01"), (2, "DRIVING_LICENCE", 0, "dob", "2010-05-05"), (2, "DRIVING_LICENCE", 1, "dl_number", "MH0220020001234")], "doc_id long, document_type string, field_seq int, field_name string, value string")
    got = {(r.doc_id, r.field_name): r.status for r in validate.validate(fields, AS_OF).collect()}
    assert got[1, "aadhaar_number_format"] == "FAIL" and got[1, "name"] == "WARN" and got[1, "dob_range"] == "FAIL" and (1, "aadhaar_checksum_verhoeff") not in got
    assert got[2, "dl_min_age"] == "FAIL" and got[2, "dl_issue_year_consistency"] == "FAIL" and got[2, "dl_format"] == "PASS" and (2, "expiry_range") not in got


def test_metadata_signals(spark):
    rows = spark.createDataFrame([({"Image Software": "GIMP 2", "Creator": "me", "DateTimeOriginal": "a", "DateTime": "b"},), ({},), (None,)], "t map<string,string>")
    got = [[s.name for s in r.s] for r in rows.select(fraud.metadata_signals(F.col("t")).alias("s")).collect()]
    assert got == [["editing_software_detected", "timestamp_mismatch"], [], []]


def test_word_split_and_ink(spark):
    words = [word("l", 100, 100), word("r", 500, 100)]
    row = page(spark, words).select(split.by_words(F.col("word_map"), F.lit(600), F.lit(400)).alias("s"), split.by_words(F.col("word_map"), F.lit(400), F.lit(400)).alias("n")).first()
    assert (row.s.split_type, row.s.split_at) == ("vertical", 300) and row.n is None
    ink = [9] * 260 + [0] * 80 + [9] * 260
    both = page(spark, words).select(split.hybrid(F.col("word_map"), F.lit(600), F.lit(400), F.lit(ink), F.lit([5] * 400)).alias("h"), split.ink_gap(F.lit(ink), 0.35, 0.65).alias("g")).first()
    assert both.g.at == 299 and both.g.width == 80 and both.h.split_type == "vertical"
    assert split.mrz_indicators(F.lit("x")) is not None


def test_pixels(spark):
    flat, step = np.full((16, 24), 100), np.where(np.arange(24) < 12, 10, 240) * np.ones((16, 1))
    assert pixels.blur(flat) == 0 and pixels.edges(flat.astype(float)) in (0.0, 1.0)
    assert pixels.blur(step) > 1000 and 0 < pixels.edges(step) < 0.5
    assert pixels.equalised(step).shape == step.shape and np.ptp(pixels.equalised(flat)) == 0
    images = spark.createDataFrame([(1, step.astype(int).ravel().tolist(), 24), (2, None, None)], "doc_id long, pixels array<int>, width int")
    rows = {r.doc_id: r for r in pixels.quality(images).collect()}
    assert rows[1].noise_score == pytest.approx(step.std()) and rows[2].blur_score == 0.0
    assert images.where("doc_id = 1").select(pixels.noise(F.col("pixels")).alias("n")).first().n == pytest.approx(step.std())
    profile = images.where("doc_id = 1").select(pixels.ink_profiles("pixels", "width").alias("p")).first().p
    assert profile.columns == [16] * 12 + [0] * 12 and profile.rows == [12] * 16


def plain_sigmoid(m, y):
    """A logistic fit by Newton's steps: slope and shift."""
    x, w = np.stack([m, np.ones(len(m))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (y - p))
    return w


def test_models_learn_and_reload(spark, tmp_path):
    data = models.training_set(spark, 1500)
    model, stats = models.train(data, "fraud")
    assert stats["accuracy"] > 0.85 and 0.1 <= stats["threshold"] <= 0.9
    # Folds: of the same size and share of labels; three models, each calibrated so that its fold's mean is the labels'.
    sizes = {r.part: r["count"] for r in models.parts(data, "y_fraud", 42).groupBy("part").count().collect()}
    assert [f["n"] for f in stats["folds"]] == [sizes[k] for k in range(3)] and 0.15 < sizes[3] / 1500 < 0.25 and max(sizes[k] for k in range(3)) - min(sizes[k] for k in range(3)) < 80
    assert all(abs(f["mean"] - f["share"]) < 1e-3 and f["loss"] < 0.6 for f in stats["folds"]) and len(model.stages) == 7
    held = models.parts(data, "y_fraud", 42).where("part = 1")
    own = model.transform(held).select("y_fraud", models.vector_to_array("margin1")[1].alias("m"), models.vector_to_array("p1")[1].alias("p")).collect()
    slope, shift = plain_sigmoid(np.array([r.m for r in own]), np.array([r.y_fraud for r in own]))
    assert np.array([r.p for r in own]) == pytest.approx(1 / (1 + np.exp(-slope * np.array([r.m for r in own]) - shift)), abs=2e-3)

    path = str(tmp_path / "m")
    assert models.load(spark, path) is None
    models.save(spark, {"fraud": model}, {"fraud": stats}, path)
    again = models.load(spark, path)
    assert again is models.load(spark, path) and again.limits["fraud_suspicious"] == stats["threshold"]
    rows = data.limit(20).withColumnRenamed("id", "doc_id")
    one, two = (models.predict({"fraud": m, "authenticity": m}, rows).orderBy("doc_id").collect() for m in (model, again.models["fraud"]))
    assert one == two and all(0 <= r.fraud_score <= 100 for r in one)
    ruled = rows.select("doc_id", *[F.lit(1).alias(c) for c in ("ocr_confidence", "classification_confidence", "extraction_reliability", "fraud_risk_score", "authenticity_score")], F.lit("ruled").alias("final_decision"))
    assert models.trained_or_ruled(spark, path, rows, ruled) is ruled  # not all five
    models.save(spark, dict.fromkeys(models.TARGETS, model), {"fraud": stats}, path)
    scored = models.trained_or_ruled(spark, path, rows, ruled)
    assert scored.columns == ruled.columns and scored.where("final_decision = 'ruled'").count() == 0 and scored.count() == 20
    damaged = next((tmp_path / "m" / "fraud").rglob("part-*"))
    damaged.write_bytes(damaged.read_bytes() + b"x")
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    models._LOADED.clear()
    assert models.load(spark, path) is None and models.trained_or_ruled(spark, path, rows, ruled) is ruled
    weights = models.ensemble_weights(stats["importance"])
    assert sum(weights.values()) == pytest.approx(1)
    findings = rows.select("doc_id", F.lit("checksum_failed").alias("finding"), F.lit(15).alias("least"))
    assert models.attribution(model, rows, findings).agg(F.min("points")).first()[0] >= 15
    limits = models.decision_thresholds({"fraud": {"threshold": 0.5}})
    assert limits["fraud_genuine"] == pytest.approx(0.21)


def test_files_audit_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PNG").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    found = readers.files(spark, str(tmp_path / "in")).collect()
    assert len(found) == 1 and found[0].document_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    read = readers.with_ocr(readers.files(spark, str(tmp_path / "in")), lambda b: (b.decode(), 0.5, [])).first()
    assert read.ocr_raw_text == "abc" and read.word_map == []
    fields = spark.createDataFrame([(1, 0, "name", "ASHA")], "doc_id long, field_seq int, field_name string, value string")
    scores = spark.createDataFrame([(1, "PAN", 10, "Genuine")], "doc_id long, document_type string, fraud_risk_score int, final_decision string")
    docs = spark.createDataFrame([(1, "a.png", "h")], "doc_id long, image_path string, document_hash string")
    rows = sinks.audit_rows(scores, fields, docs, "2026-01-01 00:00:00")
    for _ in range(2):
        sinks.append_audit(rows, str(tmp_path / "audit"))
    back = readers.audit(spark, str(tmp_path / "audit"))
    assert back.count() == 2 and back.first().extracted_fields == '{"name":"ASHA"}'
    errors = sinks.export_all({"json": (spark.createDataFrame([("{}",)], "v string"), str(tmp_path / "j")), "html": (spark.range(1), str(tmp_path / "h")), "audit": (rows, str(tmp_path / "audit2"))})
    assert list(errors) == ["html"] and readers.audit(spark, str(tmp_path / "audit2")).count() == 1
    assert readers.config(None) == {}
    modes = spark.createDataFrame([("PAN",), ("PAN_FALLBACK",)], "t string").select(readers.page_mode(F.col("t"), {"PAN": 6}).alias("m"), readers.languages(F.col("t")).alias("l")).collect()
    assert [r.m for r in modes] == [6, 11] and modes[0].l == "eng"


def test_audit_batches(spark, tmp_path):
    """Ids of many partitions and batches are unique and go on; a batch that comes again is logged once."""
    path = str(tmp_path / "audit")
    for batch in (0, 1, 1):
        rows = spark.range(0, 400, 1, 200).selectExpr("'t' timestamp", "cast(id as string) document_hash", "'' file_path", "'PAN' document_type", "1 risk_score", "'Genuine' verdict", "'{}' extracted_fields", "'1' pipeline_version")
        sinks.append_audit(rows, path, batch)
    sinks.append_audit(rows.limit(1), path)
    ids = [r.id for r in readers.audit(spark, path).collect()]
    assert ids == list(range(801, 0, -1))


def test_reports_of_a_document(spark):
    fields = spark.createDataFrame([(1, 0, "name", "A < B", "A < B", 0.5, None)], "doc_id long, field_seq int, field_name string, value string, raw_text string, confidence double, box struct<x:int,y:int,w:int,h:int>")
    validations = spark.createDataFrame([(1, 0, "pan_format", "FAIL", "x", None)], "doc_id long, seq int, field_name string, status string, expected string, actual string")
    signals = spark.createDataFrame([(1, 0, "n", 5, "d", "s")], "doc_id long, seq int, name string, score int, description string, source string")
    scores = spark.createDataFrame([(1, "PAN", 0.9, 0.8, 70, 30, 70, "Genuine")], "doc_id long, document_type string, classification_confidence double, ocr_confidence double, extraction_reliability int, fraud_risk_score int, authenticity_score int, final_decision string")
    docs = spark.createDataFrame([(1, "p.png", "text")], "doc_id long, image_path string, ocr_raw_text string")
    told = json.loads(sinks.report_json(docs, fields, validations, signals, scores).first().json)
    assert told["extracted_fields"]["name"]["value"] == "A < B" and told["fraud_signals"][0]["score"] == 5 and told["validation_results"][0]["status"] == "FAIL"
    page = sinks.report_html(fields, validations, scores).first().html
    assert "<td>A &lt; B</td>" in page and sinks.RED in page and "Genuine" in page and "+5" not in page
    page = sinks.report_html(fields, validations, scores, signals).first().html
    assert page.count("<table>") == 3 and f"<td>n</td><td>d</td><td>s</td><td style='color:{sinks.RED}'>+5</td>" in page


def test_one_sided_pictures_and_shifted_fields(spark):
    pages = spark.createDataFrame([(1, "A", "x", 0, 0, []), (1, "B", "P<INDX<<<<<<<<<<<<<<<<<<<<<<<<<<<<", 9, 0, []), (2, "B", "y", 5, 5, [])], f"doc_id long, side string, text string, dx int, dy int, word_map {WORDS}")
    assert {(r.doc_id, r.side, r.page) for r in split.page_order(pages).collect()} == {(1, "A", 2), (1, "B", 1), (2, "B", 1)}
    fields = spark.createDataFrame([(1, (1, 2, 3, 4)), (2, None)], "doc_id long, box struct<x:int,y:int,w:int,h:int>")
    assert [tuple(r.box) if r.box else None for r in merge.shifted(fields, F.lit(10), F.lit(20)).orderBy("doc_id").collect()] == [(11, 22, 3, 4), None]


def test_preprocessing_of_pictures(spark):
    """Lines of text that lie askew are turned level; specks go; ink stays black on white."""
    page = np.full((240, 240), 250.0)
    page[20:220:12, 20:220] = page[21:220:12, 20:220] = page[22:220:12, 20:220] = 20
    for turn in (-9, 0, 6):
        assert abs(pixels.skew(pixels.rotated(page, turn, 250)) + turn) <= 1
    specks = page.copy()
    specks[5, 5], specks[230, 100] = 0, 0
    assert (pixels.median(specks)[5, 5], pixels.median(specks)[230, 100]) == (250, 250)
    out = pixels.binarised(page)
    assert {*np.unique(out)} == {0, 255} and out[21, 100] == 0 and out[26, 100] == 255 and out[5, 5] == 255
    rows = [(1, [int(v) for v in page[:60, :60].ravel()], 60), (2, [], 0), (3, None, None)]
    done = {r.doc_id: r for r in pixels.preprocess(spark.createDataFrame(rows, "doc_id long, pixels array<int>, width int")).collect()}
    assert done[1].width == 120 and len(done[1].pixels) == 120 * 120 and {*done[1].pixels} == {0, 255}
    assert done[2].pixels == [] and done[3].pixels == []
    plain = pixels.preprocess(spark.createDataFrame(rows[:1], "doc_id long, pixels array<int>, width int"), dict.fromkeys(pixels.STEPS, False)).first()
    assert plain.width == 120 and {*plain.pixels} >= {20, 250}


def test_resampling_of_pictures(spark):
    """Flat pictures stay flat, a ramp stays a ramp, sides keep their proportion; a cubic turn by nothing changes nothing."""
    ramp = np.tile(np.arange(0, 240, 4.0), (40, 1))
    for kernel in pixels.KERNELS:
        assert {*np.unique(pixels.resized(np.full((7, 9), 93.0), 20, 4, kernel))} == {93}
        large = pixels.resized(ramp, 80, 120, kernel)
        assert large.shape == (80, 120) and np.abs(np.diff(large[40, 10:-10]) - 2).max() <= 1
        assert (pixels.weights(60, 7, kernel)[1].sum(axis=1) - (1 << pixels.WEIGHT_BITS)).max() <= 60
    assert pixels.fitted(ramp, 30, 600).shape == (20, 30) and pixels.fitted(ramp, 60, 40) is ramp and pixels.fitted(np.zeros((1, 900)), 9, 9).shape == (1, 9)
    assert (pixels.rotated(ramp, 0, 255, cubic=True) == ramp).all() and pixels.rotated(ramp, 45, 255, expand=True, cubic=True)[0, 0] == 255
    rows = [(1, [255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9], 3), (2, [], 0), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, pixels array<int>, width int")
    assert [r.g for r in docs.select(pixels.grey(F.col("pixels")).alias("g")).collect()] == [[76, 150, 29], [], None]
    assert [r.pixels for r in pixels.fit(docs, 2, 2).where("doc_id > 1").collect()] == [[], []]


def test_pages_without_words_or_ids(spark):
    """A page without a word map adds nothing to the whole; rows without an id stay together."""
    word = ("a", 1, 2, 3, 4, 0.5)
    pages = spark.createDataFrame([(1, "A", "x", 5, 0, 0.5, [word]), (1, "B", "y", 9, 0, 0.1, None), (2, "A", None, 0, 0, 0.5, None), (None, "A", "z", 0, 0, 0.5, [word])], f"doc_id long, side string, text string, dx int, dy int, confidence double, word_map {WORDS}")
    whole = {r.doc_id: r for r in merge.whole_picture(split.page_order(pages)).collect()}
    assert [w.left for w in whole[1].word_map] == [6] and whole[1].ocr_raw_text == "x\ny" and whole[1].ocr_confidence == pytest.approx(0.3)
    assert whole[2].word_map == [] and whole[2].ocr_raw_text == "" and len(whole[None].word_map) == 1
