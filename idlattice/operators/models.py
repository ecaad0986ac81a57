"""Trained scores: a synthetic training set, boosted trees, calibration, thresholds and weights.

Trees are pyspark.ml's. Training rows are dealt to three folds; the trees of two are
calibrated by a logistic fit on the third, and a probability is the mean of the three.
Models are saved as pyspark.ml folders with a manifest. Results agree with other
libraries' trees in kind, not to the digit; the rules of scoring.py are the scorer
where no model can be loaded.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import to_score, verdict
from .features import NAMES
from .scoring import THRESHOLDS

log = logging.getLogger(__name__)
#: Folds of the training rows.
FOLDS = 3
TARGETS = ["ocr", "classification", "extraction", "fraud", "authenticity"]
#: Shares of genuine, tampered, blurred and mismatched documents.
MIX = (0.5, 0.2, 0.2, 0.1)
AFTER_OCR = ["validation_fails", "validation_warns", "checksum_failed", "exif_editor_detected", "exif_timestamp_mismatch", "overlapping_fields_count", "layout_anomaly_count"]


def training_set(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """NAMES, category and a 0/1 label for each target, drawn by category."""
    part = iter(range(1, 1000))
    rand = lambda: F.rand(seed + next(part))
    u = lambda low, high: F.lit(low) + rand() * (high - low)
    some = lambda p: (rand() < p).cast("double")
    draw, a, b, c = F.col("draw"), MIX[0], MIX[0] + MIX[1], MIX[0] + MIX[1] + MIX[2]
    rows = spark.range(n).withColumn("draw", F.rand(seed)).withColumn("category", F.when(draw < a, 0).when(draw < b, 1).when(draw < c, 2).otherwise(3))
    cat = F.col("category")
    by = lambda *values: F.when(cat == 0, values[0]).when(cat == 1, values[1]).when(cat == 2, values[2]).otherwise(values[3])
    mean = by(u(0.60, 0.99), u(0.55, 0.97), u(0.15, 0.65), u(0.50, 0.97))
    rows = rows.withColumns({"ocr_mean_conf": mean, "word_count": F.floor(u(15, 60)), "kind": F.floor(u(0, 4))})
    m = F.col("ocr_mean_conf")
    made = {
        "ocr_min_conf": F.greatest(F.lit(0.0), m - u(0.01, 0.3)), "ocr_max_conf": F.least(F.lit(1.0), m + u(0.01, 0.3)), "ocr_std_conf": u(0.01, 0.15),
        "ocr_pct_low_conf": F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - m + F.randn(seed) * 0.1)), "ocr_median_conf": F.least(F.lit(1.0), F.greatest(F.lit(0.0), m + u(-0.05, 0.05))),
        "char_count": F.col("word_count") * F.floor(u(4, 7)), "avg_word_len": u(4.5, 6.5), "valid_words_ratio": by(u(0.8, 1), u(0.75, 1), u(0.4, 0.8), u(0.6, 1)), "alphanumeric_ratio": by(u(0.75, 0.95), u(0.7, 0.95), u(0.4, 0.8), u(0.6, 0.95)),
        "dictionary_match_ratio": by(u(0.2, 0.6), u(0.15, 0.55), u(0.0, 0.25), u(0.05, 0.4)), "text_density": u(1e-4, 4e-4),
        "blur_score": by(u(500, 3000), u(400, 3000), u(10, 500), u(300, 3000)), "noise_score": u(20, 80), "edge_density": by(u(0.05, 0.2), u(0.05, 0.25), u(0.0, 0.08), u(0.03, 0.2)),
        "bbox_height_std": by(u(1, 8), u(4, 20), u(2, 12), u(2, 14)), "bbox_width_std": u(10, 60), "bbox_area_ratio": u(0.02, 0.3),
        "validation_fails": by(F.lit(0.0), F.floor(u(0, 4)), F.floor(u(0, 3)), F.floor(u(1, 4))), "validation_warns": F.floor(u(0, 2)), "checksum_failed": by(some(0.01), some(0.6), some(0.2), some(0.5)),
        "missing_fields_count": by(some(0.1), F.floor(u(0, 3)), F.floor(u(1, 5)), F.floor(u(0, 4))), "field_extraction_success_rate": by(u(0.8, 1), u(0.6, 1), u(0.1, 0.6), u(0.3, 0.9)),
        "overlapping_fields_count": by(F.lit(0.0), F.floor(u(0, 3)), F.lit(0.0), some(0.2)), "layout_anomaly_count": by(F.lit(0.0), some(0.5), F.lit(0.0), some(0.4)),
        "exif_editor_detected": by(some(0.01), some(0.7), some(0.05), some(0.1)), "exif_timestamp_mismatch": by(some(0.03), some(0.5), some(0.05), some(0.1)),
    }
    for p in ("kw", "rg", "ly"):
        made |= {f"{p}_score_{k}": F.when(F.col("kind") == i, by(u(0.75, 1), u(0.65, 1), u(0.0, 0.6), u(0.0, 0.7))).otherwise(0.0) for i, k in enumerate(("aadhaar", "pan", "passport", "dl"))}
    made |= {f"regex_match_{k}": F.when(F.col("kind") == i, by(F.lit(1.0), F.lit(1.0), some(0.3), some(0.4))).otherwise(0.0) for i, k in enumerate(("aadhaar", "pan", "passport", "dl"))}
    noisy = lambda test: (F.when(rand() < 0.02, ~test).otherwise(test)).cast("int")
    labels = {"ocr": noisy(m >= 0.6), "classification": noisy(cat.isin(0, 1)), "extraction": noisy(F.col("field_extraction_success_rate") >= 0.6), "fraud": noisy(cat == 1), "authenticity": noisy(cat == 0)}
    return rows.withColumns(made).withColumns({f"y_{k}": v for k, v in labels.items()}).select("id", "category", *[F.col(c).cast("double").alias(c) for c in NAMES], *[f"y_{k}" for k in TARGETS])


def parts(data: DataFrame, label: str, seed: int) -> DataFrame:
    """Adds part: 0 to FOLDS - 1, the folds of four fifths of the rows, and FOLDS for testing, in the same shares of both labels."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(64))
    turn = (F.row_number().over(Window.partitionBy(label, bucket).orderBy(F.xxhash64("id", F.lit(seed)), "id")) + bucket) % (5 * FOLDS)
    return data.withColumn("part", F.when(turn % 5 == 4, FOLDS).otherwise(F.floor(turn / 5)).cast("int"))


def features_for(data: DataFrame, target: str) -> DataFrame:
    """The OCR score sees nothing that was found after OCR."""
    return data.withColumns({c: F.lit(0.0) for c in AFTER_OCR}) if target == "ocr" else data


def best_threshold(scored: DataFrame, label: str) -> DataFrame:
    """One row: threshold, the median of the thresholds 0.10 to 0.90 with the best F1. scored: p and a 0/1 label.

    Rows are counted once by how many thresholds they reach; only those 82 counts meet all thresholds.
    """
    places = F.sequence(F.lit(10), F.lit(90))
    reached = F.size(F.filter(places, lambda t: F.col("p") >= t / 100))
    counts = scored.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    above = F.col("reached") > F.col("t") - 10
    sums = counts.select("*", F.explode(places).alias("t")).groupBy("t").agg(F.sum(F.when(above, F.col("yes")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("no")).otherwise(0)).alias("fp"), F.sum("yes").alias("all"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all")), F.lit(0.0))
    listed = sums.select("t", f1.alias("f1")).agg(F.array_sort(F.collect_list(F.struct("t", "f1"))).alias("r"), F.max("f1").alias("m"))
    best = listed.select(F.transform(F.filter("r", lambda x: F.col("m") - x["f1"] < 1e-6), lambda x: x["t"]).alias("ts"))
    return best.select(((F.get("ts", ((F.size("ts") - 1) / 2).cast("int")) + F.get("ts", (F.size("ts") / 2).cast("int"))) / 200).alias("threshold"))


def thresholds(scored: DataFrame, label: str) -> float:
    return best_threshold(scored, label).first()[0]


def chance() -> Column:
    """The mean of the folds' calibrated probabilities."""
    return sum((vector_to_array(f"p{k}")[1] for k in range(FOLDS)), F.lit(0.0)) / FOLDS


def train(data: DataFrame, target: str, seed: int = 42) -> tuple[PipelineModel, dict]:
    """Trees and calibration of each fold for one target, with statistics of the folds and of the test rows.

    A fold's sigmoid is fitted to the margins that the trees of the other folds give its
    rows, so no row calibrates trees that have seen it.
    """
    label = f"y_{target}"
    assembler = VectorAssembler(inputCols=NAMES, outputCol="x")
    ready = assembler.transform(features_for(parts(data, label, seed), target)).select("id", "part", "x", label).cache()
    stages, folds, importance = [assembler], [], [0.0] * len(NAMES)
    for k in range(FOLDS):
        boosting = GBTClassifier(featuresCol="x", labelCol=label, maxIter=50, maxDepth=4, stepSize=0.08, seed=seed, predictionCol=f"tree_y{k}")
        trees = boosting.setRawPredictionCol(f"margin{k}").setProbabilityCol(f"tree_p{k}").fit(ready.where((F.col("part") != k) & (F.col("part") != FOLDS)))
        held = trees.transform(ready.where(F.col("part") == k))
        sigmoid = LogisticRegression(featuresCol=f"margin{k}", labelCol=label, regParam=0.0, rawPredictionCol=f"raw{k}", probabilityCol=f"p{k}", predictionCol=f"y{k}").fit(held)
        p = vector_to_array(f"p{k}")[1]
        loss = -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))
        folds.append(sigmoid.transform(held).agg(F.count("*").alias("n"), F.avg(label).alias("share"), F.avg(p).alias("mean"), loss.alias("loss")).first().asDict())
        stages += [trees, sigmoid]
        importance = [a + float(b) / FOLDS for a, b in zip(importance, trees.featureImportances.toArray(), strict=True)]
    model = PipelineModel(stages)
    tested = PipelineModel(stages[1:]).transform(ready.where(F.col("part") == FOLDS)).select(F.col(label).cast("int").alias(label), chance().alias("p")).cache()
    stats = tested.agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy")).first().asDict()
    stats |= {"threshold": thresholds(tested, label), "importance": dict(zip(NAMES, importance, strict=True)), "folds": folds}
    ready.unpersist()
    tested.unpersist()
    return model, stats


def decision_thresholds(stats: dict[str, dict]) -> dict[str, float]:
    """Limits of the verdict from the targets' thresholds; the lower limits are fixed shares of the upper."""
    out = dict(THRESHOLDS)
    for key, target in (("ocr_threshold", "ocr"), ("classification_threshold", "classification"), ("extraction_threshold", "extraction"), ("authenticity_genuine", "authenticity"), ("fraud_suspicious", "fraud")):
        out[key] = stats.get(target, {}).get("threshold", out[key])
    return out | {"authenticity_suspicious": out["authenticity_genuine"] * 0.53, "fraud_genuine": out["fraud_suspicious"] * 0.42}


def ensemble_weights(importance: dict[str, float]) -> dict[str, float]:
    """Weights of the three classifiers by the importance of their scores."""
    sums = {k: sum(v for n, v in importance.items() if n.startswith(p)) for k, p in (("keyword", "kw_score_"), ("regex", "rg_score_"), ("layout", "ly_score_"))}
    whole = sum(sums.values())
    return {k: v / whole for k, v in sums.items()} if whole else {"keyword": 0.40, "regex": 0.40, "layout": 0.20}


def predict(models: dict[str, PipelineModel], features: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """doc_id, the five scores (0 to 100) and final_decision."""
    out = features.select("doc_id")
    for target, model in models.items():
        p = model.transform(features_for(features, target)).select("doc_id", to_score(chance()).alias(f"{target}_score"))
        out = out.join(p, "doc_id")
    percent = lambda name: round(limits[name] * 100)
    return out.withColumn("final_decision", verdict(F.col("authenticity_score"), F.col("fraud_score"), percent("authenticity_genuine"), percent("authenticity_suspicious"), percent("fraud_suspicious"), percent("fraud_genuine")))


def attribution(model: PipelineModel, features: DataFrame, findings: DataFrame) -> DataFrame:
    """Points of each finding: how much the fraud probability falls without it, with a least value by kind.

    findings: doc_id, finding (a feature's name), least. Each becomes a counterfactual row.
    """
    base = model.transform(features).select("doc_id", chance().alias("base"))
    changed = findings.join(features, "doc_id").withColumns({c: F.when(F.col("finding") == c, F.greatest(F.lit(0.0), F.col(c) - 1)).otherwise(F.col(c)) for c in AFTER_OCR})
    again = model.transform(changed).select("doc_id", "finding", "least", chance().alias("without"))
    fall = F.bround(F.greatest(F.lit(0.0), F.col("base") - F.col("without")) * 100).cast("int")
    return again.join(base, "doc_id").select("doc_id", "finding", F.greatest(F.col("least"), fall).alias("points"))


@dataclass(frozen=True)
class Trained:
    """Models by target, and the limits of the verdict that were found with them."""

    models: dict[str, PipelineModel]
    limits: dict[str, float]


def digest(spark: SparkSession, folder: str) -> str:
    """Of the names and contents of a model's files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = read.select(F.regexp_extract("path", "[^/]+/[^/]+/[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("hash")).orderBy("name", "hash").collect()  # some dozen files
    return hashlib.sha256("".join(f"{r['name']} {r['hash']}\n" for r in rows).encode()).hexdigest()


def save(spark: SparkSession, trained: dict[str, PipelineModel], stats: dict[str, dict], path: str) -> None:
    """A folder for each model, then the manifest: the features in order, limits, and a digest of each folder. Replaces what is there."""
    path = path.rstrip("/")
    for target, model in trained.items():
        model.write().overwrite().save(f"{path}/{target}")
    manifest = {"features": NAMES, "limits": decision_thresholds(stats), "models": {t: digest(spark, f"{path}/{t}") for t in trained}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


#: What a session has loaded, by folder and manifest.
_LOADED: dict[tuple[str, str, str], Trained] = {}


def load(spark: SparkSession, path: str) -> Trained | None:
    """The models of a folder, once for each session and manifest; None, with a warning, if there are none, they are
    damaged or were trained on other features."""
    path = path.rstrip("/")
    try:
        text = "".join(r.value for r in spark.read.text(f"{path}/manifest").collect())
        key = (spark.sparkContext.applicationId, path, text)
        if key not in _LOADED:
            manifest = json.loads(text)
            if manifest["features"] != NAMES:
                raise ValueError("the models were trained on other features")
            for target, kept in manifest["models"].items():
                if digest(spark, f"{path}/{target}") != kept:
                    raise ValueError(f"the files of {target} have changed")
            _LOADED[key] = Trained({t: PipelineModel.load(f"{path}/{t}") for t in manifest["models"]}, manifest["limits"])
        return _LOADED[key]
    except (PySparkException, Py4JJavaError, ValueError, KeyError, TypeError) as e:
        log.warning("no models from %s, rules are used: %s", path, e)
        return None


def trained_or_ruled(spark: SparkSession, path: str | None, features: DataFrame, ruled: DataFrame) -> DataFrame:
    """ruled (the rows of scoring.scores) with the scores and verdicts of the models in a folder, if all five can be loaded, else as it is."""
    found = load(spark, path) if path else None
    if found is None or set(found.models) != set(TARGETS):
        return ruled
    columns = {"ocr_score": "ocr_confidence", "classification_score": "classification_confidence", "extraction_score": "extraction_reliability", "fraud_score": "fraud_risk_score", "authenticity_score": "authenticity_score", "final_decision": "final_decision"}
    scored = predict(found.models, features, found.limits).withColumnsRenamed(columns)
    return ruled.drop(*columns.values()).join(scored, "doc_id").select(*ruled.columns)
