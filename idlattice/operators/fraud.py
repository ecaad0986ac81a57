"""Signals of forgery from image metadata and from the layout of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import overlap_share

# Names of image editors, and parts of the tags that name software.
EDITORS = ["photoshop", "gimp", "adobe", "canva", "corel", "paint.net", "pixelmator"]
SOFTWARE_TAGS = ["software", "imagehistory", "creator", "editor"]
SIGNAL = "struct<name:string,score:int,description:string,source:string>"
POINTS = {"editing_software_detected": 30, "timestamp_mismatch": 15, "layout_anomaly_mrz_position": 25, "layout_anomaly_aadhaar_position": 20, "overlapping_fields_detected": 25}


def signal(name: str, description: Column, source: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(POINTS[name]).alias("score"), description.alias("description"), F.lit(source).alias("source"))


def metadata_signals(tags: Column) -> Column:
    """One signal for each software tag with an editor's name; one if the two times of a picture differ.

    Times are read with or without the prefixes that EXIF readers put before the tags' names.
    """
    entries = F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>")))
    edited = F.filter(entries, lambda e: F.exists(F.array(*map(F.lit, SOFTWARE_TAGS)), lambda t: F.contains(F.lower(e["key"]), t)) & F.exists(F.array(*map(F.lit, EDITORS)), lambda t: F.contains(F.lower(e["value"]), t)))
    editors = F.transform(edited, lambda e: signal("editing_software_detected", F.concat(e["key"], F.lit(": "), e["value"]), "metadata"))
    tag = lambda *names: F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])
    taken, changed = tag("DateTimeOriginal", "EXIF DateTimeOriginal"), tag("DateTime", "Image DateTime")
    differ = F.coalesce(taken != changed, F.lit(False))
    return F.concat(editors, F.when(differ, F.array(signal("timestamp_mismatch", F.concat(taken, F.lit(" / "), changed), "metadata"))).otherwise(F.array().cast(f"array<{SIGNAL}>")))


def layout_signals(kind: Column, fields: Column, height: Column) -> Column:
    """fields: array of (field_name, value, box) in order. Machine-readable lines in the upper half,
    an Aadhaar number in the top fifth, and pairs of boxes that overlap by more than 30 % of either."""
    boxed = F.filter(fields, lambda f: f["box"].isNotNull() & (f["value"] != "NOT_FOUND"))
    middle = lambda f: f["box"]["y"] + f["box"]["h"] / 2.0
    codes = F.filter(boxed, lambda f: (kind == "PASSPORT") & f["field_name"].isin("mrz_line1", "mrz_line2") & (middle(f) < 0.5 * height))
    numbers = F.filter(boxed, lambda f: (kind == "AADHAAR") & (f["field_name"] == "aadhaar_number") & (middle(f) < 0.2 * height))
    pairs = F.flatten(F.transform(boxed, lambda a, i: F.filter(F.transform(F.slice(boxed, i + 2, F.size(boxed)), lambda b: F.struct(a["field_name"].alias("a"), b["field_name"].alias("b"), overlap_share(a["box"], b["box"]).alias("s"))), lambda p: p["s"] > 0.3)))
    found = F.concat(
        F.transform(codes, lambda f: signal("layout_anomaly_mrz_position", f["field_name"], "layout")),
        F.transform(numbers, lambda f: signal("layout_anomaly_aadhaar_position", f["field_name"], "layout")),
        F.transform(pairs, lambda p: signal("overlapping_fields_detected", F.concat(p["a"], F.lit(" / "), p["b"]), "layout")),
    )
    return F.when(height > 0, found).otherwise(F.array().cast(f"array<{SIGNAL}>"))


def signals(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Long table (doc_id, seq, name, score, description, source).

    docs: doc_id, document_type, exif_tags, word_map; fields: the extracted fields. One join by document.
    """
    listed = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field_seq", "field_name", "value", "box"))).alias("listed"))
    height = F.coalesce(F.array_max(F.transform("word_map", lambda w: w["top"] + w["height"])), F.lit(0))
    empty = F.array().cast(f"array<{SIGNAL}>")
    joined = docs.select("doc_id", "document_type", "exif_tags", height.alias("height")).join(listed, "doc_id", "left")
    laid = F.when(F.col("listed").isNotNull(), layout_signals(F.col("document_type"), F.col("listed"), F.col("height"))).otherwise(empty)
    return joined.select("doc_id", F.posexplode(F.concat(metadata_signals(F.col("exif_tags")), laid)).alias("seq", "s")).select("doc_id", "seq", "s.*")
