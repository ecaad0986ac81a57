"""Queries of the engine, one for each operator group, and the SQL that checks them.

Spark queries use the engine's operators; the SQL states the same rules in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksum, dates, scores, text
from ..operators import candidates, classify, display, extract, features, fraud, layout, merge, models, pixels, scoring, split, validate
from ..operators.boxes import BOX_SQL
from ..sources import audit, exif, pdf, pdf_report, readers, sinks
from . import corpus, passports
from .pipeline import process_verification
from .storage import shared_path

AS_OF = corpus.AS_OF
C = f"WITH c AS ({corpus.corpus_sql(corpus.Duck)})"
W = f"{C}, w AS (SELECT *, (50 + (k * 31 + n * 7) % 50) / 100.0 AS conf FROM ({corpus.DUCK_WORDS}))"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def typed(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    docs = corpus.documents(spark, d).withColumn("document_type", F.col("kind"))
    return docs if kind is None else docs.where(F.col("kind") == kind)


PLANTED = {
    "AADHAAR": {"aadhaar_number": "number", "dob": "dob", "gender": "gender", "name": "name"},
    "PAN": {"pan_number": "number", "dob": "dob", "name": "name", "father_name": "father"},
    "PASSPORT": {"passport_number": "number", "name": "name", "dob": "dob", "expiry": "expiry", "mrz_line1": "mrz1", "mrz_line2": "mrz2"},
    "DRIVING_LICENCE": {"dl_number": "number", "dob": "dob", "validity": "expiry", "name": "name"},
}


def planted_fields(spark: SparkSession, d: str) -> DataFrame:
    """The planted values as a fields table; names are missing in every 13th document."""
    docs = typed(spark, d)
    rows = F.lit(None)
    for kind, own in PLANTED.items():
        value = lambda f, c: F.when((F.col("m") % 13 == 5) & F.lit(f == "name"), F.lit("NOT_FOUND")).otherwise(F.col(c))
        listed = F.array(*[F.struct(F.lit(f).alias("field_name"), value(f, c).alias("value")) for f, c in own.items()])
        rows = F.when(F.col("kind") == kind, listed).otherwise(rows)
    made = docs.select("doc_id", "document_type", "m", F.posexplode(rows).alias("field_seq", "f")).select("doc_id", "document_type", "m", "field_seq", "f.*")
    box = F.struct((F.col("m") % 3 * 20).cast("int").alias("x"), ((F.col("doc_id") * 13 + F.col("field_seq") * 17) % 120).cast("int").alias("y"), F.lit(60).alias("w"), F.lit(20).alias("h"))
    return made.withColumns({"raw_text": F.col("value"), "confidence": ((F.col("doc_id") * 7 + F.col("field_seq") * 11) % 100) / 100, "status": F.lit("ok"), "box": box.cast(BOX_SQL)})


PF = " UNION ALL ".join(
    f"SELECT doc_id, kind AS document_type, m, {seq} AS field_seq, '{f}' AS field_name, " + (f"CASE WHEN m % 13 = 5 THEN 'NOT_FOUND' ELSE {c} END" if f == "name" else c) + f" AS value FROM c WHERE kind = '{kind}'"
    for kind, own in PLANTED.items()
    for seq, (f, c) in enumerate(own.items())
)


# -- texts, numbers, dates -----------------------------------------------------
def q01_verdicts(spark, d):
    """Aadhaar numbers by strict format and check digit, birth dates, points, verdicts."""
    docs = typed(spark, d, "AADHAAR")
    found = F.regexp_extract(text.flat(F.col("ocr_raw_text")), r"\b([0-9]{4}\s+[0-9]{4}\s+[0-9]{4})\b", 1)
    risk = F.when(checksum.verhoeff_valid(found), 0).otherwise(40) + F.when(dates.age(F.to_date("dob"), F.to_date(F.lit(AS_OF))) < 18, 20).otherwise(0)
    return docs.select(scores.verdict(100 - risk, risk).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


V12 = corpus.Duck.verhoeff("x", 11) + " = substr(x, 12, 1)"
Q01 = rf"""{C}, f AS (SELECT dob, replace(regexp_extract(replace(raw_text, chr(10), ' '), '\b([0-9]{{4}}\s+[0-9]{{4}}\s+[0-9]{{4}})\b', 1), ' ', '') AS x FROM c WHERE kind = 'AADHAAR'),
r AS (SELECT CASE WHEN length(x) = 12 AND {V12.replace("substr(x,", "substr(rpad(x, 12, '0'),")} THEN 0 ELSE 40 END + CASE WHEN date_diff('year', CAST(dob AS DATE), DATE '{AS_OF}') - CASE WHEN strftime(DATE '{AS_OF}', '%m%d') < strftime(CAST(dob AS DATE), '%m%d') THEN 1 ELSE 0 END < 18 THEN 20 ELSE 0 END AS risk FROM f)
SELECT CASE WHEN 100 - risk >= 75 AND risk <= 25 THEN 'Genuine' WHEN 100 - risk < 40 OR risk >= 60 THEN 'Suspicious' ELSE 'Needs Manual Review' END AS verdict, count(*) AS n FROM r GROUP BY 1"""


def q02_clean_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(text.flat(t)).alias("flat_chars"), F.size(text.lines(t)).alias("n_lines"), F.size(text.tokens(t)).alias("n_tokens"), F.md5(text.keyword_text(t)).alias("keyword_md5"))


Q02 = r"""SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat_chars,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n_tokens,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\sऀ-ॿ]', ' ', 'g'), '\s+', ' ', 'g'))) AS keyword_md5 FROM documents"""


def q03_digit_maps(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.correct_digits(t)).alias("a"), F.md5(text.match_digits(t)).alias("b"), F.md5(text.normalize_ocr(t, True)).alias("c"), F.md5(text.correct_numeric_field(t)).alias("e"))


Q03 = "SELECT conv_id, turn, md5(translate(text, 'OoIil|!ZzSsBgG', '00111112255896')) AS a, md5(translate(lower(text), 'oilzsbgq', '01125890')) AS b, md5(translate(text, 'OoIlSsBb', '00115588')) AS c, md5(translate(text, 'OIBS', '0185')) AS e FROM conversations"


def q04_mrz_check(spark, d):
    docs = typed(spark, d, "PASSPORT")
    return docs.select("doc_id", F.explode(checksum.mrz_checks(F.col("mrz2"))).alias("r")).select("doc_id", F.col("r.field_name").alias("field_name"), F.col("r.good").alias("good"))


Q04 = f"""{C}, p AS (SELECT doc_id, mrz2 FROM c WHERE kind = 'PASSPORT'), z AS (
SELECT doc_id, 'mrz_passport_checksum' AS field_name, substr(mrz2, 1, 9) AS zone, substr(mrz2, 10, 1) AS digit FROM p UNION ALL SELECT doc_id, 'mrz_dob_checksum', substr(mrz2, 14, 6), substr(mrz2, 20, 1) FROM p
UNION ALL SELECT doc_id, 'mrz_expiry_checksum', substr(mrz2, 22, 6), substr(mrz2, 28, 1) FROM p UNION ALL SELECT doc_id, 'mrz_composite_checksum', substr(mrz2, 1, 10) || substr(mrz2, 14, 7) || substr(mrz2, 22, 22), substr(mrz2, 44, 1) FROM p)
SELECT doc_id, field_name, {corpus.Duck.mrz("zone")} = digit AS good FROM z"""


def q05_normalize_date(spark, d):
    """Clean dates, look-alikes, impossible months, two-digit years and years first."""
    docs = typed(spark, d).where("kind <> 'UNKNOWN'")
    dirty = F.array(
        F.col("dob_text"), F.translate(F.concat_ws("/", "day", "month", "year"), "015", "OlS"), F.concat_ws("/", "day", F.lit("13"), "year"),
        F.concat_ws("-", "day", "month", F.substring("year", 3, 2)), F.concat_ws(".", "year", "month", "day"),
    )
    return docs.select("doc_id", F.posexplode(F.transform(dirty, dates.normalize_date)).alias("form", "iso"))


Q05 = f"""{C}, p AS (SELECT * FROM c WHERE kind <> 'UNKNOWN')
SELECT doc_id, 0 AS form, dob AS iso FROM p UNION ALL SELECT doc_id, 1, dob FROM p UNION ALL SELECT doc_id, 2, year || '-01-' || day FROM p
UNION ALL SELECT doc_id, 3, CASE WHEN CAST(substr(year, 3, 2) AS INT) > 40 THEN '19' ELSE '20' END || substr(year, 3, 2) || '-' || month || '-' || day FROM p UNION ALL SELECT doc_id, 4, dob FROM p"""


def q06_age_rules(spark, d):
    on, born = F.to_date(F.lit("2024-02-28")), F.to_date("o_orderdate")
    years = dates.age(born, on)
    status = F.when(born > on, "FAIL").when(years > 25, "WARN").otherwise("PASS")
    return table(spark, d, "orders").groupBy(years.alias("years"), status.alias("status")).agg(F.count("*").alias("n"), F.max(born).cast("string").alias("youngest"))


Q06 = """SELECT date_diff('year', b, DATE '2024-02-28') - CASE WHEN strftime(DATE '2024-02-28', '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END AS years,
CASE WHEN b > DATE '2024-02-28' THEN 'FAIL' WHEN date_diff('year', b, DATE '2024-02-28') - CASE WHEN strftime(DATE '2024-02-28', '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END > 25 THEN 'WARN' ELSE 'PASS' END AS status,
count(*) AS n, CAST(max(b) AS VARCHAR) AS youngest FROM (SELECT CAST(o_orderdate AS DATE) AS b FROM orders) GROUP BY 1, 2"""


def q07_levenshtein(spark, d):
    return typed(spark, d).select("doc_id", F.round(text.levenshtein_ratio(F.col("name"), F.lower("father")), 6).alias("ratio"))


Q07 = f"{C} SELECT doc_id, round(CASE WHEN lower(name) = lower(father) THEN 1.0 ELSE 1 - levenshtein(lower(name), lower(father)) / greatest(length(name), length(father)) END, 6) AS ratio FROM c"


# -- classification --------------------------------------------------------------
def q08_keyword_scores(spark, d):
    docs = typed(spark, d)
    hits = [classify.keyword_hits(F.col("ocr_raw_text"), kind).alias(f"n_{kind.lower()}") for kind in classify.TYPES]
    best = classify.by_keywords(F.col("ocr_raw_text"))
    return docs.select("doc_id", *hits, best.alias("b")).select("doc_id", *[f"n_{k.lower()}" for k in classify.TYPES], F.col("b.document_type").alias("document_type"), F.round("b.score", 6).alias("score"))


def _hits(kind):
    return " + ".join(f"CAST(regexp_matches(t, '{p}') AS INT)".replace("'father\\'s\\s+name'", "'father''s\\s+name'") for p in classify.KEYWORDS[kind])


Q08 = rf"""{C}, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(raw_text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM c),
h AS (SELECT doc_id, {", ".join(f"{_hits(k)} AS n_{k.lower()}" for k in classify.TYPES)} FROM t), g AS (SELECT *, greatest(n_aadhaar, n_pan, n_passport, n_driving_licence) AS n FROM h)
SELECT doc_id, n_aadhaar, n_pan, n_passport, n_driving_licence, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n_aadhaar = n THEN 'AADHAAR' WHEN n_pan = n THEN 'PAN' WHEN n_passport = n THEN 'PASSPORT' ELSE 'DRIVING_LICENCE' END AS document_type,
round(CASE WHEN n = 0 THEN 0 ELSE 1 / (1 + exp(-(n - 0.6) / 0.3)) END, 6) AS score FROM g"""


def q09_regex_scores(spark, d):
    best = classify.by_format(F.col("ocr_raw_text"), F.col("word_map"))
    return typed(spark, d).select("doc_id", best.alias("b")).select("doc_id", F.col("b.document_type").alias("document_type"), F.round("b.score", 6).alias("score"))




def _try_pattern(rows):  # DuckDB takes patterns as constants only
    return " UNION ALL ".join(f"SELECT doc_id, flat, {i + (20 if soft == "TRUE" else 0)} AS o, '{k}' AS t, {soft} AS soft, regexp_extract(flat, '(?i){p}', 1) AS found FROM f" for soft, own in rows for i, (k, p) in enumerate(own))


Q09 = rf"""{W}, f AS (SELECT doc_id, replace(raw_text, chr(10), ' ') AS flat FROM c), m AS ({_try_pattern([("FALSE", classify.STRICT), ("TRUE", classify.SOFT)])}
  UNION ALL SELECT doc_id, flat, 10, 'PASSPORT', FALSE, 'p<ind' FROM f WHERE contains(lower(flat), 'p<ind')),
tok AS (SELECT doc_id, o, unnest(list_filter(string_split(lower(found), ' '), lambda x: regexp_full_match(x, '[a-z0-9/<]+'))) AS tok FROM m WHERE found <> ''),
cw AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9/<]', '', 'g') AS cw, conf FROM w), own AS (SELECT doc_id, avg(conf) AS mean FROM w GROUP BY 1),
hit AS (SELECT tok.doc_id, tok.o, avg(cw.conf) AS conf FROM tok JOIN cw ON tok.doc_id = cw.doc_id AND tok.tok = cw.cw GROUP BY ALL),
e AS (SELECT m.*, coalesce(hit.conf, own.mean) AS conf, translate(replace(found, ' ', ''), CASE WHEN soft THEN 'OoIil|!ZzSsBgG' ELSE '' END, CASE WHEN soft THEN '00111112255896' ELSE '' END) AS num FROM m JOIN own USING (doc_id) LEFT JOIN hit USING (doc_id, o) WHERE found <> ''),
v AS (SELECT *, t = 'AADHAAR' AND {V12.replace("substr(x,", "substr(CASE WHEN regexp_full_match(num, '[0-9]{12}') THEN num ELSE '000000000001' END,")} AS good FROM e),
s AS (SELECT doc_id, o, t, 0.1 * conf + CASE WHEN o = 10 THEN 0.88 WHEN NOT soft AND t = 'AADHAAR' THEN CASE WHEN good THEN 0.9 ELSE 0.6 END WHEN NOT soft AND t = 'PASSPORT' THEN CASE WHEN contains(lower(flat), 'p<ind') THEN 0.9 ELSE 0.8 END WHEN NOT soft THEN 0.9
    WHEN t = 'AADHAAR' THEN CASE WHEN good THEN 0.85 ELSE -9 END WHEN t = 'PAN' THEN 0.75 ELSE 0.70 END AS score FROM v),
s1 AS (SELECT doc_id, arg_max(t, score - o / 1e9) AS t, max(score) AS score FROM s WHERE o < 10 GROUP BY 1),
s2 AS (SELECT f.doc_id, CASE WHEN p.score IS NOT NULL AND coalesce(s1.score, 0) < 0.95 THEN 'PASSPORT' ELSE coalesce(s1.t, 'UNKNOWN') END AS t, CASE WHEN p.score IS NOT NULL AND coalesce(s1.score, 0) < 0.95 THEN p.score ELSE coalesce(s1.score, 0) END AS score FROM f LEFT JOIN s1 USING (doc_id) LEFT JOIN (SELECT doc_id, score FROM s WHERE o = 10) p USING (doc_id)),
s3 AS (SELECT doc_id, arg_max(t, score - o / 1e9) AS t, max(score) AS score FROM s WHERE o >= 20 GROUP BY 1)
SELECT doc_id, CASE WHEN s2.score < 0.9 AND s3.score > s2.score THEN s3.t ELSE s2.t END AS document_type, round(CASE WHEN s2.score < 0.9 AND s3.score > s2.score THEN s3.score ELSE s2.score END, 6) AS score FROM s2 LEFT JOIN s3 USING (doc_id)"""


def q10_document_types(spark, d):
    return classify.classify(corpus.documents(spark, d)).select("doc_id", "document_type")


# Only Aadhaar documents can stay under the limit: those whose number fails its check digit, or has a year before it.
Q10 = f"""WITH r AS ({Q09}), {W.removeprefix("WITH ")}, y AS (SELECT doc_id, 0.75 + 0.1 * avg(conf) AS score FROM w WHERE kind = 'AADHAAR' AND regexp_full_match(text, '[0-9]{{4}}') GROUP BY 1 HAVING count(*) = 3)
SELECT c.doc_id, CASE WHEN kind <> 'AADHAAR' THEN kind WHEN r.score >= 0.7 THEN 'AADHAAR' WHEN r.score > 0 AND (0.4 * r.score + 0.2 * coalesce(y.score, 0)) / CASE WHEN y.score IS NULL THEN 0.4 ELSE 0.6 END >= 0.7 THEN 'AADHAAR' WHEN r.score = 0 AND y.score >= 0.7 THEN 'AADHAAR' ELSE 'UNKNOWN' END AS document_type
FROM c JOIN r USING (doc_id) LEFT JOIN y USING (doc_id)"""


def q11_fallback_types(spark, d):
    docs = typed(spark, d)
    return docs.groupBy("kind", F.coalesce(classify.fallback_type(F.col("number_text")), F.lit("NONE")).alias("found")).agg(F.count("*").alias("n"))


Q11 = rf"""{C}, f AS (SELECT kind, coalesce(number_text, '') AS t, translate(replace(regexp_extract(coalesce(number_text, ''), '(?i)\b[0-9OISZB]{{4}}\s+[0-9OISZB]{{4}}\s+[0-9OISZB]{{4}}\b'), ' ', ''), 'OoIil|!ZzSsBgG', '00111112255896') AS num FROM c)
SELECT kind, CASE WHEN regexp_matches(t, '(?i)\b[A-Z][0-9OISZB]{{7}}\b') THEN 'PASSPORT' WHEN {V12.replace("substr(x,", "substr(CASE WHEN regexp_full_match(num, '[0-9]{12}') THEN num ELSE '000000000001' END,")} THEN 'AADHAAR'
WHEN regexp_matches(t, '(?i)\b[A-Z]{{5}}[0-9OISZB]{{4}}[A-Z]\b') THEN 'PAN' ELSE 'NONE' END AS found, count(*) AS n FROM f GROUP BY 1, 2"""


# -- layout ------------------------------------------------------------------------
def q12_word_boxes(spark, d):
    box = layout.union_box(F.col("word_map"))
    return typed(spark, d).select("doc_id", F.round(layout.mean_confidence(F.col("word_map")), 6).alias("conf"), box.alias("b")).select("doc_id", "conf", "b.x", "b.y", "b.w", "b.h")


Q12 = f'{W} SELECT doc_id, round(avg(conf), 6) AS conf, min("left") AS x, min(top) AS y, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM w GROUP BY doc_id'


def q13_box_overlap(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")).cast("long").alias("seq"), F.concat(F.lit("f"), "l_linenumber").alias("field_name"),
        F.struct(((F.col("l_partkey") % 50) * 4).cast("int").alias("x"), ((F.col("l_suppkey") % 10) * 10).cast("int").alias("y"), (F.col("l_quantity") * 2).cast("int").alias("w"), (F.col("l_linenumber") * 5 + 20).cast("int").alias("h")).alias("box"),
    )
    return layout.overlapping_pairs(rows).select("doc_id", "first", "second", F.round("share", 6).alias("share"))


Q13 = """WITH b AS (SELECT l_orderkey AS doc_id, CAST(((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity AS BIGINT) AS seq, l_linenumber AS line, (l_partkey % 50) * 4 AS x, (l_suppkey % 10) * 10 AS y, CAST(l_quantity * 2 AS INT) AS w, l_linenumber * 5 + 20 AS h FROM lineitem),
p AS (SELECT a.doc_id, 'f' || a.line AS first, 'f' || b.line AS second, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS dx, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS dy, a.w * a.h AS s, b.w * b.h AS t FROM b a JOIN b b ON a.doc_id = b.doc_id AND a.seq < b.seq)
SELECT doc_id, first, second, round(dx * dy / least(s, t), 6) AS share FROM p WHERE dx > 0 AND dy > 0 AND s > 0 AND t > 0 AND dx * dy / least(s, t) > 0.3"""


def q14_line_clusters(spark, d):
    ordered = layout.reading_order(F.reverse("word_map"))
    return typed(spark, d).select("doc_id", F.size(layout.line_clusters(F.col("word_map"))).alias("n_lines"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("in_order"))


Q14 = f"{C} SELECT doc_id, len(string_split(raw_text, chr(10))) AS n_lines, replace(raw_text, chr(10), ' ') AS in_order FROM c"


def q15_widest_gap(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") > 25).alias("on")))).alias("r"))
    gap = layout.widest_gap(F.transform("r", lambda x: x["on"]))
    return rows.select("doc_id", gap.alias("g")).where("g is not null").select("doc_id", F.col("g.start").alias("start"), F.col("g.length").alias("length"))


Q15 = """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 25) - 1 AS i, l_quantity > 25 AS o FROM lineitem),
g AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g, i FROM r WHERE o), s AS (SELECT doc_id, min(i) AS start, count(*) AS length FROM g GROUP BY doc_id, g)
SELECT doc_id, start, length FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start) = 1"""


def q16_candidate_ranks(spark, d):
    return extract.candidate_table(typed(spark, d), AS_OF)


def q17_dedupe_first(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("n"), F.col("l_returnflag").alias("text")))).alias("r"))
    kept = candidates.first_of_each(F.col("r"))
    return rows.select("doc_id", F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["n"].cast("string"), x["text"])), ",").alias("kept"))


Q17 = """WITH f AS (SELECT l_orderkey AS doc_id, l_returnflag AS text, min((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) AS n FROM lineitem GROUP BY 1, 2) SELECT doc_id, string_agg(n || ':' || text, ',' ORDER BY n) AS kept FROM f GROUP BY 1"""


def q18_nearest_anchor(spark, d):
    docs = typed(spark, d).select("doc_id", text.lines(F.col("ocr_raw_text")).alias("lines")).withColumn("anchors", candidates.anchor_places(F.col("lines"), "dob"))
    return docs.select("doc_id", "anchors", F.posexplode("lines").alias("line", "t")).select("doc_id", "line", layout.nearest_distance(F.col("line"), F.col("anchors")).alias("distance"))


Q18 = f"""{C}, l AS (SELECT doc_id, unnest(range(len(string_split(raw_text, chr(10))))) AS line, unnest(string_split(raw_text, chr(10))) AS t FROM c),
a AS (SELECT doc_id, line AS at FROM l WHERE regexp_matches(lower(t), 'dob|birth|yob|nasc|d\\.o\\.b|date of'))
SELECT l.doc_id, l.line, coalesce(min(abs(l.line - a.at)), 999) AS distance FROM l LEFT JOIN a USING (doc_id) GROUP BY 1, 2"""


def q45_token_confidence(spark, d):
    return typed(spark, d).where("kind <> 'UNKNOWN'").select("doc_id", F.round(candidates.field_confidence(F.col("name"), F.col("word_map")), 6).alias("conf"))


Q45 = rf"""{W}, t AS (SELECT doc_id, unnest(string_split(lower(name), ' ')) AS t FROM c WHERE kind <> 'UNKNOWN'), h AS (SELECT t.doc_id, avg(conf) AS conf FROM t JOIN w ON t.doc_id = w.doc_id AND t.t = regexp_replace(lower(w.text), '[^a-z0-9/<]', '', 'g') GROUP BY 1)
SELECT c.doc_id, round(coalesce(h.conf, avg(w.conf)), 6) AS conf FROM c JOIN w USING (doc_id) LEFT JOIN h USING (doc_id) WHERE c.kind <> 'UNKNOWN' GROUP BY c.doc_id, h.conf"""


# -- extraction --------------------------------------------------------------------
def fields_of(kind):
    def run(spark, d):
        return extract.extract(typed(spark, d, kind), AS_OF, [kind]).select("doc_id", "field_name", "value")

    return run


_GOOD = "CASE WHEN m % 7 = 0 AND m % 11 <> 3 THEN 'NOT_FOUND' ELSE CASE WHEN m % 11 = 3 AND m % 7 = 0 THEN substr(number, 1, 11) || CAST((CAST(substr(number, 12, 1) AS INT) + 9) % 10 AS VARCHAR) ELSE number END END"
# Without a line between, the year of birth and the number's first eight digits read as a number; by chance its check digit is right.
_YEAR_FIRST = f"k % 17 = 0 AND {corpus.Duck.verhoeff('(year || base)', 11)} = substr(base, 8, 1)"
Q19 = f"""{C}, a AS (SELECT * FROM c WHERE kind = 'AADHAAR') SELECT doc_id, 'aadhaar_number' AS field_name, CASE WHEN {_YEAR_FIRST} THEN year || chr(10) || substr(base, 1, 8) ELSE {_GOOD} END AS value FROM a UNION ALL SELECT doc_id, 'dob', dob FROM a
UNION ALL SELECT doc_id, 'gender', CASE WHEN k % 17 = 0 THEN 'NOT_FOUND' ELSE gender END FROM a UNION ALL SELECT doc_id, 'name', name FROM a"""
Q20 = f"{C}, a AS (SELECT * FROM c WHERE kind = 'PAN') SELECT doc_id, 'pan_number' AS field_name, number AS value FROM a UNION ALL SELECT doc_id, 'dob', dob FROM a UNION ALL SELECT doc_id, 'name', name FROM a UNION ALL SELECT doc_id, 'father_name', father FROM a"
Q21 = f"""{C}, a AS (SELECT * FROM c WHERE kind = 'PASSPORT') SELECT doc_id, 'passport_number' AS field_name, number AS value FROM a UNION ALL SELECT doc_id, 'name', name FROM a UNION ALL SELECT doc_id, 'nationality', 'IND' FROM a UNION ALL SELECT doc_id, 'dob', dob FROM a
UNION ALL SELECT doc_id, 'expiry', expiry FROM a UNION ALL SELECT doc_id, 'sex', sex FROM a UNION ALL SELECT doc_id, 'place_of_birth', 'NASHIK' FROM a UNION ALL SELECT doc_id, 'place_of_issue', 'NOT_FOUND' FROM a UNION ALL SELECT doc_id, 'mrz_line1', mrz1 FROM a UNION ALL SELECT doc_id, 'mrz_line2', mrz2 FROM a"""
Q22 = f"{C}, a AS (SELECT * FROM c WHERE kind = 'DRIVING_LICENCE') SELECT doc_id, 'dl_number' AS field_name, number AS value FROM a UNION ALL SELECT doc_id, 'dob', dob FROM a UNION ALL SELECT doc_id, 'validity', expiry FROM a UNION ALL SELECT doc_id, 'name', name FROM a UNION ALL SELECT doc_id, 'vehicle_class', 'LMV, MCWG' FROM a"


# -- validation, fraud, scores -------------------------------------------------------
def q23_validations(spark, d):
    return validate.validate(planted_fields(spark, d), AS_OF).select("doc_id", "seq", "field_name", "status")


_AGE = f"(date_diff('year', CAST(dob AS DATE), DATE '{AS_OF}') - CASE WHEN strftime(DATE '{AS_OF}', '%m%d') < strftime(CAST(dob AS DATE), '%m%d') THEN 1 ELSE 0 END)"
_NAME = "CASE WHEN m % 13 = 5 THEN 'FAIL' ELSE 'PASS' END"
_HAS = "m % 13 <> 5"
_OK = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END"
_RULES = {
    "AADHAAR": [("aadhaar_number_format", "'PASS'", "TRUE"), ("dob", "'PASS'", "TRUE"), ("gender_format", "'PASS'", "TRUE"), ("name", _NAME, "TRUE"), ("dob_range", "'PASS'", "TRUE"), ("aadhaar_checksum_verhoeff", _OK.format("m % 7 <> 0"), "TRUE")],
    "PAN": [("pan_format", "'PASS'", "TRUE"), ("dob", "'PASS'", "TRUE"), ("name", _NAME, "TRUE"), ("father_name", "'PASS'", "TRUE"), ("dob_range", "'PASS'", "TRUE"), ("pan_name_consistency", _OK.format("substr(number, 5, 1) = substr(last, 1, 1)"), _HAS)],
    "PASSPORT": [
        ("passport_format", "'PASS'", "TRUE"), ("dob", "'PASS'", "TRUE"), ("expiry", "'PASS'", "TRUE"), ("name", _NAME, "TRUE"), ("dob_range", "'PASS'", "TRUE"),
        ("expiry_range", f"CASE WHEN CAST(expiry AS DATE) < DATE '{AS_OF}' THEN 'WARN' ELSE 'PASS' END", "TRUE"), ("cross_passport_number", "'PASS'", "TRUE"), ("cross_dob", "'PASS'", "TRUE"), ("mrz_passport_checksum", "'PASS'", "TRUE"),
        ("mrz_dob_checksum", _OK.format(f"m % 8 <> 0 OR {corpus.Duck.mrz('dob_zone')} = '9'"), "TRUE"), ("mrz_expiry_checksum", "'PASS'", "TRUE"), ("mrz_composite_checksum", "'PASS'", "TRUE"),
    ],
    "DRIVING_LICENCE": [
        ("dl_format", "'PASS'", "TRUE"), ("dob", "'PASS'", "TRUE"), ("validity", "'PASS'", "TRUE"), ("name", _NAME, "TRUE"), ("dob_range", "'PASS'", "TRUE"), ("expiry_range", f"CASE WHEN CAST(expiry AS DATE) < DATE '{AS_OF}' THEN 'WARN' ELSE 'PASS' END", "TRUE"),
        ("dl_min_age", _OK.format(f"{_AGE} >= 18"), "TRUE"), ("dl_issue_year_consistency", _OK.format("2001 + m % 24 > CAST(year AS INT) + 16"), "TRUE"),
    ],
}
V_ROWS = " UNION ALL ".join(f"SELECT doc_id, kind, m, {i} AS o, '{n}' AS field_name, {s} AS status FROM c WHERE kind = '{k}' AND {w}" for k, own in _RULES.items() for i, (n, s, w) in enumerate(own))
V = f"v AS (SELECT doc_id, kind, m, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS seq, field_name, status FROM ({V_ROWS}))"
Q23 = f"{C}, {V} SELECT doc_id, seq, field_name, status FROM v"


def q24_validation_summary(spark, d):
    return validate.summary(validate.validate(planted_fields(spark, d), AS_OF))


Q24 = f"{C}, {V} SELECT doc_id, count(*) FILTER (status = 'FAIL') AS validation_fails, count(*) FILTER (status = 'WARN') AS validation_warns, max(CASE WHEN status = 'FAIL' AND (contains(field_name, 'checksum') OR contains(field_name, 'verhoeff')) THEN 1 ELSE 0 END) AS checksum_failed FROM v GROUP BY doc_id"


def q25_metadata_signals(spark, d):
    return typed(spark, d).select("doc_id", F.explode(fraud.metadata_signals(F.col("exif_tags"))).alias("s")).select("doc_id", "s.name", "s.score")


Q25 = f"{C} SELECT doc_id, 'editing_software_detected' AS name, 30 AS score FROM c WHERE m % 10 = 0 UNION ALL SELECT doc_id, 'timestamp_mismatch', 15 FROM c WHERE m % 12 = 0"


def q26_layout_signals(spark, d):
    docs = typed(spark, d).where("kind <> 'UNKNOWN'")
    return fraud.signals(docs, planted_fields(spark, d)).where("source = 'layout'").groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


_B = f"{C}, pf AS ({PF}), b AS (SELECT *, (m % 3) * 20 AS x, (doc_id * 13 + field_seq * 17) % 120 AS y, 60 AS w, 20 AS h FROM pf WHERE value <> 'NOT_FOUND'), hh AS (SELECT doc_id, 40 * (len(string_split(raw_text, chr(10))) - 1) + 30 AS height FROM c)"
LAYOUT = """SELECT doc_id, 'layout_anomaly_mrz_position' AS name, 25 AS score FROM b JOIN hh USING (doc_id) WHERE document_type = 'PASSPORT' AND field_name IN ('mrz_line1', 'mrz_line2') AND y + 10 < 0.5 * height
UNION ALL SELECT doc_id, 'layout_anomaly_aadhaar_position', 20 FROM b JOIN hh USING (doc_id) WHERE field_name = 'aadhaar_number' AND y + 10 < 0.2 * height
UNION ALL SELECT a.doc_id, 'overlapping_fields_detected', 25 FROM b a JOIN b z ON a.doc_id = z.doc_id AND a.field_seq < z.field_seq WHERE (20 - abs(a.y - z.y)) / 20.0 > 0.3"""
Q26 = f"{_B} SELECT doc_id, name, count(*) AS n, sum(score) AS points FROM ({LAYOUT}) GROUP BY 1, 2"

_TEXT_FEATURES = "ocr_mean_conf ocr_min_conf ocr_max_conf ocr_std_conf ocr_pct_low_conf ocr_median_conf word_count char_count avg_word_len valid_words_ratio alphanumeric_ratio dictionary_match_ratio text_density bbox_height_std bbox_width_std bbox_area_ratio regex_match_aadhaar regex_match_pan regex_match_passport regex_match_dl".split()


def q27_text_features(spark, d):
    return features.text_features(typed(spark, d)).select("doc_id", *[F.round(c, 6).alias(c) for c in _TEXT_FEATURES])


_DICT = ", ".join(f"'{w}'" for w in features.DICTIONARY)
Q27 = rf"""{W}, a AS (SELECT doc_id, avg(conf) AS ocr_mean_conf, min(conf) AS ocr_min_conf, max(conf) AS ocr_max_conf, stddev_pop(conf) AS ocr_std_conf, avg(CAST(conf < 0.6 AS INT)) AS ocr_pct_low_conf, median(conf) AS ocr_median_conf, CAST(count(*) AS DOUBLE) AS word_count,
  avg(length(text)) AS avg_word_len, avg(CAST(regexp_matches(text, '[a-zA-Z0-9]') AS INT)) AS valid_words_ratio, avg(CAST(regexp_replace(lower(text), '[^\w]', '', 'g') IN ({_DICT}) AS INT)) AS dictionary_match_ratio,
  stddev_pop(height) AS bbox_height_std, stddev_pop(width) AS bbox_width_std, sum(width * height) / 1e6 AS bbox_area_ratio FROM w GROUP BY doc_id),
t AS (SELECT doc_id, CAST(length(raw_text) AS DOUBLE) AS char_count, length(regexp_replace(raw_text, '[^a-zA-Z0-9]', '', 'g')) / length(raw_text) AS alphanumeric_ratio, length(raw_text) / 1e6 AS text_density,
  {", ".join(f"CAST(len(regexp_extract_all(raw_text, '{p}')) AS DOUBLE) AS {n}" for n, p in features.COUNTS.items())} FROM c)
SELECT doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in _TEXT_FEATURES)} FROM a JOIN t USING (doc_id)"""


def q28_risk_scores(spark, d):
    docs = typed(spark, d).where("kind <> 'UNKNOWN'")
    fields = planted_fields(spark, d)
    points = scoring.fraud_points(validate.validate(fields, AS_OF), fraud.signals(docs, fields))
    own = docs.select("doc_id", "ocr_confidence").join(points, "doc_id", "left")
    risk = F.least(F.lit(100), F.coalesce("points", F.lit(0)) + F.when(F.col("ocr_confidence") < 0.60, ((0.60 - F.col("ocr_confidence")) * 50).cast("int")).otherwise(0))
    out = own.select("doc_id", risk.alias("risk"), (100 - risk).alias("authenticity"))
    return out.select("doc_id", "risk", "authenticity", scores.verdict(F.col("authenticity"), F.col("risk")).alias("verdict"), scores.risk_tier(F.col("risk")).alias("tier"), sinks.risk_colour(F.col("risk")).alias("colour"))


Q28 = f"""{_B}, {V}, vp AS (SELECT doc_id, sum(CASE WHEN status = 'WARN' THEN 10 WHEN status = 'FAIL' AND NOT contains(field_name, 'checksum') THEN 20 ELSE 0 END) + max(CASE WHEN status = 'FAIL' AND contains(field_name, 'checksum') THEN 40 ELSE 0 END) AS p FROM v GROUP BY 1),
sp AS (SELECT doc_id, sum(CASE WHEN name LIKE 'layout%' THEN 25 ELSE score END) AS s FROM ({LAYOUT} UNION ALL SELECT doc_id, 'editing_software_detected', 30 FROM c WHERE m % 10 = 0 UNION ALL SELECT doc_id, 'timestamp_mismatch', 15 FROM c WHERE m % 12 = 0) GROUP BY 1),
r AS (SELECT c.doc_id, least(100, CAST(coalesce(p, 0) + coalesce(s, 0) + CASE WHEN CAST(ocr_confidence AS DOUBLE) < 0.6 THEN trunc((0.6::DOUBLE - CAST(ocr_confidence AS DOUBLE)) * 50) ELSE 0 END AS INT)) AS risk FROM c LEFT JOIN vp USING (doc_id) LEFT JOIN sp USING (doc_id) WHERE kind <> 'UNKNOWN')
SELECT doc_id, risk, 100 - risk AS authenticity, CASE WHEN risk <= 25 THEN 'Genuine' WHEN risk >= 60 THEN 'Suspicious' ELSE 'Needs Manual Review' END AS verdict,
CASE WHEN risk <= 20 THEN 'LOW' WHEN risk <= 50 THEN 'MEDIUM' WHEN risk <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS tier, CASE WHEN risk < 25 THEN '#28a745' WHEN risk < 50 THEN '#ffc107' ELSE '#dc3545' END AS colour FROM r"""


def q29_full_verification(spark, d):
    """The whole verification: fields, findings, features and verdicts of the corpus."""
    typed_docs = classify.classify(corpus.documents(spark, d))
    return process_verification(typed_docs, AS_OF).scores


def q56_field_features(spark, d):
    """Fields that are missing and signals of each kind, by document."""
    docs, fields = typed(spark, d).where("kind <> 'UNKNOWN'"), planted_fields(spark, d)
    out = features.field_features(fields).join(features.signal_features(fraud.signals(docs, fields)), "doc_id", "left")
    return out.select("doc_id", "missing_fields_count", F.round("field_extraction_success_rate", 6).alias("success_rate"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("overlapping_fields_count", "layout_anomaly_count", "exif_editor_detected", "exif_timestamp_mismatch")])


Q56 = f"""{_B}, s AS (SELECT doc_id, CAST(count(*) FILTER (name = 'overlapping_fields_detected') AS DOUBLE) AS o, CAST(count(*) FILTER (name LIKE 'layout%') AS DOUBLE) AS l FROM ({LAYOUT}) GROUP BY 1),
f AS (SELECT doc_id, CAST(count(*) FILTER (value = 'NOT_FOUND') AS DOUBLE) AS missing, count(*) AS n FROM pf GROUP BY 1)
SELECT doc_id, missing AS missing_fields_count, round((n - missing) / n, 6) AS success_rate, coalesce(o, 0) AS overlapping_fields_count, coalesce(l, 0) AS layout_anomaly_count,
CASE WHEN m % 10 = 0 THEN 1.0 ELSE 0.0 END AS exif_editor_detected, CASE WHEN m % 12 = 0 THEN 1.0 ELSE 0.0 END AS exif_timestamp_mismatch FROM f JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


def given_candidates(spark, d):
    """Candidates of three fields for each document of their type: found on a line, told by another zone, of wrong form, on another line."""
    box = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(60).alias("w"), F.lit(20).alias("h")).cast(BOX_SQL)
    conf = (60 + F.col("k") % 31) / 100

    def one(value, raw=None, conf=conf, line=-1, source="visual", boost=0.0, at=None):
        own = candidates.candidate(value, value if raw is None else raw, conf, line, source, boost)
        return own if at is None else own.withField("box", at)

    lit = F.lit
    listed = {
        ("AADHAAR", "dob"): [one(F.col("dob"), F.col("dob_text"), at=box(72, 90)), one(lit("2031-01-01"), conf=lit(90), line=0, source="mrz", boost=0.1), one(lit("2020-13-45")), one(F.col("dob"), line=4, conf=lit(0.97), at=box(500, 205))],
        ("PASSPORT", "passport_number"): [one(F.col("number"), at=box(0, 90)), one(lit("A123")), one(lit("Z7654321"), line=14, source="mrz", boost=0.2, conf=lit(0.71)), one(F.col("number"), line=9, conf=lit(55), at=box(0, 190))],
        ("PAN", "name"): [one(F.col("name"), at=box(0, 130)), one(lit("RAVI"), line=0), one(lit("A1")), one(lit("ANIL KUMAR RAO"), line=6, conf=lit(0.52), boost=0.05, at=box(0, 250))],
    }
    docs = typed(spark, d).withColumns({"lines": text.lines(F.col("ocr_raw_text")), "words": F.col("word_map"), "page_height": F.lit(400)})
    return candidates.with_facts(docs), listed


def q57_candidate_scores(spark, d):
    """Scores, ranks and combined confidences of candidates, and the one chosen with its mark."""
    docs, listed = given_candidates(spark, d)
    page, rows = candidates.Page.of(AS_OF), F.lit(None)

    def listing(kind, field, own):
        best = candidates.choose(kind, field, own, page)
        shown = lambda x, i: F.struct(
            F.lit(field).alias("field_name"), (i + 1).alias("rank"), x["c"]["text"].alias("text"), x["c"]["line"].alias("line"), F.round(x["score"], 6).alias("score"),
            F.round(candidates.confidence(kind, field, x["c"], page), 6).alias("confidence"), best["value"].alias("chosen"), best["status"].alias("status"),
        )
        return F.transform(candidates.ranked(kind, field, own, page), shown)

    for (kind, field), own in listed.items():
        rows = F.when(F.col("kind") == kind, listing(kind, field, F.array(*own))).otherwise(rows)
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def _given(kind, field, rows):
    return " UNION ALL ".join(f"SELECT doc_id, kind, '{field}' AS field, {i} AS i, {t} AS text, {raw} AS raw, CAST({conf} AS DOUBLE) AS conf, {line} AS given, '{src}' AS source, CAST({boost} AS DOUBLE) AS boost, CAST({y} AS DOUBLE) AS y, CAST({x} AS INT) AS x FROM c WHERE kind = '{kind}'" for i, t, raw, conf, line, src, boost, x, y in rows)


_CONF = "(60 + k % 31) / 100.0"
# Those of wrong form are left out.
_GIVEN = " UNION ALL ".join([
    _given("AADHAAR", "dob", [(0, "dob", "dob_text", _CONF, -1, "visual", 0, 72, 90), (1, "'2031-01-01'", "'2031-01-01'", 0.9, 0, "mrz", 0.1, "NULL", "NULL"), (3, "dob", "dob", 0.97, 4, "visual", 0, 500, 205)]),
    _given("PASSPORT", "passport_number", [(0, "number", "number", _CONF, -1, "visual", 0, 0, 90), (2, "'Z7654321'", "'Z7654321'", 0.71, 14, "mrz", 0.2, "NULL", "NULL"), (3, "number", "number", 0.55, 9, "visual", 0, 0, 190)]),
    _given("PAN", "name", [(0, "name", "name", _CONF, -1, "visual", 0, 0, 130), (1, "'RAVI'", "'RAVI'", _CONF, 0, "visual", 0, "NULL", "NULL"), (3, "'ANIL KUMAR RAO'", "'ANIL KUMAR RAO'", 0.52, 6, "visual", 0.05, 0, 250)]),
])
Q57 = rf"""{W}, l AS (SELECT doc_id, unnest(range(len(string_split(raw_text, chr(10))))) AS line, lower(unnest(string_split(raw_text, chr(10)))) AS t FROM c), g0 AS ({_GIVEN}),
g AS (SELECT g0.*, CASE WHEN given = -1 THEN coalesce((SELECT min(line) FROM l WHERE l.doc_id = g0.doc_id AND (contains(t, lower(raw)) OR contains(t, lower(text)))), 0) ELSE given END AS line FROM g0),
a AS (SELECT doc_id, f.field, line AS pos FROM l JOIN (VALUES ('dob', 'dob|birth|yob|date of|nasc|d\.o\.b'), ('passport_number', 'pass no|passport|document no|pasp|no|number'), ('name', 'name|gvn|nam|nom')) f(field, p) ON regexp_matches(t, p)),
n AS (SELECT doc_id, field, i, line - pos AS s FROM g JOIN a USING (doc_id, field) QUALIFY row_number() OVER (PARTITION BY doc_id, field, i ORDER BY abs(line - pos), pos) = 1),
b AS (SELECT g.doc_id, g.field, g.i, bool_or(abs(w.top + 10 - (g.y + 10)) < 15) AS level, bool_or(greatest(w."left", g.x) <= least(w."left" + w.width, g.x + 60)) AS beneath FROM g JOIN w ON g.doc_id = w.doc_id WHERE g.field = 'dob' AND g.y IS NOT NULL AND regexp_matches(lower(w.text), 'dob|birth|yob|nasc|d\.o\.b') GROUP BY ALL),
r AS (SELECT g.*, s, coalesce(level, FALSE) AS level, coalesce(beneath, FALSE) AS beneath, (y + 10) / 400 AS share, len(string_split(text, ' ')) AS words FROM g LEFT JOIN n USING (doc_id, field, i) LEFT JOIN b USING (doc_id, field, i)),
t AS (SELECT *, coalesce(CASE field WHEN 'dob' THEN share > 0.3 AND share < 0.7 WHEN 'passport_number' THEN share < 0.3 OR share > 0.7 ELSE share > 0.2 AND share < 0.6 END, FALSE) AS placed FROM r),
v AS (SELECT *, 0.4 * conf + 0.25 * CASE WHEN s IS NULL THEN 0 WHEN s IN (0, 1) THEN 1 WHEN s = 2 THEN 0.8 WHEN s = -1 THEN 0.4 WHEN s = -2 THEN 0.2 ELSE 0.1 END + 0.2 + 0.1 * CASE WHEN placed THEN 1 ELSE 0.5 END
  + 0.05 * CASE WHEN source = 'visual' THEN CASE WHEN kind = 'PASSPORT' THEN 0.8 ELSE 1 END WHEN kind = 'PASSPORT' THEN 1 ELSE 0.5 END + 2 * boost
  + CASE field WHEN 'passport_number' THEN 2 WHEN 'name' THEN CASE WHEN words >= 3 THEN 1.5 WHEN words = 2 THEN 1 ELSE -2 END - CASE WHEN length(text) < 5 THEN 2 ELSE 0 END
    ELSE CASE WHEN level THEN 1.5 ELSE 0 END + CASE WHEN beneath THEN 1.5 ELSE 0 END - CASE WHEN text > '{AS_OF}' THEN 5 ELSE 0 END END AS score,
  0.4 * conf + 0.3 + 0.2 * CASE WHEN s IS NULL OR abs(s) >= 5 THEN 0.4 WHEN abs(s) <= 1 THEN 1 WHEN abs(s) = 2 THEN 0.8 ELSE 0.6 END + 0.1 * CASE WHEN field <> 'dob' AND placed THEN 1 ELSE 0.8 END AS confidence FROM t)
SELECT doc_id, field AS field_name, row_number() OVER o AS rank, text, line, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(confidence AS DOUBLE), 6) AS confidence, first_value(text) OVER o AS chosen,
  CASE WHEN first_value(conf) OVER o < CASE field WHEN 'dob' THEN 0.6 WHEN 'name' THEN 0.55 ELSE 0.65 END THEN 'low_confidence' ELSE 'ok' END AS status FROM v WINDOW o AS (PARTITION BY doc_id, field ORDER BY score DESC, i)"""


def q30_attribution(spark, d):
    v = validate.validate(planted_fields(spark, d), AS_OF)
    return v.select("doc_id", "seq", scoring.attribution(F.col("status"), F.col("field_name")).alias("points"), sinks.status_colour(F.col("status")).alias("colour"))


Q30 = f"{C}, {V} SELECT doc_id, seq, CASE status WHEN 'FAIL' THEN CASE WHEN contains(field_name, 'checksum') THEN 40 ELSE 20 END WHEN 'WARN' THEN 10 ELSE 0 END AS points, CASE status WHEN 'PASS' THEN '#28a745' WHEN 'WARN' THEN '#ffc107' ELSE '#dc3545' END AS colour FROM v"


#: Fields of passports that page 2 gives first, beside the planted ones.
SECOND_PAGE = ["place_of_birth", "place_of_issue"]


def two_pages(spark, d):
    f = planted_fields(spark, d)
    more = f.where("document_type = 'PASSPORT' AND field_seq = 0").withColumn("field_name", F.explode(F.array(*map(F.lit, SECOND_PAGE))))
    f = f.unionByName(more.withColumns({"field_seq": F.when(F.col("field_name") == SECOND_PAGE[0], 7).otherwise(8), "value": F.concat(F.lit("city "), "doc_id")}))
    keep = ["doc_id", "field_name", "value", "confidence", "status", "box"]

    def page(n, r):
        gone = (F.col("doc_id") + F.col("field_seq")) % 5 == r
        own = f.where((F.col("doc_id") + F.col("field_seq")) % 7 != n).withColumns({"value": F.when(gone, F.lit("NOT_FOUND")).otherwise(F.concat(F.col("value"), F.lit(f"/{n}"))), "status": F.when(gone, "not_found").otherwise(f"page {n}"), "confidence": F.lit(n / 10) + F.col("field_seq") / 100})
        return merge.shifted(own, F.lit(100 * n), F.lit(n)).select(*keep)

    return page(1, 0), page(2, 3)


def shown_fields(fields):
    return fields.select("doc_id", "field_name", "value", F.round("confidence", 6).alias("confidence"), "status", "box.x", "box.y", "box.w", "box.h")


def _page(n, r):
    gone = f"(doc_id + field_seq) % 5 = {r}"
    return f"SELECT doc_id, field_name, {{{{'value': CASE WHEN {gone} THEN 'NOT_FOUND' ELSE value || '/{n}' END, 'confidence': {n} / 10.0 + field_seq / 100.0, 'status': CASE WHEN {gone} THEN 'not_found' ELSE 'page {n}' END, 'x': m % 3 * 20 + {100 * n}, 'y': (doc_id * 13 + box_seq * 17) % 120 + {n}}}}} AS {'ab'[n - 1]} FROM pf WHERE (doc_id + field_seq) % 7 <> {n}".replace("{{", "{").replace("}}", "}")


_P = f"""{C}, pf AS (SELECT *, field_seq AS box_seq FROM ({PF}) UNION ALL SELECT doc_id, kind, m, 7, 'place_of_birth', 'city ' || doc_id, 0 FROM c WHERE kind = 'PASSPORT' UNION ALL SELECT doc_id, kind, m, 8, 'place_of_issue', 'city ' || doc_id, 0 FROM c WHERE kind = 'PASSPORT'),
a AS ({_page(1, 0)}), b AS ({_page(2, 3)})"""
_ROW = "r.value AS value, round(CAST(r.confidence AS DOUBLE), 6) AS confidence, r.status AS status, r.x AS x, r.y AS y, 60 AS w, 20 AS h"


def q31_page_merge(spark, d):
    return shown_fields(merge.merge_pages(*two_pages(spark, d)))


_FOUND_A, _FOUND_B = "CASE WHEN a.value <> 'NOT_FOUND' THEN a END", "CASE WHEN b.value <> 'NOT_FOUND' THEN b END"
Q31 = f"""{_P} SELECT doc_id, field_name, {_ROW} FROM (SELECT doc_id, field_name, CASE WHEN field_name IN ('passport_number', 'name', 'nationality', 'dob', 'expiry', 'sex', 'mrz_line1', 'mrz_line2')
THEN coalesce({_FOUND_A}, {_FOUND_B}, a, b) ELSE coalesce({_FOUND_B}, {_FOUND_A}, b, a) END AS r FROM a FULL JOIN b USING (doc_id, field_name))"""


def q32_fallback_fill(spark, d):
    return shown_fields(merge.fill_missing(*two_pages(spark, d)))


Q32 = f"{_P}, s AS (SELECT * FROM b WHERE b.value <> 'NOT_FOUND') SELECT doc_id, field_name, {_ROW} FROM (SELECT doc_id, field_name, coalesce({_FOUND_A}, b, a) AS r FROM a FULL JOIN s USING (doc_id, field_name))"


def q46_page_order(spark, d):
    """Two sides of a picture, or one; the page that comes first, and the whole picture's words."""
    docs = typed(spark, d)
    side = lambda n: docs.where(f"m % 5 <> {3 if n == 'B' else 99}").select("doc_id", F.lit(n).alias("side"), (F.col("ocr_raw_text") if n == "A" else F.when(F.col("m") % 2 == 0, F.concat("mrz1", F.lit("\n"), "mrz2")).otherwise(F.col("last"))).alias("text"), F.lit(0 if n == "A" else 300).alias("dx"), F.lit(0).alias("dy"), (F.lit(0.5) if n == "A" else F.lit(0.25)).alias("confidence"), F.when(F.lit(n == "A") | (F.col("m") % 7 != 1), F.slice("word_map", 1, 1)).alias("word_map"))
    whole = merge.whole_picture(split.page_order(side("A").unionByName(side("B"))))
    return whole.select("doc_id", F.md5("ocr_raw_text").alias("text_md5"), "ocr_confidence", F.array_join(F.transform("word_map", lambda w: w["left"].cast("string")), ",").alias("lefts"))


_POINTS = "list_sum(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(upper(x), '[^A-Z0-9<]', '', 'g')), lambda x: length(x) >= 30), lambda x: CASE WHEN starts_with(x, 'P<') OR (starts_with(x, 'P') AND length(x) - length(replace(x, '<', '')) >= 5) THEN 15 WHEN length(x) - length(replace(x, '<', '')) >= 10 THEN 10 WHEN length(x) - length(replace(x, '<', '')) >= 5 THEN 5 ELSE 0 END))"
Q46 = f"""{W}, s AS (SELECT doc_id, 'A' AS side, raw_text AS t FROM c UNION ALL SELECT doc_id, 'B', CASE WHEN m % 2 = 0 THEN mrz1 || chr(10) || mrz2 ELSE last END FROM c WHERE m % 5 <> 3),
p AS (SELECT doc_id, side, coalesce(t, '') AS t, coalesce({_POINTS}, 0) + length(coalesce(t, '')) - length(replace(coalesce(t, ''), '<', '')) AS n FROM s), f AS (SELECT doc_id, max(CASE WHEN side = 'A' THEN t END) AS ta, max(CASE WHEN side = 'B' THEN t END) AS tb, max(CASE WHEN side = 'A' THEN n END) AS na, max(CASE WHEN side = 'B' THEN n END) AS nb FROM p GROUP BY 1),
l AS (SELECT doc_id, arg_min("left", n) AS x FROM w GROUP BY 1)
SELECT doc_id, md5(CASE WHEN nb IS NULL THEN ta WHEN na >= nb THEN ta || chr(10) || tb ELSE tb || chr(10) || ta END) AS text_md5, CASE WHEN nb IS NULL THEN 0.5 ELSE 0.375 END AS ocr_confidence, CASE WHEN nb IS NULL OR m % 7 = 1 THEN '' || x WHEN na >= nb THEN x || ',' || (x + 300) ELSE (x + 300) || ',' || x END AS lefts FROM f JOIN l USING (doc_id) JOIN c USING (doc_id)"""


def first_lines(spark, d):
    """The first line of each document as a field: right, with another value, or without a box."""
    docs = typed(spark, d).where("kind <> 'UNKNOWN'")
    own = F.filter("word_map", lambda w: w["top"] == F.array_min(F.transform("word_map", lambda x: x["top"])))
    line = F.array_join(F.transform(own, lambda w: w["text"]), " ")
    value = F.when(F.col("m") % 4 == 0, F.concat(line, F.lit(" X"))).when(F.col("m") % 4 == 1, F.lit("NOT_FOUND")).otherwise(F.upper(line))
    box = F.when(F.col("m") % 4 != 2, layout.union_box(own))
    return docs, docs.select("doc_id", F.lit("name").alias("field_name"), F.lit(0).alias("field_seq"), value.alias("value"), F.when(F.col("m") % 8 == 3, "low_confidence").otherwise("ok").alias("status"), box.alias("box"))


def q47_highlights(spark, d):
    docs, fields = first_lines(spark, d)
    return display.with_highlights(fields, docs).select("doc_id", "field_name", "highlight_status")


Q47 = f"{C} SELECT doc_id, 'name' AS field_name, CASE WHEN m % 4 IN (0, 2) THEN 'Highlight unavailable for this field.' ELSE '' END AS highlight_status FROM c WHERE kind <> 'UNKNOWN'"


def q58_number_highlights(spark, d):
    """Numbers and dates against the words of their line: look-alike digits count as equal, other readings don't."""
    docs = typed(spark, d).where("kind IN ('AADHAAR', 'DRIVING_LICENCE')")
    on_line = lambda j: F.filter("word_map", lambda w: w["top"] == 40 * j + 10)
    aadhaar = F.col("kind") == "AADHAAR"
    number = F.when(aadhaar, on_line(F.when(F.col("k") % 17 == 0, 3).otherwise(4))).otherwise(F.filter(on_line(F.lit(2)), lambda w: w["left"] >= 72))
    date = F.slice(on_line(F.when(aadhaar, 2).otherwise(4)), 2, 1)
    rows = [(F.when(aadhaar, "aadhaar_number").otherwise("dl_number"), F.col("number"), number), (F.lit("dob"), F.translate("dob_text", "0158", "OISB"), date), (F.lit("validity"), F.col("dob"), date), (F.lit("name"), F.lit("NOT_FOUND"), date)]
    listed = F.array(*[F.struct(n.alias("field_name"), v.alias("value"), layout.union_box(w).alias("box")) for n, v, w in rows])
    return display.with_highlights(docs.select("doc_id", F.inline(listed)), docs).select("doc_id", "field_name", "highlight_status")


# A noisy number has the letter O for each 0, and never a wrong check digit.
Q58 = f"""{C}, d AS (SELECT * FROM c WHERE kind IN ('AADHAAR', 'DRIVING_LICENCE')), no AS (SELECT 'Highlight unavailable for this field.' AS t)
SELECT doc_id, CASE kind WHEN 'AADHAAR' THEN 'aadhaar_number' ELSE 'dl_number' END AS field_name, CASE WHEN kind = 'AADHAAR' AND m % 11 = 3 AND m % 7 = 0 THEN t ELSE '' END AS highlight_status FROM d, no
UNION ALL SELECT doc_id, 'dob', '' FROM d UNION ALL SELECT doc_id, 'validity', t FROM d, no UNION ALL SELECT doc_id, 'name', '' FROM d"""


def q48_display_text(spark, d):
    docs, fields = first_lines(spark, d)
    named = typed(spark, d).select("doc_id", F.col("kind").alias("document_type"), F.lit(0.875).alias("classification_confidence"))
    return display.ocr_display(named, display.with_highlights(fields, docs))


Q48 = f"""{C}, f AS (SELECT doc_id, kind, m, string_split(raw_text, chr(10))[1] AS line FROM c)
SELECT doc_id, 'CLASSIFIED DOCUMENT: ' || kind || chr(10) || CASE WHEN kind = 'UNKNOWN' THEN '' ELSE 'CLASSIFICATION CONFIDENCE: 87.5%' || chr(10) END || repeat('=', 45) || chr(10) ||
CASE WHEN kind = 'UNKNOWN' THEN '  (No fields extracted successfully yet)' WHEN m % 4 = 1 THEN 'EXTRACTED DETAILS:' || chr(10) || '  (No fields extracted successfully yet)'
ELSE 'EXTRACTED DETAILS:' || chr(10) || '  Name: ' || CASE WHEN m % 4 = 0 THEN line || ' X' ELSE upper(line) END || CASE WHEN m % 4 IN (0, 2) THEN ' [Highlight unavailable]' ELSE '' END || CASE WHEN m % 8 = 3 THEN ' [Low Confidence]' ELSE '' END END AS display FROM f"""


def q49_failed_rules(spark, d):
    docs = typed(spark, d).where("kind <> 'UNKNOWN'")
    none = planted_fields(spark, d).where("FALSE")
    return display.failed_rules(validate.validate(planted_fields(spark, d), AS_OF), fraud.signals(docs, none)).select("doc_id", "title", "points")


_LABEL = "array_to_string(list_transform(string_split({}, '_'), lambda x: upper(x[1]) || substr(x, 2)), ' ')"


# -- files ------------------------------------------------------------------------------
def q51_file_tags(spark, d):
    """Tags read from the bytes of pictures, and the signals that follow from them."""
    read = exif.with_tags(corpus.picture_files(spark, d))
    marks = F.transform(fraud.metadata_signals(F.col("exif_tags")), lambda s: F.concat_ws(" ", s["name"], s["score"].cast("string")))
    tag = lambda name: F.try_element_at("exif_tags", F.lit(name))
    return read.select("doc_id", F.size("exif_tags").alias("n_tags"), tag("Image Software").alias("software"), tag("Image DateTime").alias("changed"), tag("EXIF DateTimeOriginal").alias("taken"), F.array_join(F.array_sort(marks), ", ").alias("signals"))


Q51 = """WITH p AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS cut FROM customer)
SELECT k AS doc_id, CASE WHEN cut THEN 0 ELSE 3 END AS n_tags, CASE WHEN cut THEN NULL WHEN k % 10 = 0 THEN 'Adobe Photoshop 24' ELSE 'scanner ' || k END AS software,
CASE WHEN cut THEN NULL WHEN k % 12 = 0 THEN '2024:02:01 10:00:00' ELSE '2024:01:01 10:00:00' END AS changed, CASE WHEN cut THEN NULL ELSE '2024:01:01 10:00:00' END AS taken,
CASE WHEN cut THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 10 = 0 THEN 'editing_software_detected 30' END, CASE WHEN k % 12 = 0 THEN 'timestamp_mismatch 15' END], lambda x: x IS NOT NULL), ', ') END AS signals FROM p"""


def q52_pdf_reports(spark, d):
    """Reports as PDF files, and what a reader of such files finds on all their pages."""
    docs = typed(spark, d).where("kind <> 'UNKNOWN'").withColumn("image_path", F.concat(F.lit("scan/"), "doc_id", F.lit(".jpg")))
    fields = planted_fields(spark, d)
    checked = validate.validate(fields, AS_OF).withColumns({"expected": F.col("field_name"), "actual": F.lit(None).cast("string")})
    marks = fraud.signals(docs, fields.where("FALSE"))
    rated = docs.select("doc_id", "document_type", F.when(F.col("m") % 3 == 0, "Genuine").otherwise("Suspicious").alias("final_decision"), (F.col("m") % 90).alias("fraud_risk_score"), (100 - F.col("m") % 90).alias("authenticity_score"), F.lit(70).alias("extraction_reliability"))
    made = pdf_report.report_pdf(docs, fields, checked, marks, rated, f"{AS_OF} 00:00:00")
    read = pdf.with_first_page(made.withColumnRenamed("pdf", "content"), most=None)
    return read.select("doc_id", F.size("page_texts").alias("n_pages"), F.array_join("page_texts", "\n").alias("lines"), "error")


Q52 = f"""{C}, pf AS ({PF}), {V},
l AS (SELECT doc_id, 0 AS part, 0 AS seq, 'Audit Report' || chr(10) || 'Document Type: ' || kind || chr(10) || 'Verdict Status: ' || CASE WHEN m % 3 = 0 THEN 'Genuine' ELSE 'Suspicious' END || chr(10) || 'Risk Score: ' || m % 90 || '/100' || chr(10) || 'Authenticity Score: ' || (100 - m % 90) || '/100'
  || chr(10) || 'Extraction Reliability: 70/100' || chr(10) || 'Timestamp: {AS_OF} 00:00:00' || chr(10) || 'Image File: ' || doc_id || '.jpg' || chr(10) || 'Extracted Fields' AS t FROM c WHERE kind <> 'UNKNOWN'
UNION ALL SELECT doc_id, 1, field_seq, {_LABEL.format("field_name")} || ' | ' || value || ' | ' || (doc_id * 7 + field_seq * 11) % 100 || '%' FROM pf
UNION ALL SELECT doc_id, 2, 0, 'Field Validation Rules' FROM c WHERE kind <> 'UNKNOWN'
UNION ALL SELECT doc_id, 3, seq, {_LABEL.format("field_name")} || ' | ' || status || ' | Exp: ' || field_name || ' | Act:' FROM v
UNION ALL SELECT doc_id, 4, 0, 'Fraud Risk Signal Analysis' FROM c WHERE (m % 10 = 0 OR m % 12 = 0) AND kind <> 'UNKNOWN'
UNION ALL SELECT doc_id, 5, 0, 'metadata | editing_software_detected: Image Software: Adobe Photoshop 24 | +30' FROM c WHERE m % 10 = 0 AND kind <> 'UNKNOWN'
UNION ALL SELECT doc_id, 5, 1, 'metadata | timestamp_mismatch: 2024:01:01 10:00:00 / 2024:02:01 10:00:00 | +15' FROM c WHERE m % 12 = 0 AND kind <> 'UNKNOWN')
SELECT doc_id, 1 AS n_pages, string_agg(t, chr(10) ORDER BY part, seq) AS lines, CAST(NULL AS VARCHAR) AS error FROM l GROUP BY doc_id"""


# -- audit, exports, tables ------------------------------------------------------------
def events_as_audit(spark, d):
    verdict = F.when(F.col("event_type") == "purchase", "Genuine").when(F.col("event_type") == "error", "Suspicious").when(F.col("event_type") == "click", "PASS").otherwise("Needs Manual Review")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("document_type"), verdict.alias("verdict"))


def q33_audit_statistics(spark, d):
    return sinks.statistics(events_as_audit(spark, d))


_EV = "WITH a AS (SELECT event_id AS id, event_type AS document_type, CASE event_type WHEN 'purchase' THEN 'Genuine' WHEN 'error' THEN 'Suspicious' WHEN 'click' THEN 'PASS' ELSE 'Needs Manual Review' END AS verdict FROM events)"
Q33 = f"{_EV} SELECT count(*) AS total, count(*) FILTER (verdict = 'Genuine') AS genuine, count(*) FILTER (verdict = 'Needs Manual Review') AS review, count(*) FILTER (verdict = 'Suspicious') AS suspicious, count(*) FILTER (verdict = 'PASS') AS legacy_pass, count(*) FILTER (verdict = 'WARN') AS legacy_warn, count(*) FILTER (verdict NOT IN ('PASS', 'WARN')) AS legacy_fail FROM a"


def q53_audit_log(spark, d):
    """Events appended by a writer and by a stream's two batches, one of which comes twice: rows and ids as read back."""
    path = shared_path(spark, "audit-log")
    rows = table(spark, d, "events").select("event_id", F.lit("t").alias("timestamp"), F.col("event_id").cast("string").alias("document_hash"), F.lit("").alias("file_path"), F.col("event_type").alias("document_type"), F.lit(1).alias("risk_score"), F.lit("Genuine").alias("verdict"), F.lit("{}").alias("extracted_fields"), F.lit("1.0.0").alias("pipeline_version"))
    for share, batch in ((0, None), (1, 0), (1, 0), (2, 1)):
        audit.append_audit(rows.where(F.col("event_id") % 3 == share).drop("event_id"), path, batch, "stream")
    share = F.col("document_hash").cast("long") % 3
    return audit.read_audit(spark, path).groupBy(share.alias("share")).agg(F.count("*").alias("n"), F.countDistinct("document_hash").alias("events"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


Q53 = """WITH n AS (SELECT event_id % 3 AS share, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1)
SELECT share, n, events, n AS ids, 1 + coalesce(sum(n) OVER (ORDER BY share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, (sum(n) OVER (ORDER BY share))::BIGINT AS last FROM n"""


def q34_audit_rollup(spark, d):
    rows = events_as_audit(spark, d).rollup("document_type", "verdict").agg(F.count("*").alias("n"), F.max("id").alias("latest"))
    return rows.select(F.coalesce("document_type", F.lit("all")).alias("document_type"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "n", "latest")


Q34 = f"{_EV} SELECT coalesce(document_type, 'all') AS document_type, coalesce(verdict, 'all') AS verdict, count(*) AS n, max(id) AS latest FROM a GROUP BY ROLLUP (document_type, verdict)"


def q35_field_table(spark, d):
    f = planted_fields(spark, d)
    return merge.field_table(f, validate.validate(f, AS_OF))


Q35 = f"""{C}, pf AS ({PF}), {V}, m AS (SELECT pf.doc_id, pf.field_name, pf.field_seq, value, status, row_number() OVER (PARTITION BY pf.doc_id, pf.field_name ORDER BY seq DESC NULLS LAST) AS r FROM pf LEFT JOIN v ON pf.doc_id = v.doc_id AND contains(v.field_name, pf.field_name))
SELECT doc_id, {_LABEL.format("field_name")} AS label, value, CASE WHEN (doc_id * 7 + field_seq * 11) % 100 >= 80 THEN 'high' WHEN (doc_id * 7 + field_seq * 11) % 100 >= 60 THEN 'medium' ELSE 'low' END AS band, coalesce(status, 'NONE') AS status FROM m WHERE r = 1
UNION ALL SELECT doc_id, {_LABEL.format("field_name")}, '', '', status FROM v WHERE NOT EXISTS (SELECT 1 FROM pf WHERE pf.doc_id = v.doc_id AND contains(v.field_name, pf.field_name))"""


Q49 = f"""{C}, {V} SELECT doc_id, 'Rule Failure: ' || {_LABEL.format("field_name")} AS title, CASE WHEN contains(field_name, 'checksum') THEN 40 ELSE 20 END AS points FROM v WHERE status = 'FAIL'
UNION ALL SELECT doc_id, 'Editing Software Detected', 30 FROM c WHERE m % 10 = 0 AND kind <> 'UNKNOWN' UNION ALL SELECT doc_id, 'Timestamp Mismatch', 15 FROM c WHERE m % 12 = 0 AND kind <> 'UNKNOWN'"""


def pictures(spark, d):
    """A 24 x 16 picture for each supplier, arithmetic of its key."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(24 * 16 - 1)), lambda i: ((F.col("s_suppkey") * 31 + i * i * (1 + F.col("s_suppkey") % 5) + (i % 24) * 11) % 256).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), pixel.alias("pixels"), F.lit(24).alias("width"))


def q36_pixel_quality(spark, d):
    q = pictures(spark, d).select("doc_id", pixels.quality_of("pixels", "width").alias("q"))
    return q.select("doc_id", F.round("q.blur_score", 4).alias("blur_score"), F.round("q.noise_score", 6).alias("noise_score"))


Q36 = """WITH p AS (SELECT s_suppkey AS doc_id, i // 24 AS y, i % 24 AS x, (s_suppkey * 31 + i * i * (1 + s_suppkey % 5) + (i % 24) * 11) % 256 AS g FROM supplier, range(384) r(i)),
l AS (SELECT c.doc_id, c.g, sum(n.g) - 4 * c.g AS l FROM p c JOIN p n ON n.doc_id = c.doc_id JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) ON n.y = greatest(0, least(15, c.y + dy)) AND n.x = greatest(0, least(23, c.x + dx)) GROUP BY c.doc_id, c.y, c.x, c.g)
SELECT doc_id, round(var_pop(l), 4) AS blur_score, round(stddev_pop(g), 6) AS noise_score FROM l GROUP BY doc_id"""


def q50_picture_repair(spark, d):
    """The median filter, and how level the rows of ink lie."""
    return pictures(spark, d).select("doc_id", F.md5(F.array_join(pixels.medians("pixels", "width"), ",")).alias("medians"), F.round(pixels.level("pixels", "width"), 6).alias("level"))


Q50 = """WITH p AS (SELECT s_suppkey AS doc_id, i // 24 AS y, i % 24 AS x, (s_suppkey * 31 + i * i * (1 + s_suppkey % 5) + (i % 24) * 11) % 256 AS g FROM supplier, range(384) r(i)),
m AS (SELECT c.doc_id, c.y, c.x, CAST(quantile_disc(n.g, 0.5) AS INT) AS g FROM p c, range(-1, 2) a(dy), range(-1, 2) b(dx), p n WHERE n.doc_id = c.doc_id AND n.y = greatest(0, least(15, c.y + dy)) AND n.x = greatest(0, least(23, c.x + dx)) GROUP BY 1, 2, 3),
j AS (SELECT doc_id, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY y, x)) AS medians FROM m GROUP BY 1), r AS (SELECT doc_id, y, count(*) FILTER (g < 128) AS n FROM p GROUP BY 1, 2)
SELECT doc_id, medians, round(var_pop(n), 6) AS level FROM r JOIN j USING (doc_id) GROUP BY 1, 2"""


def q55_resized_pictures(spark, d):
    """Pictures enlarged, made to fit and shrunk, and grey values of their pixels taken as colours."""
    read = pictures(spark, d)
    md5 = lambda df, name: df.select("doc_id", F.col("width").alias(f"{name}_width"), F.md5(F.array_join("pixels", ",")).alias(name))
    large, small, least = md5(pixels.resize(read, 32, 48), "large"), md5(pixels.fit(read, 13, 11), "fit"), md5(pixels.resize(read, 5, 7, "bilinear"), "small")
    return read.select("doc_id", F.md5(F.array_join(pixels.grey(F.col("pixels")), ",")).alias("grey")).join(large, "doc_id").join(small, "doc_id").join(least, "doc_id")


_KERNEL_SQL = {
    "bilinear": (1, "greatest(0, 1 - abs(t))"),
    "bicubic": (2, "CASE WHEN abs(t) < 1 THEN (1.5 * abs(t) - 2.5) * t * t + 1 WHEN abs(t) < 2 THEN ((2.5 - 0.5 * abs(t)) * abs(t) - 4) * abs(t) + 2 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END"),
}


def _weights(old, new, kernel):
    reach, f = _KERNEL_SQL[kernel]
    step, wide = old / new, max(1.0, old / new)
    return f"""(SELECT o, i, CAST(CASE WHEN v < 0 THEN ceil(v * 4194304 - 0.5) ELSE floor(v * 4194304 + 0.5) END AS BIGINT) AS w FROM (SELECT o, i, f / sum(f) OVER (PARTITION BY o) AS v FROM (SELECT o, i, CAST({f} AS DOUBLE) AS f FROM (
  SELECT o, i, (i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {step!r}::DOUBLE) / {wide!r}::DOUBLE AS t FROM range({new}) a(o), range({old}) b(i) WHERE i >= trunc((o + 0.5::DOUBLE) * {step!r}::DOUBLE - {reach * wide!r}::DOUBLE + 0.5) AND i < trunc((o + 0.5::DOUBLE) * {step!r}::DOUBLE + {reach * wide!r}::DOUBLE + 0.5)))))"""


def _resized(name, height, width, kernel):
    whole = "CAST(greatest(0, least(255, floor((sum(g * w) + 2097152) / 4194304::DOUBLE))) AS INT) AS g"
    return f"""{name}_rows AS (SELECT doc_id, y, o AS x, {whole} FROM p JOIN {_weights(24, width, kernel)} k ON p.x = k.i GROUP BY 1, 2, 3),
{name} AS (SELECT doc_id, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY y, x)) AS md5 FROM (SELECT doc_id, o AS y, x, {whole} FROM {name}_rows r JOIN {_weights(16, height, kernel)} k ON r.y = k.i GROUP BY 1, 2, 3) GROUP BY 1)"""


Q55 = f"""WITH p AS (SELECT s_suppkey AS doc_id, i, i // 24 AS y, i % 24 AS x, (s_suppkey * 31 + i * i * (1 + s_suppkey % 5) + (i % 24) * 11) % 256 AS g FROM supplier, range(384) r(i)),
{_resized("large", 32, 48, "bicubic")}, {_resized("fit", 8, 13, "lanczos")}, {_resized("small", 5, 7, "bilinear")},
c AS (SELECT doc_id, i // 3 AS n, CAST(sum(g * CASE i % 3 WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768 AS BIGINT) // 65536 AS g FROM p GROUP BY 1, 2), c1 AS (SELECT doc_id, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY n)) AS grey FROM c GROUP BY 1)
SELECT doc_id, grey, 48 AS large_width, large.md5 AS large, 13 AS fit_width, fit.md5 AS fit, 7 AS small_width, small.md5 AS small FROM c1 JOIN large USING (doc_id) JOIN fit USING (doc_id) JOIN small USING (doc_id)"""


def q37_trained_scores(spark, d):
    """A model of fraud, trained on the synthetic set, over the corpus' features."""
    model, _ = models.train(models.training_set(spark, 2000), "fraud")
    return models.predict({"fraud": model, "authenticity": model}, features.features(typed(spark, d))).select("doc_id", "fraud_score")


def q54_split_passports(spark, d):
    """Pictures of passports, of one page or two: read, split, read by page, extracted, merged, with boxes on the whole picture."""
    read = passports.read_pictures(corpus.passport_pictures(spark, d).drop("m"), corpus.read_letters)
    both = passports.split_and_extract(read, corpus.read_letters, AS_OF)
    fields = both.fields.where(F.col("field_name").isin("passport_number", "mrz_line1", "mrz_line2", "place_of_birth", "place_of_issue")).select("doc_id", "field_name", "value", "box.*")
    docs = both.docs.select("doc_id", "split_type", "split_at", F.col("page_1_offset.x").alias("page_1_x"), F.col("page_2_offset.x").alias("page_2_x"), F.size("word_map").alias("n_words"), F.md5("ocr_raw_text").alias("text_md5"))
    return docs.join(fields, "doc_id")


Q54 = f"""{C}, p AS (SELECT *, m % 5 <> 0 AS split, m % 4 = 0 AS bare, CASE WHEN m % 5 = 0 OR m % 2 = 0 THEN 4 ELSE 124 END AS home, CASE WHEN m % 2 = 0 THEN 124 ELSE 4 END AS other, CASE WHEN m % 4 = 0 THEN 119 ELSE 104 END AS place FROM c WHERE kind = 'PASSPORT'),
t AS (SELECT *, 'REPUBLIC OF INDIA' || chr(10) || 'Passport No ' || number || chr(10) || 'Surname' || chr(10) || last || chr(10) || 'Given Name' || chr(10) || first || chr(10) || 'Date of Birth ' || dob_text || chr(10) || 'Date of Expiry ' || expiry_text || chr(10) || mrz1 || chr(10) || mrz2
  || CASE WHEN NOT split THEN '' WHEN bare THEN chr(10) ELSE chr(10) || 'Place of Birth' || chr(10) || 'NASHIK' || chr(10) || 'Place of Issue' || chr(10) || 'PUNE' END AS t FROM p),
f AS (SELECT doc_id, 'passport_number' AS field_name, number AS value, home + 12 AS x, 24 AS y, 8 AS w FROM p UNION ALL SELECT doc_id, 'mrz_line1', mrz1, home, 152, 44 FROM p UNION ALL SELECT doc_id, 'mrz_line2', mrz2, home, 168, 44 FROM p
  UNION ALL SELECT doc_id, unnest(['place_of_birth', 'place_of_issue']), CASE WHEN split AND NOT bare THEN unnest(['NASHIK', 'PUNE']) ELSE 'NOT_FOUND' END, CASE WHEN split AND NOT bare THEN other END, CASE WHEN split AND NOT bare THEN unnest([40, 72]) END, CASE WHEN split AND NOT bare THEN unnest([6, 4]) END FROM p)
SELECT doc_id, CASE WHEN split THEN 'vertical' END AS split_type, CASE WHEN split THEN place END AS split_at, CASE WHEN split THEN CASE WHEN home = 4 THEN 0 ELSE place END END AS page_1_x, CASE WHEN split THEN CASE WHEN home = 4 THEN place ELSE 0 END END AS page_2_x,
  len(string_split(trim(replace(t, chr(10), ' ')), ' ')) AS n_words, md5(t) AS text_md5, field_name, value, x, y, w, CASE WHEN x IS NOT NULL THEN 1 END AS h FROM t JOIN f USING (doc_id)"""


def q38_picture_splits(spark, d):
    sized = typed(spark, d).withColumns({"w": F.lit(600), "h": F.lit(400)})
    return sized.select("doc_id", split.by_words(F.col("word_map"), F.col("w"), F.col("h")).alias("s")).select("doc_id", F.col("s.split_type").alias("split_type"), F.col("s.split_at").alias("split_at"))


Q38 = f"""{W}, x AS (SELECT doc_id, unnest(range(210, 390, 2)) AS x FROM c), k AS (SELECT x.doc_id, x.x, count(w.doc_id) AS cost FROM x LEFT JOIN w ON w.doc_id = x.doc_id AND w."left" < x.x AND x.x < w."left" + w.width GROUP BY 1, 2),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost, abs(x - 300), x) = 1), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1)
SELECT doc_id, CASE WHEN cost <= greatest(3, n * 3 // 100) THEN 'vertical' END AS split_type, CASE WHEN cost <= greatest(3, n * 3 // 100) THEN x END AS split_at FROM b JOIN n USING (doc_id)"""


def q39_ocr_tokens(spark, d):
    tokens = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("n"), F.lit(5).alias("level"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1).alias("width"), F.lit(1).alias("height"),
        F.when(F.col("l_quantity") % 7 == 0, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"), F.when(F.col("l_quantity") % 5 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"),
    )
    read = readers.ocr_tokens(tokens)
    return read.select("doc_id", F.round("ocr_confidence", 6).alias("ocr_confidence"), F.size("word_map").alias("n_words"), F.array_join(F.transform("word_map", lambda w: w["text"]), "").alias("joined"))


Q39 = "SELECT l_orderkey AS doc_id, round(avg(l_quantity * 2) / 100, 6) AS ocr_confidence, count(*) FILTER (l_quantity % 5 <> 0) AS n_words, coalesce(string_agg(l_returnflag, '' ORDER BY (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) FILTER (l_quantity % 5 <> 0), '') AS joined FROM lineitem WHERE l_quantity % 7 <> 0 GROUP BY 1"


def q40_mrz_indicators(spark, d):
    return typed(spark, d).select("doc_id", split.mrz_indicators(F.col("ocr_raw_text")).alias("points"))


Q40 = rf"""{C}, l AS (SELECT doc_id, regexp_replace(upper(unnest(string_split(raw_text, chr(10)))), '[^A-Z0-9<]', '', 'g') AS x FROM c), b AS (SELECT doc_id, x, length(x) - length(replace(x, '<', '')) AS n FROM l),
s AS (SELECT doc_id, sum(CASE WHEN length(x) < 30 THEN 0 WHEN starts_with(x, 'P<') OR (starts_with(x, 'P') AND n >= 5) THEN 15 WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 ELSE 0 END) AS s FROM b GROUP BY 1) SELECT doc_id, s + length(raw_text) - length(replace(raw_text, '<', '')) AS points FROM s JOIN c USING (doc_id)"""


def q41_threshold_sweep(spark, d):
    scored = table(spark, d, "events").select((F.abs(F.col("value")) % 100 / 100).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return models.best_threshold(scored, "y")


Q41 = """WITH e AS (SELECT abs(value) % 100 / 100 AS p, event_type = 'purchase' AS y FROM events), t AS (SELECT unnest(range(10, 91)) AS t), f AS (SELECT t, 2.0 * count(*) FILTER (p >= t / 100 AND y) / nullif(2.0 * count(*) FILTER (p >= t / 100 AND y) + count(*) FILTER (p >= t / 100 AND NOT y) + count(*) FILTER (p < t / 100 AND y), 0) AS f FROM e, t GROUP BY t)
SELECT median(t) / 100 AS threshold FROM f WHERE coalesce(f, 0) > (SELECT max(coalesce(f, 0)) FROM f) - 1e-6"""


def q42_audit_rows(spark, d):
    f = planted_fields(spark, d)
    docs = typed(spark, d).where("kind <> 'UNKNOWN'").select("doc_id", F.concat(F.lit("scan/"), "doc_id").alias("image_path"), F.sha2("ocr_raw_text", 256).alias("document_hash"), "document_type", F.lit(10).alias("fraud_risk_score"), F.lit("Genuine").alias("final_decision"))
    rows = sinks.audit_rows(docs.select("doc_id", "document_type", "fraud_risk_score", "final_decision"), f, docs, f"{AS_OF} 00:00:00")
    return rows.select("file_path", "document_hash", "document_type", F.get_json_object("extracted_fields", "$.dob").alias("dob"), F.get_json_object("extracted_fields", "$.name").alias("name"), "pipeline_version")


Q42 = f"{C} SELECT 'scan/' || doc_id AS file_path, sha256(raw_text) AS document_hash, kind AS document_type, dob, CASE WHEN m % 13 = 5 THEN 'NOT_FOUND' ELSE name END AS name, '1.0.0' AS pipeline_version FROM c WHERE kind <> 'UNKNOWN'"


def q43_line_pairs(spark, d):
    """Names and those of the next line, for values that run over two lines."""
    lines = F.concat(text.lines(F.col("ocr_raw_text")), F.array())
    return typed(spark, d).select("doc_id", F.posexplode(lines).alias("line", "t"), lines.alias("all")).select("doc_id", "line", text.uppercase_name(F.col("t")).alias("name"), text.is_valid_name(text.uppercase_name(F.col("t"))).alias("valid"), F.coalesce(F.get("all", F.col("line") + 1), F.lit("")).alias("next"))


_HEADERS = ", ".join(f"'{w}'" for w in text.HEADER_WORDS)
Q43 = rf"""{C}, l AS (SELECT doc_id, unnest(range(len(string_split(raw_text, chr(10))))) AS line, unnest(string_split(raw_text, chr(10))) AS t FROM c),
p AS (SELECT *, regexp_replace(regexp_replace(t, '^[^a-zA-Z0-9]+', ''), '(?i)^(?:name|father|fathers|father''s|mother|mothers|mother''s|dob|yob|birth|gender|male|female)\s*[:\-]?\s*', '') AS r FROM l),
q AS (SELECT *, list_filter(string_split(r, ' '), lambda x: x <> '') AS ws FROM p),
u AS (SELECT *, list_transform(ws, lambda x: CASE WHEN regexp_replace(x, '[^a-zA-Z]', '', 'g') <> '' AND regexp_replace(x, '[^a-zA-Z]', '', 'g') = upper(regexp_replace(x, '[^a-zA-Z]', '', 'g')) THEN 'U' WHEN regexp_matches(x, '[a-z]') THEN 'l' ELSE '-' END) AS ks FROM q),
g AS (SELECT *, list_position(ks, 'U') AS first FROM u), e AS (SELECT *, list_position(ks[first:], 'l') AS stop FROM g),
n AS (SELECT doc_id, line, t, CASE WHEN first IS NULL THEN '' ELSE array_to_string(list_transform(list_filter(list_zip(ws, ks)[first : CASE WHEN stop IS NULL THEN len(ws) ELSE first + stop - 2 END], lambda z: z[2] = 'U'), lambda z: regexp_replace(z[1], '[^a-zA-Z.]', '', 'g')), ' ') END AS name FROM e),
o AS (SELECT doc_id, line, t, CASE WHEN length(regexp_replace(name, '[^a-zA-Z]', '', 'g')) >= 3 THEN name ELSE 'NOT_FOUND' END AS name FROM n)
SELECT doc_id, line, name, name <> 'NOT_FOUND' AND length(regexp_replace(upper(name), '[^A-Z]', '', 'g')) >= 3 AND NOT list_has_any(string_split(upper(name), ' '), [{_HEADERS}]) AS valid, coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY line), '') AS next FROM o"""


def q44_overrides(spark, d):
    docs = typed(spark, d)
    chosen = docs.where("m % 4 = 1").select("doc_id", F.lit("PAN").alias("document_type"))
    return merge.with_overrides(docs.select("doc_id", "document_type"), chosen)


Q44 = f"{C} SELECT doc_id, CASE WHEN m % 4 = 1 THEN 'PAN' ELSE kind END AS document_type FROM c"


QUERIES = {
    "q01_verdicts": q01_verdicts, "q02_clean_text": q02_clean_text, "q03_digit_maps": q03_digit_maps, "q04_mrz_check": q04_mrz_check, "q05_normalize_date": q05_normalize_date, "q06_age_rules": q06_age_rules,
    "q07_levenshtein": q07_levenshtein, "q08_keyword_scores": q08_keyword_scores, "q09_regex_scores": q09_regex_scores, "q10_document_types": q10_document_types, "q11_fallback_types": q11_fallback_types,
    "q12_word_boxes": q12_word_boxes, "q13_box_overlap": q13_box_overlap, "q14_line_clusters": q14_line_clusters, "q15_widest_gap": q15_widest_gap, "q16_candidate_ranks": q16_candidate_ranks,
    "q17_dedupe_first": q17_dedupe_first, "q18_nearest_anchor": q18_nearest_anchor, "q19_aadhaar_fields": fields_of("AADHAAR"), "q20_pan_fields": fields_of("PAN"), "q21_passport_fields": fields_of("PASSPORT"),
    "q22_licence_fields": fields_of("DRIVING_LICENCE"), "q23_validations": q23_validations, "q24_validation_summary": q24_validation_summary, "q25_metadata_signals": q25_metadata_signals, "q26_layout_signals": q26_layout_signals,
    "q27_text_features": q27_text_features, "q28_risk_scores": q28_risk_scores, "q29_full_verification": q29_full_verification, "q30_attribution": q30_attribution, "q31_page_merge": q31_page_merge, "q32_fallback_fill": q32_fallback_fill,
    "q33_audit_statistics": q33_audit_statistics, "q34_audit_rollup": q34_audit_rollup, "q35_field_table": q35_field_table, "q36_pixel_quality": q36_pixel_quality, "q37_trained_scores": q37_trained_scores, "q38_picture_splits": q38_picture_splits,
    "q39_ocr_tokens": q39_ocr_tokens, "q40_mrz_indicators": q40_mrz_indicators, "q41_threshold_sweep": q41_threshold_sweep, "q42_audit_rows": q42_audit_rows, "q43_line_pairs": q43_line_pairs, "q44_overrides": q44_overrides, "q45_token_confidence": q45_token_confidence,
    "q46_page_order": q46_page_order, "q47_highlights": q47_highlights, "q48_display_text": q48_display_text, "q49_failed_rules": q49_failed_rules, "q50_picture_repair": q50_picture_repair, "q51_file_tags": q51_file_tags, "q52_pdf_reports": q52_pdf_reports, "q53_audit_log": q53_audit_log, "q54_split_passports": q54_split_passports, "q55_resized_pictures": q55_resized_pictures, "q56_field_features": q56_field_features, "q57_candidate_scores": q57_candidate_scores, "q58_number_highlights": q58_number_highlights,
}

SQL = {
    "q01_verdicts": Q01, "q02_clean_text": Q02, "q03_digit_maps": Q03, "q04_mrz_check": Q04, "q05_normalize_date": Q05, "q06_age_rules": Q06, "q07_levenshtein": Q07, "q08_keyword_scores": Q08, "q09_regex_scores": Q09,
    "q10_document_types": Q10, "q11_fallback_types": Q11, "q12_word_boxes": Q12, "q13_box_overlap": Q13, "q14_line_clusters": Q14, "q15_widest_gap": Q15, "q17_dedupe_first": Q17, "q18_nearest_anchor": Q18, "q19_aadhaar_fields": Q19,
    "q20_pan_fields": Q20, "q21_passport_fields": Q21, "q22_licence_fields": Q22, "q23_validations": Q23, "q24_validation_summary": Q24, "q25_metadata_signals": Q25, "q26_layout_signals": Q26, "q27_text_features": Q27, "q28_risk_scores": Q28,
    "q30_attribution": Q30, "q31_page_merge": Q31, "q32_fallback_fill": Q32, "q33_audit_statistics": Q33, "q34_audit_rollup": Q34, "q35_field_table": Q35, "q36_pixel_quality": Q36, "q38_picture_splits": Q38, "q39_ocr_tokens": Q39,
    "q40_mrz_indicators": Q40, "q41_threshold_sweep": Q41, "q42_audit_rows": Q42, "q43_line_pairs": Q43, "q44_overrides": Q44, "q45_token_confidence": Q45,
    "q46_page_order": Q46, "q47_highlights": Q47, "q48_display_text": Q48, "q49_failed_rules": Q49, "q50_picture_repair": Q50, "q51_file_tags": Q51, "q52_pdf_reports": Q52, "q53_audit_log": Q53, "q54_split_passports": Q54, "q55_resized_pictures": Q55, "q56_field_features": Q56, "q57_candidate_scores": Q57, "q58_number_highlights": Q58,
}
