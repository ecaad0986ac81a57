"""PDF reports as a column: objects, pages and cross-reference table, built by Spark's own functions.

All characters are Latin-1, so that a string's length is its length in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import display_name

#: Lines of a page, letters of a line.
PAGE_LINES, LINE_LETTERS = 56, 95
#: Colours of a verdict and of a status, as red, green and blue from 0 to 1.
COLOURS = {"Genuine": "0.157 0.655 0.271", "Suspicious": "0.863 0.208 0.271", "PASS": "0.157 0.655 0.271", "WARN": "1 0.757 0.027", "FAIL": "0.863 0.208 0.271"}
OTHER, TITLE, BODY = "1 0.757 0.027", "0 0.2 0.4", "0 0 0"
HEADER = "%PDF-1.4\n"


def line(text: Column, colour: Column | str = BODY) -> Column:
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), (colour if isinstance(colour, Column) else F.lit(colour)).alias("colour"))


def colour_of(word: Column) -> Column:
    out = F.lit(OTHER)
    for w, colour in COLOURS.items():
        out = F.when(word == w, colour).otherwise(out)
    return out


def wrapped(lines: Column, letters: int = LINE_LETTERS) -> Column:
    """Lines of at most so many letters; control characters become spaces, others beyond Latin-1 question marks."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, "[\\x00-\\x1F\\x7F-\\x9F]", " "), "[^\\x20-\\xFF]", "?")
    parts = lambda t: F.when(t == "", F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(.{{1,{letters}}})")))
    return F.flatten(F.transform(lines, lambda x: F.transform(parts(plain(x["text"])), lambda t: F.struct(t.alias("text"), x["colour"].alias("colour")))))


def content(lines: Column) -> Column:
    """What draws a page's lines, from the top."""
    shown = lambda x: F.concat(x["colour"], F.lit(" rg ("), F.regexp_replace(x["text"], r"([\\()])", r"\\$1"), F.lit(") Tj T*"))
    return F.concat(F.lit("BT /F1 9 Tf 12 TL 40 742 Td\n"), F.array_join(F.transform(lines, shown), "\n"), F.lit("\nET"))


def pdf(lines: Column, page_lines: int = PAGE_LINES) -> Column:
    """A PDF file (binary) of lines (text, colour), at least one page."""

    def of_pages(pages: Column) -> Column:
        count = F.size(pages)
        kids = F.array_join(F.transform(pages, lambda _, k: F.concat((4 + 2 * k).cast("string"), F.lit(" 0 R"))), " ")
        tree = F.concat(F.lit("<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), count.cast("string"), F.lit(" >>"))
        page = lambda k: F.concat(F.lit("<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents "), (5 + 2 * k).cast("string"), F.lit(" 0 R >>"))
        drawn = lambda p: let(content(p), lambda c: F.concat(F.lit("<< /Length "), F.length(c).cast("string"), F.lit(" >>\nstream\n"), c, F.lit("\nendstream")))
        first = F.array(F.lit("<< /Type /Catalog /Pages 2 0 R >>"), tree, F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"))
        bodies = F.concat(first, F.flatten(F.transform(pages, lambda p, k: F.array(page(k), drawn(p)))))
        return let(F.transform(bodies, lambda b, k: F.concat((k + 1).cast("string"), F.lit(" 0 obj\n"), b, F.lit("\nendobj\n"))), of_objects)

    def of_objects(objects: Column) -> Column:
        begin = F.struct(F.lit(len(HEADER)).alias("at"), F.lit("0000000000 65535 f \n").alias("rows"))
        table = F.aggregate(objects, begin, lambda s, o: F.struct((s["at"] + F.length(o)).alias("at"), F.concat(s["rows"], F.lpad(s["at"].cast("string"), 10, "0"), F.lit(" 00000 n \n")).alias("rows")))
        count = (F.size(objects) + 1).cast("string")
        end = lambda t: F.concat(F.lit("xref\n0 "), count, F.lit("\n"), t["rows"], F.lit("trailer\n<< /Size "), count, F.lit(" /Root 1 0 R >>\nstartxref\n"), t["at"].cast("string"), F.lit("\n%%EOF\n"))
        return F.concat(F.lit(HEADER), F.array_join(objects, ""), let(table, end))

    paged = let(lines, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / page_lines).cast("int"))), lambda k: F.slice(x, k * page_lines + 1, page_lines)))
    return F.encode(let(paged, of_pages), "ISO-8859-1")


def report_pdf(docs: DataFrame, fields: DataFrame, validations: DataFrame, signals: DataFrame, scores: DataFrame, stamp: str) -> DataFrame:
    """doc_id and pdf: a report of each row of scores with its fields, validations and, if any, signals.

    docs: doc_id, image_path. A document without fields or validations has their titles
    alone. One shuffle of each table by document; a document's rows meet in one array.
    """

    def listed(table: DataFrame, order: str, row: Column, name: str) -> DataFrame:
        return table.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, row.alias("row")))), lambda x: x["row"]).alias(name))

    cells = lambda *cs: F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])
    c = F.col
    own = listed(fields, "field_seq", line(cells(display_name(c("field_name")), c("value"), F.concat(F.floor(F.round(c("confidence") * 100, 6)).cast("int").cast("string"), F.lit("%")))), "f")
    checked = listed(validations, "seq", line(cells(display_name(c("field_name")), c("status"), F.concat(F.lit("Exp: "), F.coalesce("expected", F.lit(""))), F.concat(F.lit("Act: "), F.coalesce("actual", F.lit("")))), colour_of(c("status"))), "v")
    marked = listed(signals, "seq", line(cells(c("source"), F.concat_ws(": ", "name", "description"), F.concat(F.lit("+"), c("score").cast("string"))), COLOURS["FAIL"]), "s")
    joined = scores.join(docs.select("doc_id", "image_path"), "doc_id", "left").join(own, "doc_id", "left").join(checked, "doc_id", "left").join(marked, "doc_id", "left")
    none = F.array().cast("array<struct<text:string,colour:string>>")
    title = lambda t: line(F.lit(t), TITLE)
    empty = line(F.lit(""))
    of = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")))
    head = F.array(
        title("Audit Report"), empty, line(of("Document Type", c("document_type"))), line(of("Verdict Status", c("final_decision")), colour_of(c("final_decision"))),
        line(F.concat(of("Risk Score", c("fraud_risk_score")), F.lit("/100"))), line(F.concat(of("Authenticity Score", c("authenticity_score")), F.lit("/100"))),
        line(F.concat(of("Extraction Reliability", c("extraction_reliability")), F.lit("/100"))), line(F.lit(f"Timestamp: {stamp}")), line(of("Image File", F.substring_index("image_path", "/", -1))),
    )
    rows = F.concat(
        head, F.array(empty, title("Extracted Fields")), F.coalesce("f", none), F.array(empty, title("Field Validation Rules")), F.coalesce("v", none),
        F.when(F.size("s") > 0, F.concat(F.array(empty, title("Fraud Risk Signal Analysis")), c("s"))).otherwise(none),
    )
    return joined.select("doc_id", pdf(wrapped(rows)).alias("pdf"))
