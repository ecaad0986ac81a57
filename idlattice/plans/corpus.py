"""Synthetic identity documents, derived arithmetically from customer keys.

One statement in two dialects makes the same documents in Spark and in the SQL
that checks the results. Key k gives the type (k % 5; the fifth is no identity
document); m = k / 5 gives names, dates and planted defects. Names are invented.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bind import let
from ..functions.checksum import dihedral_table, permutation_table
from ..functions.text import lines, tokens
from .storage import spread

AS_OF = "2026-01-01"
FIRST = "ASHA RAVI MEENA KIRAN VIJAY LEELA SANJAY NEHA ARJUN DIYA ROHAN".split()
LAST = "MEHTA IYER KULKARNI BOSE REDDY NAIR SINGHANIA DAS GHOSH PATIL VERMA JOSHI CHAWLA".split()
INVERSE = [next(b for b in range(10) if row[b] == 0) for row in dihedral_table()]


def pick(words: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


class Spark:
    """Spellings in which the dialects differ."""

    @staticmethod
    def verhoeff(digits: str, n: int = 11) -> str:
        d = "array(" + ",".join(str(x) for row in dihedral_table() for x in row) + ")"
        p = "array(" + ",".join(str(x) for row in permutation_table() for x in row) + ")"
        inverse = f"array({','.join(map(str, INVERSE))})"
        return f"CAST(get({inverse}, aggregate(sequence(1, {n}), 0, (c, i) -> get({d}, c * 10 + get({p}, (i % 8) * 10 + CAST(substr({digits}, {n + 1} - i, 1) AS INT))))) AS STRING)"

    @staticmethod
    def mrz(zone: str) -> str:
        value = "CASE WHEN substr(z, i, 1) BETWEEN '0' AND '9' THEN ascii(substr(z, i, 1)) - 48 WHEN substr(z, i, 1) BETWEEN 'A' AND 'Z' THEN ascii(substr(z, i, 1)) - 55 ELSE 0 END"
        return f"CAST(get(transform(array({zone}), z -> aggregate(sequence(1, length(z)), 0, (s, i) -> s + ({value}) * CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END) % 10), 0) AS STRING)"


class Duck:
    @staticmethod
    def verhoeff(digits: str, n: int = 11) -> str:
        d, p = dihedral_table(), permutation_table()
        return f"CAST({INVERSE}[list_reduce(list_prepend(0, [{p}[(i % 8) + 1][CAST(substr({digits}, CAST({n + 1} - i AS BIGINT), 1) AS INT) + 1] for i in range(1, {n + 1})]), lambda c, x: {d}[c + 1][x + 1]) + 1] AS VARCHAR)"

    @staticmethod
    def mrz(zone: str) -> str:
        value = "CASE WHEN substr(z, i, 1) BETWEEN '0' AND '9' THEN ascii(substr(z, i, 1)) - 48 WHEN substr(z, i, 1) BETWEEN 'A' AND 'Z' THEN ascii(substr(z, i, 1)) - 55 ELSE 0 END"
        return f"CAST(list_transform([{zone}], lambda z: CAST(list_sum([({value}) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, length(z) + 1)]) AS BIGINT) % 10)[1] AS VARCHAR)"


def corpus_sql(dialect: type, source: str = "customer") -> str:
    """Columns: doc_id, k, m, kind, the planted values, ocr_confidence, raw_text."""
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    if dialect is Duck:
        two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    text = "VARCHAR" if dialect is Duck else "STRING"
    return f"""
SELECT *, CASE kind
    WHEN 'AADHAAR' THEN 'GOVERNMENT OF INDIA' || chr(10) || name || chr(10) || 'DOB: ' || dob_text || chr(10)
      || CASE WHEN k % 17 = 0 THEN '' ELSE gender || chr(10) END || number_text
    WHEN 'PAN' THEN 'INCOME TAX DEPARTMENT' || chr(10) || 'GOVT. OF INDIA' || chr(10) || 'Name' || chr(10) || name || chr(10) || 'Father''s Name' || chr(10) || father || chr(10)
      || 'Date of Birth' || chr(10) || dob_text || chr(10) || 'Permanent Account Number' || chr(10) || number_text
    WHEN 'PASSPORT' THEN 'REPUBLIC OF INDIA' || chr(10) || 'Passport No' || chr(10) || number_text || chr(10) || 'Surname' || chr(10) || last || chr(10) || 'Given Name' || chr(10) || first || chr(10)
      || 'Nationality INDIAN' || chr(10) || 'Date of Birth ' || dob_text || chr(10) || 'Sex: ' || sex || chr(10) || 'Place of Birth' || chr(10) || 'NASHIK' || chr(10)
      || 'Date of Expiry ' || expiry_text || chr(10) || mrz1 || chr(10) || mrz2
    WHEN 'DRIVING_LICENCE' THEN 'UNION OF INDIA' || chr(10) || 'DRIVING LICENCE' || chr(10) || 'DL No ' || number_text || chr(10) || 'Name: ' || name || chr(10) || 'DOB: ' || dob_text || chr(10)
      || 'Valid Till: ' || expiry_text || chr(10) || 'Class of Vehicle' || chr(10) || 'LMV, MCWG' || chr(10) || 'Address: 12 LAKE ROAD'
    ELSE 'Invoice ' || CAST(k AS {text}) || chr(10) || 'total due ' || CAST(m AS {text}) || ' coins' END AS raw_text
FROM (
  SELECT *, 'P<IND' || last || '<<' || first || substr('<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<', 1, CAST(44 - 7 - length(last) - length(first) AS INT)) AS mrz1,
    mrz_head || {dialect.mrz("substr(mrz_head, 1, 10) || substr(mrz_head, 14, 7) || substr(mrz_head, 22, 22)")} AS mrz2
  FROM (
    SELECT *, number || '<' || {dialect.mrz("number || '<'")} || 'IND' || dob_zone || CASE WHEN m % 8 = 0 THEN '9' ELSE {dialect.mrz("dob_zone")} END || sex
        || expiry_zone || {dialect.mrz("expiry_zone")} || '<<<<<<<<<<<<<<0' AS mrz_head,
      CASE kind WHEN 'AADHAAR' THEN substr(number_noisy, 1, 4) || ' ' || substr(number_noisy, 5, 4) || ' ' || substr(number_noisy, 9, 4)
        WHEN 'DRIVING_LICENCE' THEN substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 7) ELSE number END AS number_text
    FROM (
      SELECT *, CASE kind
          WHEN 'AADHAAR' THEN base || CAST((CAST({dialect.verhoeff("base")} AS INT) + CASE WHEN m % 7 = 0 THEN 1 ELSE 0 END) % 10 AS {text})
          WHEN 'PAN' THEN chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + (k * 3) % 26 AS INT)) || 'CP' || CASE WHEN m % 6 = 0 THEN 'Z' ELSE substr(last, 1, 1) END || lpad(CAST((k * 37) % 10000 AS {text}), 4, '0') || chr(CAST(65 + m % 26 AS INT))
          WHEN 'PASSPORT' THEN chr(CAST(65 + m % 26 AS INT)) || CAST(1000000 + (k * 7919) % 9000000 AS {text})
          WHEN 'DRIVING_LICENCE' THEN 'MH' || {two("1 + m % 50")} || CAST(2001 + m % 24 AS {text}) || lpad(CAST((k * 101) % 10000000 AS {text}), 7, '0') END AS number,
        CASE WHEN m % 11 = 3 THEN replace(base || {dialect.verhoeff("base")}, '0', 'O') ELSE base || CAST((CAST({dialect.verhoeff("base")} AS INT) + CASE WHEN m % 7 = 0 THEN 1 ELSE 0 END) % 10 AS {text}) END AS number_noisy,
        first || ' ' || last AS name, father_first || ' ' || last AS father,
        day || CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '-' ELSE '.' END || month || CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '-' ELSE '.' END || year AS dob_text, year || '-' || month || '-' || day AS dob,
        substr(year, 3, 2) || month || day AS dob_zone,
        day || '/' || month || '/' || expiry_year AS expiry_text, expiry_year || '-' || month || '-' || day AS expiry, substr(expiry_year, 3, 2) || month || day AS expiry_zone
      FROM (
        SELECT c_custkey AS doc_id, k, m, CASE k % 5 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'PAN' WHEN 2 THEN 'PASSPORT' WHEN 3 THEN 'DRIVING_LICENCE' ELSE 'UNKNOWN' END AS kind,
          {pick(FIRST, f"m % {len(FIRST)}")} AS first, {pick(FIRST, f"(m + 4) % {len(FIRST)}")} AS father_first, {pick(LAST, f"m % {len(LAST)}")} AS last,
          CASE m % 2 WHEN 0 THEN 'FEMALE' ELSE 'MALE' END AS gender, CASE m % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex,
          CAST(CASE WHEN m % 9 = 0 THEN 2010 ELSE 1960 + m % 40 END AS {text}) AS year, {two("1 + (m * 7) % 12")} AS month, {two("1 + (m * 11) % 28")} AS day,
          CAST(CASE WHEN m % 10 = 0 THEN 2025 ELSE 2027 + m % 8 END AS {text}) AS expiry_year,
          CAST(20000000000 + k * 7919 AS {text}) AS base, (45 + (k * 31) % 54) / 100.0 AS ocr_confidence
        FROM (SELECT c_custkey, c_custkey AS k, CAST(floor(c_custkey / 5) AS BIGINT) AS m FROM {source}) AS keys
      ) AS base_rows
    ) AS numbered
  ) AS headed
) AS zoned
"""


def with_words(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds word_map: word i of line j at left 12 x its place in the line, top 40 j + 10, 12 wide a letter, 20 high."""

    def of_line(line, j):
        place = lambda ws, i: F.length(F.array_join(F.slice(ws, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)
        return let(tokens(line), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), (place(ws, i) * 12).cast("int").alias("left"), (j * 40 + 10).cast("int").alias("top"))))

    box = lambda x, n: F.struct(
        x["w"].alias("text"), x["left"].alias("left"), x["top"].alias("top"), (F.length(x["w"]) * 12).cast("int").alias("width"), F.lit(20).alias("height"),
        ((50 + (F.col("k") * 31 + n * 7) % 50) / 100).cast("double").alias("conf"),
    )
    return docs.withColumn("word_map", F.transform(F.flatten(F.transform(lines(F.col(text)), of_line)), box))


#: The same words as rows, over a table c made by corpus_sql(Duck).
DUCK_WORDS = """
SELECT doc_id, kind, k, row_number() OVER (PARTITION BY doc_id ORDER BY j, i) - 1 AS n, j, i, text,
  12 * (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(ws[1:i], ' ')) + 1 END) AS "left", 40 * j + 10 AS top, 12 * length(text) AS width, 20 AS height
FROM (SELECT doc_id, kind, k, j, ws, unnest(ws) AS text, unnest(range(len(ws))) AS i
      FROM (SELECT doc_id, kind, k, j, string_split(line, ' ') AS ws FROM (SELECT doc_id, kind, k, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS j FROM c)))
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with word maps and EXIF tags, under the names of the engine's input."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    docs = spark.sql(corpus_sql(Spark, "{customer}").replace("{{", "{"), customer=customer)
    tags = F.create_map(
        F.lit("Image Software"), F.when(F.col("m") % 10 == 0, F.lit("Adobe Photoshop 24")).otherwise(F.lit("scanner")),
        F.lit("EXIF DateTimeOriginal"), F.lit("2024:01:01 10:00:00"),
        F.lit("Image DateTime"), F.when(F.col("m") % 12 == 0, F.lit("2024:02:01 10:00:00")).otherwise(F.lit("2024:01:01 10:00:00")),
    )
    return with_words(docs).withColumn("exif_tags", tags).withColumn("ocr_confidence", F.col("ocr_confidence").cast("double")).withColumnRenamed("raw_text", "ocr_raw_text")


def tiff_bytes(software: Column, changed: Column, taken: Column, big: Column) -> Column:
    """A TIFF file whose tags are a program's name and two times, each longer than four bytes, in either byte order."""

    def number(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value), 2 * size, "0")
        return F.unhex(F.when(big, digits).otherwise(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])))

    def entry(tag: int, kind: int, count: Column, value: Column) -> Column:
        return F.concat(number(F.lit(tag), 2), number(F.lit(kind), 2), number(count, 4), number(value, 4))

    ended = lambda t: F.concat(F.encode(t, "UTF-8"), F.unhex(F.lit("00")))
    size = lambda t: F.octet_length(t) + 1
    first = F.lit(8 + 2 + 3 * 12 + 4)
    second = first + size(software)
    inner = second + size(changed)
    return F.concat(
        F.encode(F.when(big, "MM").otherwise("II"), "UTF-8"), number(F.lit(42), 2), number(F.lit(8), 4),
        number(F.lit(3), 2), entry(0x0131, 2, size(software), first), entry(0x0132, 2, size(changed), second), entry(0x8769, 4, F.lit(1), inner), number(F.lit(0), 4), ended(software), ended(changed),
        number(F.lit(1), 2), entry(0x9003, 2, size(taken), inner + 18), number(F.lit(0), 4), ended(taken),
    )


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and content: a file for each document, TIFF or JPEG, of either byte order, every seventh cut off in its directory."""
    times = lambda late: F.when(late, "2024:02:01 10:00:00").otherwise("2024:01:01 10:00:00")
    k = F.col("c_custkey")
    made = tiff_bytes(F.when(k % 10 == 0, "Adobe Photoshop 24").otherwise(F.concat(F.lit("scanner "), k.cast("string"))), times(k % 12 == 0), times(F.lit(False)), k % 2 == 0)
    length = F.lpad(F.hex(F.octet_length(made) + 8), 4, "0")
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE00004AAAAFFE1")), F.unhex(length), F.unhex(F.lit("457869660000")), made, F.unhex(F.lit("FFD9")))
    whole = F.when(k % 3 == 0, jpeg).otherwise(made)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), F.when(k % 7 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("content"))


#: Lines of a drawn passport page stand so many pixels apart; a letter is a pixel as dark as its code.
LINE_PIXELS, PAGE_PIXELS = 16, 120


#: Pictures that drawn gives out at once.
PICTURES_AT_ONCE = 200


def drawn(docs: DataFrame) -> DataFrame:
    """Pictures (pixels, width) of pages side by side, each an array of lines; every letter one pixel on white. docs: doc_id, m, pages."""

    def picture(own: list[list[str]]) -> np.ndarray:
        high = LINE_PIXELS * max(len(lines) for lines in own)
        a = np.full((high, PAGE_PIXELS * len(own)), 255, np.int32)
        for k, lines in enumerate(own):
            for y, line in enumerate(lines):
                letters = np.frombuffer(line.encode(), np.uint8)
                begin = k * PAGE_PIXELS + 4
                a[y * LINE_PIXELS + LINE_PIXELS // 2, begin : begin + len(letters)] = np.where(letters == 32, 255, letters)
        return a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), PICTURES_AT_ONCE):
                own = batch.slice(begin, PICTURES_AT_ONCE)
                made = [picture(p) for p in own.column("pages").to_pylist()]
                ends = np.cumsum([0, *(a.size for a in made)]).astype(np.int32)
                pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in made])))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("m"), pixels, pa.array([a.shape[1] for a in made], pa.int32())], names=["doc_id", "m", "pixels", "width"])

    return docs.mapInArrow(run, "doc_id long, m long, pixels array<int>, width int")


def read_letters(content: bytes) -> tuple[str, float, list[dict] | None]:
    """Reads what drawn draws, from a PGM file; a picture without a letter has no word map."""
    head, data = content.split(b"\n", 1)
    width, height = map(int, head.split()[1:3])
    lines, words = [], []
    for y in range(height):
        row = data[y * width : (y + 1) * width]
        own = [(m.start(), m[0].decode()) for m in re.finditer(rb"[^\xff]+", row)]
        if own:
            lines.append(" ".join(t for _, t in own))
            words += [{"text": t, "left": x, "top": y, "width": len(t), "height": 1, "conf": 0.9} for x, t in own]
    return "\n".join(lines), 0.9, words or None


def passport_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, m, pixels and width of each passport: two pages, the one with the machine-readable lines left or right, every fifth one page; every fourth second page is empty."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    docs = spark.sql(corpus_sql(Spark, "{customer}").replace("{{", "{"), customer=customer).where("kind = 'PASSPORT'")
    first = F.array(F.lit("REPUBLIC OF INDIA"), F.concat(F.lit("Passport No "), "number"), F.lit("Surname"), F.col("last"), F.lit("Given Name"), F.col("first"), F.concat(F.lit("Date of Birth "), "dob_text"), F.concat(F.lit("Date of Expiry "), "expiry_text"), F.lit(""), F.col("mrz1"), F.col("mrz2"))
    second = F.when(F.col("m") % 4 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.lit("Place of Birth"), F.lit("NASHIK"), F.lit("Place of Issue"), F.lit("PUNE")))
    pages = F.when(F.col("m") % 5 == 0, F.array(first)).when(F.col("m") % 2 == 0, F.array(first, second)).otherwise(F.array(second, first))
    return drawn(docs.select("doc_id", "m", pages.alias("pages")))
