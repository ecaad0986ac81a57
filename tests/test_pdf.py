import re
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idlattice.sources import pdf, pdf_report


def table_file(objects, compress=True):
    """A file with a cross-reference table; objects: number to (dict text, stream bytes or None)."""
    out, places = b"%PDF-1.4\n", {}
    for n, (about, stream) in objects.items():
        places[n] = len(out)
        if stream is not None:
            about = about.replace("LEN", str(len(stream)))
        out += f"{n} 0 obj\n{about}".encode() + (b"\nstream\r\n" + stream + b"\nendstream" if stream is not None else b"") + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in sorted(places))
    return out + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF".encode()


def stream_file(objects, predictor):
    """A file with a cross-reference stream; objects without a stream lie in an object stream."""
    inside = {n: about.encode() for n, (about, s) in objects.items() if s is None}
    holder, table = max(objects) + 1, max(objects) + 2
    head, body = "", b""
    for n, about in inside.items():
        head += f"{n} {len(body)} "
        body += about + b" "
    packed = zlib.compress(head.encode() + body)
    outer = {n: x for n, x in objects.items() if x[1] is not None} | {holder: (f"<< /Type /ObjStm /N {len(inside)} /First {len(head)} /Filter /FlateDecode /Length LEN >>", packed)}
    out, rows = b"%PDF-1.5\n", {0: (0, 0, 65535)}
    for n, (about, stream) in outer.items():
        rows[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n{about.replace('LEN', str(len(stream)))}\nstream\n".encode() + stream + b"\nendstream\nendobj\n"
    rows |= {n: (2, holder, k) for k, n in enumerate(inside)}
    rows[table] = (1, len(out), 0)
    data = [struct.pack(">BIH", *rows[n]) for n in sorted(rows)]
    settings = ""
    if predictor:
        above = [bytes(7), *data]
        data = [b"\x02" + bytes((x - y) & 255 for x, y in zip(row, up, strict=True)) for row, up in zip(data, above[:-1], strict=True)]
        settings = "/DecodeParms << /Predictor 12 /Columns 7 >>"
    packed, at = zlib.compress(b"".join(data)), len(out)
    out += f"{table} 0 obj\n<< /Type /XRef /W [1 4 2] /Size {table + 1} /Root 1 0 R /Filter /FlateDecode {settings} /Length {len(packed)} >>\nstream\n".encode() + packed
    return out + f"\nendstream\nendobj\nstartxref\n{at}\n%%EOF".encode()


JPEG = b"\xff\xd8 any picture \xff\xd9"
GREY = bytes(range(12))


def document(picture="jpeg"):
    shown = zlib.compress(rb"q /Im1 Do Q BT /F1 9 Tf 40 700 Td (First \(line\)) Tj 0 -12 Td [(Sec) 20 (ond) -300 (line)] TJ 100 0 Td <7461626265> Tj T* (caf\351) Tj ET")
    image = {"jpeg": ("<< /Subtype /Image /Width 4 /Height 3 /Filter /DCTDecode /Length LEN >>", JPEG),
             "grey": ("<< /Subtype /Image /Width 4 /Height 3 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /Length LEN >>", zlib.compress(GREY))}[picture]
    return {
        1: ("<< /Type /Catalog /Pages 2 0 R >>", None), 2: ("<< /Type /Pages /Kids [3 0 R 7 0 R] /Count 2 /Resources << /XObject << /Im1 6 0 R >> >> >>", None),
        3: ("<< /Type /Pages /Parent 2 0 R /Kids [4 0 R] /Count 1 >>", None), 4: ("<< /Type /Page /Parent 3 0 R /Contents [5 0 R] >>", None),
        5: ("<< /Filter /FlateDecode /Length LEN >>", shown), 6: image, 7: ("<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>", None), 8: ("<< /Length LEN >>", b"BT (Second page) Tj ET"),
    }


FIRST = "First (line)\nSecond line\ttabbe\ncafé"


@pytest.mark.parametrize("build", [table_file, lambda o: stream_file(o, False), lambda o: stream_file(o, True)])
def test_all_table_forms(build):
    data = build(document())
    assert pdf.read(data) == ([FIRST], JPEG, "jpeg", None)
    assert pdf.read(data, None)[0] == [FIRST, "Second page"]
    # Without a usable table the objects are looked for.
    assert pdf.read(re.sub(rb"startxref\n\d+", b"startxref\n9999999", data)) == ([FIRST], JPEG, "jpeg", None)


def test_pixels_become_a_picture_file():
    _, picture, kind, error = pdf.read(table_file(document("grey")))
    assert (kind, error) == ("png", None) and picture[:8] == b"\x89PNG\r\n\x1a\n"
    size = int.from_bytes(picture[33:37], "big")
    assert picture[16:24] == struct.pack(">II", 4, 3) and zlib.decompress(picture[41 : 41 + size]) == b"".join(b"\0" + GREY[k : k + 4] for k in (0, 4, 8))


def test_png_filters():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 22, 33, 44]), bytes([5, 6, 7, 8]), bytes([90, 80, 70, 60]), bytes([1, 2, 3, 4])]

    def paeth(a, b, c):
        p = a + b - c
        return min((a, b, c), key=lambda x: abs(p - x))

    data, above = b"", bytes(4)
    for kind, row in enumerate(rows):
        left, corner = bytes(1) + row[:-1], bytes(1) + above[:-1]
        guess = [bytes(4), left, above, bytes((a + b) // 2 for a, b in zip(left, above, strict=True)), bytes(paeth(a, b, c) for a, b, c in zip(left, above, corner, strict=True))][kind]
        data += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    assert pdf.unfiltered(data, 4, 1, 8) == b"".join(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3000), st.binary(max_size=8), st.booleans())
def test_damaged_files_give_an_error_or_what_is_left(at, other, cut):
    whole = stream_file(document(), True) if cut else table_file(document())
    texts, _, _, error = pdf.read(whole[:at] + other + whole[at + len(other) :])
    assert error is None or isinstance(error, str)
    pdf.read(whole[:at])


def test_circles_and_bombs_end():
    circle = {1: ("<< /Type /Catalog /Pages 2 0 R >>", None), 2: ("<< /Type /Pages /Kids [2 0 R 2 0 R] /Count 2 >>", None)}
    assert pdf.read(table_file(circle))[3] == "no page"
    endless = document() | {5: ("<< /Filter /FlateDecode /Length LEN >>", zlib.compress(b" " * (pdf.MOST_BYTES + 10)))}
    assert pdf.read(table_file(endless))[3] == "a stream is too large"
    begin = time.perf_counter()
    assert pdf.read(b"%PDF-1.4\n" + b"[" * 200_000)[3] and pdf.read(b"%PDF-1.4\n" + b"1 0 obj (" * 20_000)[3]
    assert time.perf_counter() - begin < 5


def test_column_has_a_row_per_file(spark):
    rows = [(1, table_file(document()), "x"), (2, b"no pdf", "y"), (3, None, None), (4, stream_file(document(), True)[:300], "z")]
    got = {r.doc_id: r for r in pdf.with_first_page(spark.createDataFrame(rows, "doc_id long, content binary, error string")).collect()}
    assert (got[1].page_texts, bytes(got[1].picture), got[1].picture_kind, got[1].error) == ([FIRST], JPEG, "jpeg", None)
    assert all(got[k].error and got[k].picture is None for k in (2, 3, 4))


def report(spark, n_fields):
    docs = spark.createDataFrame([(1, "scan/ä/(one).jpg"), (2, None)], "doc_id long, image_path string")
    fields = spark.createDataFrame([(1, k, f"field_{k}", f"value (\\) {k} ünï 北 {'long ' * (40 if k == 3 else 0)}", 0.29) for k in range(n_fields)], "doc_id long, field_seq int, field_name string, value string, confidence double")
    checks = spark.createDataFrame([(1, 1, "dob", "FAIL", "a", None), (1, 0, "pan_number", "PASS", None, "b")], "doc_id long, seq int, field_name string, status string, expected string, actual string")
    marks = spark.createDataFrame([(1, 0, "layout", "overlap", "x / y", 25)], "doc_id long, seq int, source string, name string, description string, score int")
    scores = spark.createDataFrame([(1, "PAN", "Genuine", 10, 90, 80), (2, "PASSPORT", "Suspicious", 70, 20, 0)], "doc_id long, document_type string, final_decision string, fraud_risk_score int, authenticity_score int, extraction_reliability int")
    return pdf_report.report_pdf(docs, fields, checks, marks, scores, "2026-01-01 00:00:00")


def test_reports_read_back_whole(spark):
    read = {r.doc_id: r for r in pdf.with_first_page(report(spark, 200).withColumnRenamed("pdf", "content"), most=None).collect()}
    assert all(r.error is None for r in read.values())
    assert len(read[1].page_texts) == 4 and len(read[2].page_texts) == 1
    lines = "\n".join(read[1].page_texts).split("\n")
    for k in range(200):
        if k != 3:
            assert f"Field {k} | value (\\) {k} ünï ?  | 29%" in lines
    assert "".join(x for x in lines if "long" in x).count("long") == 40 and max(map(len, lines)) <= pdf_report.LINE_LETTERS
    assert lines[-4:] == ["Pan Number | PASS | Exp:  | Act: b", "Dob | FAIL | Exp: a | Act:", "Fraud Risk Signal Analysis", "layout | overlap: x / y | +25"]
    assert read[2].page_texts[0].split("\n") == ["Audit Report", "Document Type: PASSPORT", "Verdict Status: Suspicious", "Risk Score: 70/100", "Authenticity Score: 20/100", "Extraction Reliability: 0/100", "Timestamp: 2026-01-01 00:00:00", "Image File:", "Extracted Fields", "Field Validation Rules"]


def test_places_in_the_table_are_right(spark):
    for r in report(spark, 120).collect():
        data = bytes(r.pdf)
        at = int(re.search(rb"startxref\n(\d+)", data)[1])
        assert data[at : at + 4] == b"xref"
        for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n ", data), 1):
            assert data[int(place) :].startswith(f"{n} 0 obj\n".encode())
        for m in re.finditer(rb"/Length (\d+) >>\nstream\n", data):
            assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")


def test_no_lines_give_a_page(spark):
    empty = spark.range(1).select(pdf_report.pdf(F.array().cast("array<struct<text:string,colour:string>>")).alias("p")).first().p
    assert pdf.read(bytes(empty), None) == ([""], None, None, None)
