"""Expected values of single functions."""

import pytest
from pyspark.sql import functions as F

from idlattice.functions import checksum, dates, scores, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("number,good", [("200000079195", True), ("200000158386", True), ("200000554332", True), ("2000 0007 9195", True), ("200000079196", False), ("123", False), ("12345678901A", False), ("", False), (None, False)])
def test_verhoeff(spark, number, good):
    assert value(spark, checksum.verhoeff_valid(F.lit(number).cast("string"))) is good


def test_verhoeff_digit_closes_any_number(spark):
    rows = spark.range(500).selectExpr("cast(20000000000 + id * 7919 as string) b")
    assert rows.select(checksum.verhoeff_valid(F.concat("b", checksum.verhoeff_digit(F.col("b")).cast("string"))).alias("g")).where("not g").count() == 0


def test_tables_are_a_group():
    d, p = checksum.dihedral_table(), checksum.permutation_table()
    assert all(sorted(r) == list(range(10)) for r in [*d, *p]) and len(p) == 8
    assert all(d[d[a][b]][c] == d[a][d[b][c]] for a in range(10) for b in range(10) for c in range(10))
    assert d[1][5] == 6 and d[5][1] == 9 and d[9][9] == 0 and p[7] == [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]


@pytest.mark.parametrize("zone,digit", [("K7654321<", 4), ("880314", 8), ("310701", 4), ("", 0)])
def test_mrz_digit(spark, zone, digit):
    assert value(spark, checksum.mrz_digit(F.lit(zone))) == digit


def test_mrz_line(spark):
    line = "K7654321<4IND8803148F3107014<<<<<<<<<<<<<<00"
    assert [c.good for c in value(spark, checksum.mrz_checks(F.lit(line)))] == [True] * 4
    wrong = line[:15] + "9" + line[16:]
    assert [c.field_name for c in value(spark, checksum.mrz_checks(F.lit(wrong))) if not c.good] == ["mrz_dob_checksum", "mrz_composite_checksum"]
    assert [c.field_name for c in value(spark, checksum.mrz_checks(F.lit(line[:43])))] == ["mrz_layout"]


@pytest.mark.parametrize(
    "raw,iso",
    [("19D8-50-52", "1985-05-24"), ("20M2-30-00", "2023-01-01"), ("19O8-O5-2Z", "1908-05-22"), ("31/13/2020", "2020-01-31"), ("1990", "1990-09-01"), ("2014", None), ("15/08/1990", "1990-08-15"), ("15.08.41", "1941-08-15"), ("15.08.40", "2040-08-15"),
     ("30/02/2001", "2002-01-20"), ("no date", None), ("", None), (None, None)],
)
def test_normalize_date(spark, raw, iso):
    assert value(spark, dates.normalize_date(F.lit(raw).cast("string"))) == iso


@pytest.mark.parametrize("born,on,years", [("2004-02-29", "2025-02-28", 20), ("2004-02-29", "2025-03-01", 21), ("2000-01-01", "2000-12-31", 0)])
def test_age(spark, born, on, years):
    assert value(spark, dates.age(F.to_date(F.lit(born)), F.to_date(F.lit(on)))) == years


@pytest.mark.parametrize("zone,birth,iso", [("880314", True, "1988-03-14"), ("260101", True, "2026-01-01"), ("270101", True, "1927-01-01"), ("310701", False, "2031-07-01"), ("31<701", False, None)])
def test_mrz_date(spark, zone, birth, iso):
    assert value(spark, dates.mrz_date(F.lit(zone), birth)) == iso


@pytest.mark.parametrize(
    "line,name",
    [("Name: ASHA RANI MEHTA", "ASHA RANI MEHTA"), ("ASHA MEHTA abc DEF", "ASHA MEHTA"), ("12 ASHA", "ASHA"), ("A. B", "NOT_FOUND"), ("lower only", "NOT_FOUND"), ("", "NOT_FOUND"), ("  -- DOB: KIRAN D. BOSE 12", "KIRAN D. BOSE")],
)
def test_uppercase_name(spark, line, name):
    assert value(spark, text.uppercase_name(F.lit(line))) == name


@pytest.mark.parametrize("name,number,good", [("ASHA MEHTA", None, True), ("GOVERNMENT OF INDIA", None, False), ("AB", None, False), ("NOT_FOUND", None, False), ("ABCPM", "ABCPM1234K", False), (None, None, False)])
def test_is_valid_name(spark, name, number, good):
    assert value(spark, text.is_valid_name(F.lit(name).cast("string"), None if number is None else F.lit(number))) is good


def test_look_alikes(spark):
    assert value(spark, text.normalize_ocr(F.lit("MH032Ol40I23456"), True)) == "MH0320140123456"
    assert value(spark, text.correct_digits(F.lit("O1lZSBgG|!"))) == "0112589611"
    assert value(spark, text.match_digits(F.lit("OQlZ"))) == "0012"
    assert value(spark, text.correct_numeric_field(F.lit("OIBSZ"))) == "0185Z"


@pytest.mark.parametrize("a,b,ratio", [("abc", "ABC", 1.0), ("", "a", 0.0), ("", "", 1.0), ("kitten", "sitting", 1 - 3 / 7)])
def test_levenshtein(spark, a, b, ratio):
    assert value(spark, text.levenshtein_ratio(F.lit(a), F.lit(b))) == pytest.approx(ratio)


@pytest.mark.parametrize("a,b,same", [("12-3 4", "1234", True), ("ASHA MEHTA", "MEHTA", True), ("O1", "01", True), ("x", "y", False), ("", "y", False)])
def test_texts_agree(spark, a, b, same):
    assert value(spark, text.texts_agree(F.lit(a), F.lit(b))) is same


def test_scores(spark):
    assert value(spark, scores.to_score(F.lit(0.125))) == 12 and value(spark, scores.to_score(F.lit(1.7))) == 100
    assert value(spark, scores.sigmoid(F.lit(1.0))) == pytest.approx(0.7914, abs=1e-4) and value(spark, scores.sigmoid(F.lit(2.0))) == pytest.approx(0.9907, abs=1e-4)
    assert [value(spark, scores.verdict(F.lit(a), F.lit(r))) for a, r in ((75, 25), (39, 10), (80, 60), (60, 40))] == ["Genuine", "Suspicious", "Suspicious", "Needs Manual Review"]
    assert value(spark, scores.ratio(F.lit(1), F.lit(0))) == 0.0
    assert [value(spark, scores.risk_tier(F.lit(x))) for x in (20, 50, 75, 76)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_small_text_helpers(spark):
    assert value(spark, text.slug(F.lit("Needs Manual Review"))) == "needs-manual-review"
    assert value(spark, text.first_match(F.lit("a12 b34"), "([a-z])([0-9]+)", 2)) == "12"
    assert value(spark, text.first_match(F.lit("none"), "[0-9]+")) is None
    assert value(spark, text.clean_and_normalize(F.lit("B-lO 5"), True)) == "8105"
    assert value(spark, text.clean_and_normalize(F.lit(None).cast("string"))) == ""
