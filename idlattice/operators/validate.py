"""Validation of extracted fields: formats, dates, agreement of fields, check digits.

Fields are pivoted to one row per document; each rule is a column, and the rules of a
type become rows in their order of emission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import mrz_checks, verhoeff_valid
from ..functions.dates import age, as_date
from ..functions.text import tokens
from .candidates import NOT_FOUND

FIELDS = [
    "aadhaar_number", "pan_number", "passport_number", "dl_number", "name", "father_name", "dob", "expiry", "validity", "gender", "sex", "nationality",
    "vehicle_class", "place_of_birth", "place_of_issue", "mrz_line1", "mrz_line2",
]
RESULT = "struct<status:string,field_name:string,expected:string,actual:string>"


def wide(fields: DataFrame) -> DataFrame:
    """doc_id, document_type and one column of values for each known field; missing values are null."""
    value = F.when((F.col("value") != NOT_FOUND) & (F.col("value") != ""), F.col("value"))
    return fields.groupBy("doc_id", "document_type").agg(*[F.max(F.when(F.col("field_name") == f, value)).alias(f) for f in FIELDS])


def result(status: Column, name: str, expected: Column | str, actual: Column) -> Column:
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    return F.struct(status.alias("status"), F.lit(name).alias("field_name"), expected.alias("expected"), actual.alias("actual"))


def _passes(test: Column, otherwise: str = "FAIL") -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit("PASS")).otherwise(F.lit(otherwise))


def form(name: str, field: str, test: Column, expected: str, otherwise: Column | None = None) -> Column:
    """PASS for a value in form, FAIL for a missing one, otherwise (FAIL if not given) for the rest."""
    v = F.col(field)
    rest = F.lit("FAIL") if otherwise is None else otherwise
    return result(F.when(v.isNull(), F.lit("FAIL")).when(test, F.lit("PASS")).otherwise(rest), name, expected, F.coalesce(v, F.lit("Missing field")))


def date_form(field: str) -> Column:
    return form(field, field, F.col(field).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "YYYY-MM-DD")


def name_form(field: str) -> Column:
    return form(field, field, F.col(field).rlike(r"^[A-Z\s.]+$"), "Uppercase Alphabetic", F.lit("WARN"))


def formats(kind: str) -> list[Column]:
    if kind == "AADHAAR":
        return [
            form("aadhaar_number_format", "aadhaar_number", F.col("aadhaar_number").rlike("^[0-9]{12}$"), "12 digits"),
            date_form("dob"),
            form("gender_format", "gender", F.col("gender").isin("MALE", "FEMALE", "OTHER"), "MALE/FEMALE/OTHER"),
            name_form("name"),
        ]
    if kind == "PAN":
        return [form("pan_format", "pan_number", F.col("pan_number").rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "5 Letters, 4 Digits, 1 Letter"), date_form("dob"), name_form("name"), name_form("father_name")]
    if kind == "PASSPORT":
        return [form("passport_format", "passport_number", F.col("passport_number").rlike("^[A-Z][0-9]{7}$"), "1 Letter, 7 Digits"), date_form("dob"), date_form("expiry"), name_form("name")]
    long = F.when(F.length("dl_number") >= 10, F.lit("WARN")).otherwise(F.lit("FAIL"))
    return [form("dl_format", "dl_number", F.col("dl_number").rlike("^[A-Z]{2}[0-9]{13}$"), "State+RTO+Year+7 Digits", long), date_form("dob"), date_form("validity"), name_form("name")]


def date_rules(kind: str, as_of: Column) -> list[Column]:
    """Null where the field is missing: no row then."""
    dob = as_date(F.col("dob"))
    years = age(dob, as_of)
    status = F.when(dob.isNull() | (dob > as_of), F.lit("FAIL")).when(years > 120, F.lit("WARN")).otherwise(F.lit("PASS"))
    out = [F.when(F.col("dob").isNotNull(), result(status, "dob_range", "DOB in the past, age at most 120", F.col("dob")))]
    if kind in ("PASSPORT", "DRIVING_LICENCE"):
        field = "expiry" if kind == "PASSPORT" else "validity"
        end = as_date(F.col(field))
        out.append(F.when(F.col(field).isNotNull(), result(F.when(end.isNull(), F.lit("FAIL")).when(end < as_of, F.lit("WARN")).otherwise(F.lit("PASS")), "expiry_range", "Document not expired", F.col(field))))
    if kind == "DRIVING_LICENCE":
        out.append(F.when(dob.isNotNull(), result(_passes(years >= 18), "dl_min_age", "DL holder age >= 18", years.cast("string"))))
    return out


def cross_rules(kind: str) -> list[Column]:
    if kind == "PAN":
        surname = F.upper(F.substring(F.element_at(tokens(F.col("name")), -1), 1, 1))
        fifth = F.upper(F.substring("pan_number", 5, 1))
        both = F.col("pan_number").isNotNull() & F.col("name").isNotNull() & (F.length("pan_number") >= 5)
        return [F.when(both, result(_passes(fifth == surname), "pan_name_consistency", F.concat(F.lit("surname begins with "), fifth), F.col("name")))]
    if kind == "PASSPORT":
        coded = F.col("mrz_line1").isNotNull() & F.col("mrz_line2").isNotNull()
        number = F.replace(F.substring("mrz_line2", 1, 9), F.lit("<"), F.lit(""))
        birth = F.concat(F.substring("dob", 3, 2), F.substring("dob", 6, 2), F.substring("dob", 9, 2))
        return [
            F.when(coded & F.col("passport_number").isNotNull(), result(_passes(F.col("passport_number") == number), "cross_passport_number", number, F.col("passport_number"))),
            F.when(coded & (F.length("dob") == 10), result(_passes(birth == F.substring("mrz_line2", 14, 6)), "cross_dob", F.substring("mrz_line2", 14, 6), F.col("dob"))),
        ]
    if kind == "DRIVING_LICENCE":
        issue, born = F.substring("dl_number", 5, 4).try_cast("int"), F.substring("dob", 1, 4).try_cast("int")
        known = (F.length("dl_number") >= 8) & issue.isNotNull() & born.isNotNull()
        return [F.when(known, result(_passes(issue > born + 16), "dl_issue_year_consistency", "issue year after birth year + 16", F.col("dl_number")))]
    return []


def check_digits(kind: str) -> Column | None:
    """Array of results."""
    if kind == "AADHAAR":
        one = result(_passes(verhoeff_valid(F.col("aadhaar_number"))), "aadhaar_checksum_verhoeff", "Verhoeff check digit", F.col("aadhaar_number"))
        return F.when(F.col("aadhaar_number").isNotNull(), F.array(one))
    if kind == "PASSPORT":
        both = F.col("mrz_line1").isNotNull() & F.col("mrz_line2").isNotNull()
        return F.when(both, F.transform(mrz_checks(F.col("mrz_line2")), lambda c: F.struct(F.when(c["good"], F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"), c["field_name"].alias("field_name"), c["expected"].alias("expected"), c["actual"].alias("actual"))))
    return None


def results_of(kind: str, as_of: Column) -> Column:
    listed = F.array_compact(F.array(*formats(kind), *date_rules(kind, as_of), *cross_rules(kind)))
    checks = check_digits(kind)
    return listed if checks is None else F.concat(listed, F.coalesce(checks, F.array().cast(f"array<{RESULT}>")))


def validate(fields: DataFrame, as_of: str) -> DataFrame:
    """Long table (doc_id, seq, status, field_name, expected, actual) of all rules that apply.

    fields: doc_id, document_type, field_name, value. One shuffle, by document.
    """
    on = F.to_date(F.lit(as_of))
    rules = F.lit(None)
    for kind in ("AADHAAR", "PAN", "PASSPORT", "DRIVING_LICENCE"):
        rules = F.when(F.col("document_type") == kind, results_of(kind, on)).otherwise(rules)
    return wide(fields).select("doc_id", F.posexplode(rules).alias("seq", "r")).select("doc_id", "seq", "r.*")


def is_checksum(name: Column) -> Column:
    return F.contains(name, F.lit("checksum")) | F.contains(name, F.lit("verhoeff"))


def summary(validations: DataFrame) -> DataFrame:
    """validation_fails, validation_warns and checksum_failed of each document; a failed check digit counts in both."""
    return validations.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "FAIL").alias("validation_fails"),
        F.count_if(F.col("status") == "WARN").alias("validation_warns"),
        F.max(((F.col("status") == "FAIL") & is_checksum(F.col("field_name"))).cast("int")).alias("checksum_failed"),
    )
