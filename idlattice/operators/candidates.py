"""Field candidates: validity, score, choice and confidence, as expressions on arrays of candidates.

A candidate is a struct (text, raw, conf, line, source, boost, labelled, probe, box): the
normalised and the read text, mean OCR confidence, line number (-1: to be found), where
it comes from, and the text whose box is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.checksum import verhoeff_valid
from ..functions.dates import as_date, is_calendar_date
from ..functions.text import contains_any, flat, tokens
from .boxes import BOX_SQL
from .layout import confidences, first_index, mean, nearest_distance

NOT_FOUND = "NOT_FOUND"
CANDIDATE = f"struct<text:string,raw:string,conf:double,line:int,source:string,boost:double,labelled:boolean,probe:string,box:{BOX_SQL}>"
FOUND = f"struct<value:string,raw_text:string,confidence:double,status:string,box:{BOX_SQL},line:int,source:string>"

# Labels that stand near a field, as substrings of a lower-case line or word.
ANCHORS = {
    "name": ["name", "नाम", "given name", "surname", "gvn", "nam", "nom"],
    "father_name": ["father", "पिता", "father's name", "fthr", "pit"],
    "dob": ["dob", "birth", "जन्म", "yob", "date of birth", "nasc", "d.o.b", "dt of birth", "date of"],
    "expiry": ["expiry", "till", "valid", "validity", "exp", "val", "expires"],
    "validity": ["expiry", "till", "valid", "validity", "exp", "val", "expires"],
    "aadhaar_number": ["aadhaar", "unique", "enrollment", "enrolment", "uidai", "aadhar", "adh", "number", "no"],
    "pan_number": ["permanent", "account", "tax", "income", "card", "pan", "p.a.n"],
    "passport_number": ["passport", "pass no", "passport no", "document no", "pasp", "no", "number"],
    "dl_number": ["licence", "license", "dl no", "lic no", "licence no", "lic.no", "driving"],
    "nationality": ["nationality", "national"],
    "sex": ["sex", "gender", "लिंग"],
    "gender": ["sex", "gender", "लिंग"],
    "vehicle_class": ["class", "vehicle", "cov"],
}
# Share of the page's height where a field is expected.
BANDS = {
    ("AADHAAR", "aadhaar_number"): lambda y: y > 0.5,
    ("AADHAAR", "name"): lambda y: (y > 0.2) & (y < 0.6),
    ("AADHAAR", "dob"): lambda y: (y > 0.3) & (y < 0.7),
    ("PAN", "pan_number"): lambda y: y > 0.5,
    ("PAN", "name"): lambda y: (y > 0.2) & (y < 0.6),
    ("PAN", "father_name"): lambda y: (y > 0.3) & (y < 0.7),
    ("PASSPORT", "passport_number"): lambda y: (y < 0.3) | (y > 0.7),
    ("PASSPORT", "name"): lambda y: (y > 0.15) & (y < 0.6),
    ("DRIVING_LICENCE", "dl_number"): lambda y: y < 0.5,
    ("DRIVING_LICENCE", "name"): lambda y: (y > 0.2) & (y < 0.6),
}
# Forms of numbers.
NUMBER_FORMS = {
    ("AADHAAR", "aadhaar_number"): r"^[0-9]{12}$",
    ("PAN", "pan_number"): r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    ("PASSPORT", "passport_number"): r"^[A-Z][0-9]{7}$",
    ("DRIVING_LICENCE", "dl_number"): r"^[A-Z]{2}[0-9]{13}$",
}
# Confidences under which a field is marked as low.
LEAST_CONFIDENCE = {
    "name": 0.55, "father_name": 0.55, "dob": 0.60, "validity": 0.60, "expiry": 0.60,
    "aadhaar_number": 0.65, "pan_number": 0.65, "passport_number": 0.65, "dl_number": 0.65, "mrz_line1": 0.70, "mrz_line2": 0.70,
}
# Cities, and labels and places of licences, that no name has.
CITIES = [
    "MUMBAI", "DELHI", "AHMEDABAD", "BANGALORE", "KOLKATA", "CHENNAI", "HYDERABAD", "PUNE", "JAIPUR", "LUCKNOW", "SURAT", "PATNA", "INDORE", "THANE",
    "BHOPAL", "VISAKHAPATNAM", "VADODARA", "GANDHINAGAR", "PANAJI",
]
DL_LABELS = [
    "DOB", "DL", "VALIDITY", "CLASS", "LICENSE", "LICENCE", "DATE", "BIRTH", "EXPIRY", "SDMW", "SDW", "SON", "DAUGHTER", "WIFE", "HUSBAND", "FATHER",
    "HOLDER", "ADDRESS", "SIGNATURE", "AUTHORITY", "TRANSPORT", "UNION", "INDIA",
]
DL_LABEL_ONLY = ["SDMW", "SDW", "SON", "DAUGHTER", "WIFE", "HUSBAND", "FATHER", "NAME"]
DL_PLACES = [*CITIES, "MAHARASHTRA", "GUJARAT", "KARNATAKA", "BHOR", "MAZGAON", "INDIA", "STATE"]
# Classes of vehicles.
VEHICLES = ["MCWG", "LMV", "MCWOG", "HMV", "TRANS", "COV"]
# Words of addresses, and how a line of an address begins.
ADDRESS_WORD = r"(?i)\b(add|address|a/p|ajp|at|post|tal|taluka|dist|district|road|street|lane|village|pin|pincode)\b"
ADDRESS_STARTS = ["add:", "address:", "add ", "address ", "a/p", "at/post", "at post", "at & post", "at/po", "at po"]
ADDRESS_LINE = r"\b(tal|taluka|dist|district|pincode|pin|village|town|road|street|lane)\b"
# Words near names that aren't the holder's, and labels in a passport.
FAMILY_NEAR = ["father", "mother", "spouse", "wife", "husband", "son of", "daughter of", "address", "permanent address", "near", "village", "pin", "state"]
PASSPORT_LABELS = ["father", "mother", "spouse", "wife", "husband", "son of", "daughter of", "address", "permanent", "near", "village", "pin", "state", "given name", "surname", "nationality"]


@dataclass(frozen=True)
class Page:
    """The columns of a document that candidates are judged against."""

    lines: Column
    words: Column
    height: Column
    as_of: Column
    known: Column  # clean words, for confidences
    address: Column  # first line of an address
    pin: Column  # first line with a PIN

    @classmethod
    def of(cls, as_of: str) -> Page:
        """The page of documents that went through with_facts."""
        return cls(F.col("lines"), F.col("words"), F.col("page_height"), F.to_date(F.lit(as_of)), F.col("known"), F.col("address_line"), F.col("pin_line"))

    def anchors(self, field: str) -> Column:
        """Numbers of the lines with a label of the field."""
        return F.col(f"anchors_{field}") if field in ANCHORS else F.array().cast("array<int>")


def candidate(text: Column, raw: Column, conf: Column, line: Column | int = -1, source: str = "visual", boost: Column | float = 0.0, labelled: Column | bool = False, probe: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        text.alias("text"), raw.alias("raw"), conf.cast("double").alias("conf"), lit(line).cast("int").alias("line"), F.lit(source).alias("source"), lit(boost).cast("double").alias("boost"),
        lit(labelled).alias("labelled"), (raw if probe is None else probe).alias("probe"), F.lit(None).cast(BOX_SQL).alias("box"),
    )


def none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def first_of_each(cands: Column, key=lambda c: c["text"]) -> Column:
    """Keeps the first candidate of each text."""
    return let(cands, lambda own: let(F.transform(own, key), lambda keys: F.filter(own, lambda c, i: F.array_position(keys, key(c)) == i + 1)))


def field_confidence(value: Column, words: Column) -> Column:
    """Mean confidence of the words that equal a token of the value, else of all words; 0 without words."""
    from .classify import token_confidence

    return let(value, lambda v: F.when(v.isNull() | (v == NOT_FOUND) | (v == ""), F.lit(0.0)).otherwise(token_confidence(v, words, 0.0)))


def confidence_in(value: Column, known: Column) -> Column:
    """field_confidence with the page's clean words."""
    from .classify import looked_up

    return let(value, lambda v: F.when(v.isNull() | (v == NOT_FOUND) | (v == ""), F.lit(0.0)).otherwise(looked_up(v, known)))


def with_facts(docs: DataFrame) -> DataFrame:
    """Adds what all candidates of a document are judged against, computed once: clean words, lines with labels, of an address, with a PIN."""
    from .classify import cleaned

    facts = {"known": cleaned(F.col("words"), 0.0), "address_line": first_address_line(F.col("lines")), "pin_line": first_index(F.col("lines"), lambda x: x.rlike(r"\b[0-9]{6}\b"))}
    return docs.withColumns(facts | {f"anchors_{f}": anchor_places(F.col("lines"), f) for f in ANCHORS})


def upper_words(text: Column) -> Column:
    return tokens(F.regexp_replace(F.upper(text), r"[^A-Z\s]", ""))


def overlap(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, known)))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def first_address_line(lines: Column) -> Column:
    """Index of the first line that begins an address; the number of lines for none."""
    at = first_index(lines, lambda x: contains_any(F.lower(x), ADDRESS_STARTS) | F.lower(x).rlike(ADDRESS_LINE))
    return F.when(at >= 0, at).otherwise(F.size(lines))


def reason(kind: str, field: str, c: Column, page: Page, other: Column | None = None) -> Column:
    """Why a candidate may not be the field; null if it may. other: a name it must differ from."""
    text = c["text"]
    checks: list[tuple[Column, str]] = [(text.isNull() | (text == "") | (text == NOT_FOUND), "no value")]
    if field in ("passport_number", "pan_number"):
        checks.append((~text.rlike(NUMBER_FORMS[kind, field]), "wrong format"))
    elif field == "aadhaar_number":
        digits = squeezed(text)
        checks += [(~digits.rlike("^[0-9]{12}$"), "not twelve digits"), ((digits != "123456789012") & ~verhoeff_valid(digits), "wrong check digit")]
    elif field == "dl_number":
        checks.append((~squeezed(text).rlike("^[A-Z]{2}[0-9]{13}$") & ~(squeezed(text).rlike("^[A-Za-z]{2}") & (F.length(squeezed(text)) >= 10)), "wrong format"))
    elif field == "dob" and kind in ("PASSPORT", "AADHAAR"):
        checks.append((~is_calendar_date(text), "no calendar date"))
    elif field in ("mrz_line1", "mrz_line2"):
        checks.append(((F.length(text) != 44) | ~F.contains(text, F.lit("<")), "wrong layout"))
    elif field == "gender":
        checks.append((~F.upper(text).isin("MALE", "FEMALE", "OTHER", "M", "F"), "unknown value"))
    elif field == "nationality":
        checks += [(~text.rlike("^[A-Z]{3}$") & ~F.upper(text).isin("IND", "INDIAN"), "no code"), (~F.upper(text).rlike("^[A-Z]{3}$"), "no code"), (F.upper(text).isin("NNB", "NND", "III"), "rejected code")]
    elif field == "vehicle_class":
        checks.append((F.exists(tokens(F.replace(F.upper(text), F.lit(","), F.lit(" "))), lambda w: ~w.isin(VEHICLES)), "unknown class"))
    elif field in ("name", "father_name"):
        letters, visible = F.length(F.regexp_replace(text, r"(?U)[^\p{Alpha}]", "")), F.length(F.regexp_replace(text, r"(?U)\s", ""))
        if kind == "PASSPORT":
            near = F.exists(F.slice(page.lines, F.greatest(c["line"] - 2, F.lit(0)) + 1, 3 + F.least(c["line"], F.lit(2))), lambda x: contains_any(F.lower(x), FAMILY_NEAR))
            checks += [
                (overlap(upper_words(text), CITIES), "city"),
                (text.rlike(r"\b[0-9]{4}\b") | text.rlike(r"[0-9]{2}[/\-.][0-9]{2}[/\-.]"), "date"),
                ((visible > 0) & (letters < 0.7 * visible), "few letters"),
                ((c["source"] != "mrz") & near, "family or address nearby"),
                ((c["source"] != "mrz") & contains_any(F.lower(text), PASSPORT_LABELS), "label"),
            ]
        elif kind == "DRIVING_LICENCE":
            checks += [
                (overlap(upper_words(text), DL_LABELS), "label"),
                (F.regexp_replace(F.upper(text), "[^A-Z]", "").isin(DL_LABEL_ONLY), "label"),
                (text.rlike(ADDRESS_WORD), "address"),
            ]
        if kind != "PASSPORT":
            checks.append((text.rlike("(?U)[0-9]"), "digits"))
        if other is not None:
            checks.append((text == other, "other name"))
    out = F.when(checks[0][0], F.lit(checks[0][1]))
    for test, why in checks[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), F.lit(why))
    return out


def anchor_places(lines: Column, field: str) -> Column:
    """Numbers of the lines with a label of the field."""
    labels = ANCHORS.get(field, [])
    hits = F.transform(lines, lambda x, i: F.when(contains_any(F.lower(x), labels), i))
    return F.filter(hits, lambda i: i.isNotNull())


def with_line(c: Column, lines: Column) -> Column:
    """Finds the line of a candidate without one: the first that holds its text as read or normalised, else 0."""
    at = first_index(lines, lambda x: F.contains(x, c["raw"]) | F.contains(x, c["text"]))
    return c.withField("line", F.when(c["line"] == -1, F.greatest(at, F.lit(0))).otherwise(c["line"]))


def page_share(box: Column, page: Page) -> Column:
    return (box["y"] + box["h"] / 2.0) / page.height


def score(kind: str, field: str, c: Column, page: Page, given_line: Column) -> Column:
    """Rank of a candidate: OCR confidence, nearness to a label, place on the page, source and
    boost (twice), alignment of dates, length of names, form of numbers. given_line: -1 if the
    candidate came without a line."""
    anchors = page.anchors(field)
    line, text, box = c["line"], c["text"], c["box"]
    nearest = F.get(F.array_sort(F.transform(anchors, lambda a: F.struct(F.abs(line - a).alias("d"), a.alias("a")))), F.lit(0))["a"]
    near = let(line - nearest, lambda s: F.when(s.isNull(), 0.0).when(s.isin(0, 1), 1.0).when(s == 2, 0.8).when(s == -1, 0.4).when(s == -2, 0.2).otherwise(0.1))
    conf = F.when(c["conf"] > 1, c["conf"] / 100).otherwise(c["conf"])
    band = BANDS.get((kind, field))
    layout = F.when(box.isNotNull() & band(page_share(box, page)), 1.0).otherwise(0.5) if band else F.lit(0.5)
    visual, rest = (0.8, 0.5) if kind == "PASSPORT" else (1.0, 0.5)
    template = F.when(c["source"] == "visual", visual).when((c["source"] == "mrz") & F.lit(kind == "PASSPORT"), 1.0).otherwise(rest)
    out = 0.40 * conf + 0.25 * near + 0.20 + 0.10 * layout + 0.05 * template + 2 * c["boost"]
    if field in ("dob", "validity", "expiry"):
        labels = F.filter(page.words, lambda w: contains_any(F.lower(w["text"]), ANCHORS[field]))
        same_line = F.exists(labels, lambda w: F.abs((w["top"] + w["height"] / 2.0) - (box["y"] + box["h"] / 2.0)) < 15)
        same_column = F.exists(labels, lambda w: F.greatest(w["left"], box["x"]) <= F.least(w["left"] + w["width"], box["x"] + box["w"]))
        out = out + F.when(box.isNotNull() & same_line, 1.5).otherwise(0.0) + F.when(box.isNotNull() & same_column, 1.5).otherwise(0.0)
    if field == "name":
        out = out + let(F.size(tokens(text)), lambda n: F.when(n >= 3, 1.5).when(n == 2, 1.0).when(n == 1, -2.0).otherwise(0.0)) - F.when(F.length(text) < 5, 2.0).otherwise(0.0)
    if (form := NUMBER_FORMS.get((kind, field))) is not None:
        out = out + F.when(squeezed(text).rlike(form) if kind in ("AADHAAR", "DRIVING_LICENCE") else text.rlike(form), 2.0).otherwise(0.0)
    if field == "dob":
        out = out - F.when(is_calendar_date(text) & (as_date(text) > page.as_of), 5.0).otherwise(0.0)
    if kind == "DRIVING_LICENCE" and field == "name":
        n = F.size(tokens(text))
        pin = page.pin
        out = out + F.when(n.between(2, 5), 2.0).otherwise(-3.0) - F.when(text.rlike(ADDRESS_WORD), 50.0).otherwise(0.0) - F.when(overlap(upper_words(text), DL_PLACES), 20.0).otherwise(0.0)
        out = out - F.when(text.rlike("[0-9]"), 20.0).otherwise(0.0) - F.when(line >= page.address, 50.0).otherwise(0.0) - F.when((pin >= 0) & (F.abs(line - pin) <= 2), 20.0).otherwise(0.0)
    if kind == "PASSPORT" and field == "name":
        labels = F.filter(F.transform(page.lines, lambda x, i: F.when(contains_any(F.lower(x), ["surname", "given name", "givenname"]), F.abs(line - i))), lambda d: d.isNotNull())
        by_label = F.aggregate(labels, F.lit(0.0), lambda s, d: s + F.when(d == 1, 5.0).when(d <= 2, 3.0).otherwise(0.0))
        numbers = F.filter(F.transform(page.lines, lambda x, i: F.when(F.upper(squeezed(x)).rlike("^[A-Z][0-9]{7}$"), F.abs(line - i))), lambda d: d <= 4)
        share = page_share(box, page)
        placed = F.when(box.isNull(), 0.0).when((share > 0.15) & (share < 0.6), 3.0).when(share > 0.5, -5.0).otherwise(0.0)
        out = out + F.when(given_line.isNull(), 0.0).otherwise(by_label + placed + 3.0 * F.size(numbers)) + F.when(c["labelled"], 10.0).otherwise(0.0)
    return out


def confidence(kind: str, field: str, c: Column, page: Page) -> Column:
    """Combined confidence of a chosen candidate, 0 to 1: OCR, form, nearness to a label, place on the page."""
    conf = F.when(c["conf"] > 1, c["conf"] / 100).otherwise(c["conf"])
    distance = nearest_distance(c["line"], page.anchors(field))
    position = let(distance, lambda d: F.when(d <= 1, 1.0).when(d == 2, 0.8).when(d < 5, 0.6).otherwise(0.4))
    band = BANDS.get((kind, field)) if field not in ("dob", "father_name") else None
    template = F.when(c["box"].isNotNull() & band(page_share(c["box"], page)), 1.0).otherwise(0.8) if band else F.lit(0.8)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * conf + 0.30 + 0.20 * position + 0.10 * template))


def missing() -> Column:
    return F.struct(
        F.lit(NOT_FOUND).alias("value"), F.lit("").alias("raw_text"), F.lit(0.0).alias("confidence"), F.lit("ok").alias("status"), F.lit(None).cast(BOX_SQL).alias("box"),
        F.lit(-1).alias("line"), F.lit("").alias("source"),
    )


def ranked(kind: str, field: str, cands: Column, page: Page, other: Column | None = None) -> Column:
    """Valid candidates as (score, order, c), best first; the earlier of equals first."""
    lined = F.transform(cands, lambda c, i: F.struct(with_line(c, page.lines).alias("c"), i.alias("i"), c["line"].alias("given")))
    valid = F.filter(lined, lambda x: reason(kind, field, x["c"], page, other).isNull())
    scored = F.transform(valid, lambda x: F.struct(score(kind, field, x["c"], page, x["given"]).alias("score"), (-x["i"]).alias("order"), x["c"].alias("c")))
    return F.reverse(F.array_sort(scored))


def choose(kind: str, field: str, cands: Column, page: Page, other: Column | None = None) -> Column:
    """The best candidate as a field result; NOT_FOUND without a valid one."""
    best = F.slice(ranked(kind, field, cands, page, other), F.lit(1), F.lit(1))

    def result(b: Column) -> Column:
        c = b["c"]
        conf = F.when(c["conf"] > 1, c["conf"] / 100).otherwise(c["conf"])
        status = F.when(conf < LEAST_CONFIDENCE.get(field, 0.0), F.lit("low_confidence")).otherwise(F.lit("ok"))
        return F.struct(c["text"].alias("value"), c["raw"].alias("raw_text"), confidence(kind, field, c, page).alias("confidence"), status.alias("status"), c["box"].alias("box"), c["line"].alias("line"), c["source"].alias("source"))

    return F.coalesce(F.get(F.transform(best, result), F.lit(0)), missing())


def all_words_mean(words: Column) -> Column:
    return mean(confidences(words), 0.0)


def normal(text: Column) -> Column:
    return flat(text)
