"""String functions on columns. All are built-in expressions; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# Words that rule out a line as a person's name.
HEADER_WORDS = [
    "INCOME", "TAX", "DEPARTMENT", "GOVERNMENT", "INDIA", "PERMANENT", "ACCOUNT", "CARD", "SIGNATURE", "HOLDER",
    "DOB", "DATE", "BIRTH", "GENDER", "MALE", "FEMALE", "YEAR", "NAME", "FATHER", "FATHERS", "MOTHER", "MOTHERS",
    "UNIQUE", "IDENTIFICATION", "ENROLLMENT", "ENROLMENT", "UIDAI", "GOVT", "STATE", "DISTRICT", "POST", "ADDRESS",
    "NUMBER", "NO", "VALID", "TILL", "EXPIRY", "LICENCE", "LICENSE", "DRIVING", "PASSPORT", "NATIONALITY", "ISSUE",
    "AADHAAR", "PEHCHAN", "MERA", "MERI",
]
NOT_FOUND = "NOT_FOUND"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip(t: Column) -> Column:
    """Without white space at either end, as Unicode defines it."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def flat(t: Column) -> Column:
    """White space squeezed to single spaces and trimmed; null gives an empty text."""
    return F.trim(F.regexp_replace(text_or_empty(t), r"(?U)\s+", " "))


clean_whitespace = flat


def tokens(t: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(flat(t), " "), lambda w: w != "")


def lines(t: Column) -> Column:
    """Stripped non-blank lines, in order."""
    return F.filter(F.transform(F.split(text_or_empty(t), "\n"), strip), lambda x: x != "")


def keyword_text(t: Column) -> Column:
    """Lower case, punctuation to spaces, Devanagari kept."""
    return flat(F.regexp_replace(F.lower(text_or_empty(t)), r"(?U)[^\w\sऀ-ॿ]", " "))


# Five tables of look-alike characters, each for its own purpose.
def correct_digits(t: Column) -> Column:
    """Letters that OCR reads for digits in a number."""
    return F.translate(t, "OoIil|!ZzSsBgG", "00111112255896")


def match_digits(t: Column) -> Column:
    """For comparing words: lower case, look-alikes as digits."""
    return F.translate(F.lower(t), "oilzsbgq", "01125890")


def normalize_ocr(t: Column, numeric: bool = False) -> Column:
    return F.translate(t, "OoIlSsBb", "00115588") if numeric else t


def correct_numeric_field(t: Column) -> Column:
    return F.translate(t, "OIBS", "0185")


def clean_word(t: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(t)), "[^a-z0-9/<]", "")


def clean_and_normalize(t: Column, numeric: bool = False) -> Column:
    """For comparing a box's text with a value: look-alikes resolved, only letters, digits, / and <, lower case."""
    return F.lower(normalize_ocr(F.regexp_replace(text_or_empty(t), "[^a-zA-Z0-9/<]", ""), numeric))


def contains_any(t: Column, words: list[str]) -> Column:
    """Whether a text contains any of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def digit_count(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^0-9]", ""))


def uppercase_name(line: Column) -> Column:
    """The run of upper-case words after an optional label, up to the first word with a
    lower-case letter; NOT_FOUND below three letters."""
    start = F.regexp_replace(flat(line), "^[^a-zA-Z0-9]+", "")
    rest = F.regexp_replace(start, r"(?i)^(?:name|father|fathers|father's|mother|mothers|mother's|dob|yob|birth|gender|male|female)\s*[:\-]?\s*", "")

    def step(state: Column, word: Column) -> Column:
        letters = F.regexp_replace(word, "[^a-zA-Z]", "")
        upper = (letters != "") & (letters == F.upper(letters))
        kept = F.concat(state["kept"], F.array(F.regexp_replace(word, r"[^a-zA-Z\.]", "")))
        over = ~upper & word.rlike(r"(?U)\p{Lower}") & (F.size(state["kept"]) > 0)
        return F.struct((state["over"] | over).alias("over"), F.when(upper & ~state["over"], kept).otherwise(state["kept"]).alias("kept"))

    begin = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate(tokens(rest), begin, step, lambda s: F.array_join(s["kept"], " "))
    return let(kept, lambda name: F.when(F.length(F.regexp_replace(name, "[^a-zA-Z]", "")) >= 3, name).otherwise(F.lit(NOT_FOUND)))


def is_valid_name(name: Column, number: Column | None = None) -> Column:
    """Three letters or more, no header word, and not part of the document's own number."""

    def judge(x: Column) -> Column:
        letters = F.regexp_replace(F.upper(x), "[^A-Z]", "")
        good = (x != NOT_FOUND) & (F.length(letters) >= 3) & ~F.arrays_overlap(tokens(F.upper(x)), F.array(*map(F.lit, HEADER_WORDS)))
        if number is not None:
            other = F.when(number == NOT_FOUND, F.lit("")).otherwise(F.regexp_replace(F.upper(text_or_empty(number)), "[^A-Z]", ""))
            good = good & let(other, lambda o: (o == "") | ~(F.contains(o, letters) | F.contains(letters, o)))
        return good

    return F.coalesce(let(text_or_empty(name), judge), F.lit(False))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, ignoring case; 1 for equal texts, 0 if one is empty."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def display_name(field: Column) -> Column:
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def slug(verdict: Column) -> Column:
    return F.lower(F.replace(verdict, F.lit(" "), F.lit("-")))


def first_match(t: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def texts_agree(box: Column, value: Column) -> Column:
    """Equal, equal after normalising, or one's words all among the other's."""
    a, b = F.lower(flat(box)), F.lower(flat(value))
    na, nb = clean_and_normalize(box, True), clean_and_normalize(value, True)
    wa, wb = F.split(a, " "), F.split(b, " ")
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return (a != "") & (b != "") & ((a == b) | (na == nb) | within)
