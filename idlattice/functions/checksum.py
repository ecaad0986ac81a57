"""Check digits: Verhoeff, and the machine-readable zone's 7-3-1 weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty


def dihedral_table() -> list[list[int]]:
    """Products in the dihedral group of order ten: rotations 0 to 4, reflections 5 to 9."""

    def product(a: int, b: int) -> int:
        turn = (a % 5 + b) % 5 if a < 5 else (a % 5 - b) % 5
        return turn + 5 * ((a >= 5) != (b >= 5))

    return [[product(a, b) for b in range(10)] for a in range(10)]


def permutation_table() -> list[list[int]]:
    """Eight powers of the position permutation."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([base[x] for x in rows[-1]])
    return rows


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def verhoeff_sum(digits: Column, shift: int = 0) -> Column:
    """The group product of the digits from the right; shift: places before the first one."""
    d, p = _table(dihedral_table()), _table(permutation_table())
    places = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    indexed = F.transform(places, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(indexed, F.lit(0), lambda c, s: F.get(d, c * 10 + F.get(p, ((s["i"] + shift) % 8) * 10 + s["x"])))


def verhoeff_valid(number: Column) -> Column:
    """Twelve digits, spaces ignored, with a right check digit."""
    digits = F.regexp_replace(text_or_empty(number), r"\s", "")
    ok = digits.rlike("^[0-9]{12}$")
    return F.when(ok, verhoeff_sum(F.when(ok, digits).otherwise(F.lit("0"))) == 0).otherwise(F.lit(False))


def verhoeff_digit(digits: Column) -> Column:
    """The check digit to put after the digits."""
    inverse = F.array(*[F.lit(next(b for b in range(10) if row[b] == 0)) for row in dihedral_table()])
    return F.get(inverse, verhoeff_sum(digits, 1))


def mrz_digit(zone: Column) -> Column:
    """Weights 7, 3, 1 over the characters' values: digits, A as 10 and on, others 0; modulo 10."""
    values = F.transform(F.filter(F.split(F.upper(text_or_empty(zone)), ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    weight = lambda i: F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3)
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(0)
    return F.aggregate(values, F.lit(0), lambda s, x: s + value(x["c"]) * weight(x["i"])) % 10


def mrz_zones(line: Column) -> dict[str, tuple[Column, Column]]:
    """Data and printed check digit of a 44-character second line's four checked zones."""
    cut = lambda a, b: F.substring(line, a + 1, b - a)
    return {
        "mrz_passport_checksum": (cut(0, 9), cut(9, 10)),
        "mrz_dob_checksum": (cut(13, 19), cut(19, 20)),
        "mrz_expiry_checksum": (cut(21, 27), cut(27, 28)),
        "mrz_composite_checksum": (F.concat(cut(0, 10), cut(13, 20), cut(21, 43)), cut(43, 44)),
    }


def mrz_checks(line: Column) -> Column:
    """Array of (field_name, expected, actual, good); one mrz_layout entry if the line isn't 44 long."""
    checks = [
        F.struct(F.lit(name).alias("field_name"), mrz_digit(zone).cast("string").alias("expected"), digit.alias("actual"), (mrz_digit(zone).cast("string") == digit).alias("good"))
        for name, (zone, digit) in mrz_zones(line).items()
    ]
    layout = F.struct(F.lit("mrz_layout").alias("field_name"), F.lit("44").alias("expected"), F.length(line).cast("string").alias("actual"), F.lit(False).alias("good"))
    return F.when(F.length(line) == 44, F.array(*checks)).otherwise(F.array(layout))
