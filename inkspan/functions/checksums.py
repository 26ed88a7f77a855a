"""Check-digit rules, as JVM-side column expressions and as Python functions for the span detectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The check letters of a Spanish DNI.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _value(ch: Column) -> Column:
    return F.ascii(ch) - 48


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _mod(c: Column, m: int) -> Column:
    """A string of digits modulo m, of any length."""
    return F.aggregate(_chars(c), F.lit(0), lambda a, x: (a * 10 + _value(x)) % m)


def luhn_valid(c: Column) -> Column:
    """13 to 19 digits, whatever separates them, that pass the Luhn check."""
    d = digits(c)
    return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def ssn_plausible(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 3) < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def iban_valid(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    left = F.aggregate(_chars(moved), F.lit(0), lambda a, x: F.when(x >= "A", (a * 100 + F.ascii(x) - 55) % 97).otherwise((a * 10 + _value(x)) % 97))
    return s.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (left == 1)


def dni_valid(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), "-", "")
    number = F.translate(F.substring(s, 1, 8), "XYZ", "012").cast("int")
    letter = F.substring(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1))
    ok = F.upper(c).rlike(r"\A(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z]\z")
    return F.when(ok, letter == F.substring(s, 9, 1)).otherwise(False)


def nir_valid(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    body = F.regexp_replace(F.regexp_replace(F.substring(s, 1, 13), "2A", "19"), "2B", "18")
    ok = s.rlike(r"\A[12][0-9]{4}(?:[0-9]{2}|2A|2B)[0-9]{8}\z")
    return F.when(ok, 97 - _mod(body, 97) == F.substring(s, 14, 2).cast("int")).otherwise(False)


def steuer_id_valid(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s", "")

    def step(product, ch):
        total = (_value(ch) + product) % 10
        return F.when(total == 0, 20 % 11).otherwise(total * 2 % 11)

    check = 11 - F.aggregate(_chars(F.substring(s, 1, 10)), F.lit(10), step)
    return F.when(s.rlike(r"\A[1-9][0-9]{10}\z"), F.when(check == 10, 0).otherwise(check) == F.substring(s, 11, 1).cast("int")).otherwise(False)


def py_luhn(s: str) -> bool:
    d = [ord(x) - 48 for x in s if "0" <= x <= "9"]
    return 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def py_ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def py_iban(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    return bool(re.match(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z", s)) and int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1


def py_dni(s: str) -> bool:
    s = s.replace("-", "")
    return DNI_LETTERS[int(s[:8].translate(str.maketrans("XYZ", "012"))) % 23] == s[8]


def py_nir(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    return 97 - int(s[:13].replace("2A", "19").replace("2B", "18")) % 97 == int(s[13:])


def py_steuer_id(s: str) -> bool:
    d, p = [int(x) for x in s if x != " "], 10
    for x in d[:10]:
        p = ((x + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == d[10]
