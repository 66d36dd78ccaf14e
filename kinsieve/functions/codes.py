"""Subject codes: 8 characters of family, then a relationship suffix; and well positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Relationship suffixes and the shape of a well-formed subject code.
PATIENT = "PT"
PARENTS = ("FA", "MO")
GRANDPARENTS = ("MGM", "MGF")
SIBLING = "SI"
CODE_PATTERN = "^[A-Za-z]{3}[0-9]{5}[A-Za-z]"
FAMILY_LENGTH = 8
PLATE_ROWS = 8
PLATE_WELLS = 96


def family_of(code: Column) -> Column:
    return F.substring(code, 1, FAMILY_LENGTH)


def suffix_of(code: Column) -> Column:
    return F.substr(code, F.lit(FAMILY_LENGTH + 1))


def relationship_of(code: Column) -> Column:
    """Relationship with all sibling suffixes (S1, S2, S201205, ...) merged."""
    suffix = suffix_of(code)
    return F.when(suffix.startswith("S"), F.lit(SIBLING)).otherwise(suffix)


def patient_code(family: Column) -> Column:
    return F.concat(family, F.lit(PATIENT))


def is_well_formed(code: Column, also: str | None = None) -> Column:
    """Whether a code has the usual shape, or that of the pattern `also` (a site with a numbering of its own)."""
    return code.rlike(f"{CODE_PATTERN}|{also}" if also else CODE_PATTERN)


def sibling_birth_date(code: Column) -> Column:
    """Mid-month birth date written into a sibling's code (S + yyyymm); NULL otherwise."""
    suffix = suffix_of(code)
    return F.when(
        suffix.rlike("^S[0-9]{6}$"),
        F.try_to_date(F.concat(F.substring(suffix, 2, 6), F.lit("15")), "yyyyMMdd"),
    )


def well_label(position: Column) -> Column:
    """Well of a 96-well plate from a 1-based position counted down the columns: 1 = A1, 9 = A2."""
    zero = position.cast("int") - 1
    letter = F.char(F.lit(65) + F.pmod(zero, F.lit(PLATE_ROWS)))
    return F.concat(letter, (F.floor(zero / PLATE_ROWS) + 1).cast("string"))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, or NULL where there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)
