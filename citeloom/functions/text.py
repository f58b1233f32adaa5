"""One place for white space, case and pattern conventions: Unicode classes, `$` and `.` that know only the line feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{UNICODE}{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"{UNICODE}{SPACE}+", " ")


def normalise(c: Column) -> Column:
    return collapse(F.upper(strip(c)))


def word_count(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, rf"{UNICODE}{SPACE}+")))


def starts_with_any(c: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | c.startswith(h)
    return out


def title(c: Column) -> Column:
    """Upper-case the first letter after every character without case, lower-case the rest."""
    parts = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def display(x: Column, digits: int = 0) -> Column:
    """A number of 0 or more with 0 or 1 decimals as text, rounded half to even by its exact binary value."""
    ten, unit = 10**digits, 1 << 58
    whole = F.floor(x).cast("bigint")
    part = ((x - whole) * float(unit)).cast("bigint") * ten  # exact: a fraction has no more bits where it matters
    low, rest = F.call_function("div", part, F.lit(unit)), part % F.lit(unit)
    digit = whole * ten + low
    up = (rest > unit // 2) | ((rest == unit // 2) & (digit % 2 == 1))
    shown = F.when(up, digit + 1).otherwise(digit)
    return shown.cast("string") if not digits else F.concat(F.call_function("div", shown, F.lit(ten)).cast("string"), F.lit("."), (shown % ten).cast("string"))


def output_name(name: Column) -> Column:
    """The name of a highlighted copy: what stands before the last dot, and a suffix."""
    return F.concat(F.regexp_replace(name, r"(?s)\.[^.]*\z", ""), F.lit("_highlighted.pdf"))
