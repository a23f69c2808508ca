"""Functions that SQL lacks, as expressions; none needs Python on the executors."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_hash(text: Column) -> Column:
    """Eight lower-case hex digits of the string hash h = 33 h + byte modulo 2^32 from 5381; for ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda a, b: (a * 33 + b) % F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def reverse_text(text: Column) -> Column:
    """Characters from last to first; null stays null."""
    return F.reverse(text)


def prefix_match(prefix: Column, text: Column) -> Column:
    """1 where the text starts with the prefix, else 0."""
    return F.startswith(text, prefix).cast("int")


def is_palindrome(text: Column) -> Column:
    """Whether a text reads the same both ways; the empty one does."""
    return text == F.reverse(text)


def int_array_sum(array: Column) -> Column:
    """Sum of an array's non-null elements, as a long."""
    return F.aggregate(F.filter(array, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x)


def word_count(text: Column) -> Column:
    """Words between spaces; the blank text has none."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def contains_all(array: Column, wanted: Column) -> Column:
    """Whether every wanted element is in the array."""
    return F.size(F.array_except(wanted, array)) == 0


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, and null where b is 0."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def truncated_ge(column: Column, literal: float) -> Column:
    """Comparison with a literal cut to a whole number, as old integer engines do; for compatibility only."""
    return column >= int(literal)


def exact_sum(column: Column, digits: int = 4) -> Column:
    """A sum of doubles that does not depend on the order of rows: over decimals."""
    return F.sum(column.cast(f"decimal(24,{digits})")).cast("double")


def json_contains(text: Column, wanted: dict[str, object]) -> Column:
    """Whether a JSON object has these top-level members; a null or something else has none."""
    out = F.lit(True)
    for name, value in wanted.items():
        quoted = isinstance(value, str)
        found = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), f"$[0].{name}")
        out = out & (found == (value if quoted else json.dumps(value)))
    return F.coalesce(out, F.lit(False))
