"""Column functions for ids and metadata; all run within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number within an id.
NUMBER = r"\d+(?:\.\d+)?"
BLANK = " \t\r\n"


def natural_key(id_: Column) -> Column:
    """Sorts ids with numbers by their value: text and number parts in turn, then the id.

    Numbers are compared as decimals, so runs of up to 38 digits are exact.
    """
    text = id_.cast("string")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.try_cast("decimal(38,6)"))
    return F.struct(F.arrays_zip(F.split(text, NUMBER).alias("text"), numbers.alias("number")).alias("parts"), text.alias("id"))


def split_list(text: Column, sep: str = ";") -> Column:
    """Trimmed parts of a separated list."""
    return F.transform(F.split(text, _literal(sep)), lambda x: F.trim(x))


def split_nested(text: Column, outer: str = "|", inner: str = ";") -> Column:
    """A list of trimmed lists."""
    return F.transform(F.split(text, _literal(outer)), lambda part: F.transform(F.split(part, _literal(inner)), lambda x: F.trim(x)))


def _literal(sep: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in sep)


def join_list(items: Column, sep: str = "; ", replace: str = ":") -> Column:
    """Parts joined with ``; ``; a separator within a part is replaced."""
    return F.array_join(F.transform(items, lambda x: F.translate(x, ";", replace)), sep)


def join_nested(lists: Column, replace: str = ":") -> Column:
    """Lists joined with ``|``, their parts with ``; ``; separators within parts are replaced."""
    return F.array_join(F.transform(lists, lambda a: F.array_join(F.transform(a, lambda x: F.translate(x, ";|", replace * 2)), "; ")), "|")


def int_or_text(text: Column) -> Column:
    """A whole number in plain form, or the text as it was."""
    return F.coalesce(F.trim(text).try_cast("bigint").cast("string"), text)


def float_or_text(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double").cast("string"), text)


def is_number(text: Column) -> Column:
    return F.trim(text).try_cast("double").isNotNull()


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\[\] \n\t]+|[\[\] \n\t]+$", "")


def prefer_first(a: Column, b: Column) -> Column:
    """Metadata merge: the first that is there."""
    return F.coalesce(a, b)


def flattened(lists: Column) -> Column:
    """One list of the elements of several."""
    return F.flatten(lists)


def unzipped(pairs: Column) -> Column:
    """A list of structs as a struct of lists."""
    return F.struct(F.transform(pairs, lambda x: x.getField("first")).alias("first"), F.transform(pairs, lambda x: x.getField("second")).alias("second"))
