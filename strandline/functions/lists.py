"""Lists written as text, such as ``['A', None]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An element: quoted by ' or ", a number, or a bare constant.
_ELEMENT = r"""'([^']*)'|"([^"]*)"|(-?\d+(?:\.\d+)?)|(None|True|False)"""
_LIST = rf"^\s*\[\s*(?:(?:{_ELEMENT})\s*(?:,\s*(?:{_ELEMENT})\s*)*,?\s*)?\]\s*$"
_SCALAR = rf"^\s*(?:{_ELEMENT})\s*$"


def decode_list(text: Column) -> Column:
    """Array of strings; a scalar literal is a list of one, ``None`` is a null element, and text that is neither is null."""
    elements = F.regexp_extract_all(text, F.lit(rf"({_ELEMENT})"), F.lit(1))
    value = lambda e: F.when(e == "None", F.lit(None)).when(e.rlike("^['\"]"), F.substring(e, F.lit(2), F.length(e) - 2)).otherwise(e)
    return F.when(text.rlike(_LIST) | text.rlike(_SCALAR), F.transform(elements, value))


def encode_list(values: Column) -> Column:
    """The text of a list of strings, with ``None`` for null."""
    quoted = F.transform(values, lambda v: F.coalesce(F.concat(F.lit("'"), v, F.lit("'")), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def display_list(values: Column) -> Column:
    """Elements joined by a middle dot, nulls left out."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), " · ")


def joined_labels(*columns: Column) -> Column:
    """The different labels of a row, sorted and joined by ``|``; blanks and ``none`` are no labels."""
    known = [F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "none"), F.trim(c)) for c in columns]
    if len(known) == 2:  # without arrays, for tables with a row for each pair of rows
        one, two = known
        return F.concat_ws("|", F.least(one, two), F.when(one != two, F.greatest(one, two)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*known), lambda v: v.isNotNull()))), "|")
