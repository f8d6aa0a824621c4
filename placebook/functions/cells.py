"""Cells of user tables: emptiness as a browser sees it, and diff cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from placebook.functions.text import col

# The parts of a diff cell, and the JSON values that count as nothing.
DIFF_CELL = "remote variant, local variant, parent variant"
EMPTY_JSON = r'^(""|-?0([.]0*)?(E[-+]?[0-9]+)?|false|null)$'


def is_filled(c: Column | str, type_: T.DataType) -> Column:
    """Neither null, '', 0, NaN nor false; what is tested depends on the column's type."""
    value = col(c)
    if isinstance(type_, T.StringType):
        filled = value != ""
    elif isinstance(type_, (T.FloatType, T.DoubleType)):
        filled = (value != 0) & ~F.isnan(value)
    elif isinstance(type_, T.NumericType):
        filled = value != 0
    elif isinstance(type_, T.BooleanType):
        filled = value
    else:
        filled = value.isNotNull()
    return F.coalesce(filled, F.lit(False))


def has_number(c: Column | str) -> Column:
    """Whether a coordinate cell, possibly kept as text, holds something other than nothing and 0."""
    text = col(c).cast("string")
    number = text.try_cast("double")
    return F.coalesce((text != "") & (number.isNull() | ((number != 0) & ~F.isnan(number))), F.lit(False))


def parse_diff_cell(c: Column | str) -> Column:
    """`V({...})` gives the remote, else the local, else the parent value, else the whole JSON; other text stays."""
    cell = col(c)
    payload = F.substring(cell, F.lit(3), F.char_length(cell) - 3)
    parsed = F.from_json(payload, DIFF_CELL)
    sides = F.array(parsed["remote"], parsed["local"], parsed["parent"])
    filled = F.filter(sides, lambda side: side.isNotNull() & ~F.rlike(F.to_json(side), F.lit(EMPTY_JSON)))
    value = F.try_variant_get(F.get(filled, F.lit(0)), "$", "string")
    return F.when(cell.startswith("V("), F.coalesce(value, payload)).otherwise(cell)
