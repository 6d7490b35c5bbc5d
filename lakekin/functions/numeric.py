"""Text to number, the usable-value guard, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekin.options import MAX_MEASURE

# The spellings of infinity that are numbers.
INFINITIES = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
# All that the cast takes, but for suffixes and hex floats.
NUMBER_TEXT = (
    r"^[\x00-\x20]*[-+]?(?:[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?|(?i:nan|inf(?:inity)?))[\x00-\x20]*$"
)


def parse_number(cell: Column) -> Column:
    """Double value of a text cell, NULL when it is not a number.

    The cast alone would also take Java suffixes (``5d``, ``5f``) and hex
    floats, which are text in a data file. Text is told by its form: a cast that
    fails raises and catches an exception, which costs more than the rest of a cell.
    """
    odd = cell.rlike("[dDfFxX]") & ~F.lower(F.trim(cell)).isin(INFINITIES)
    return F.when(cell.rlike(NUMBER_TEXT) & ~odd, cell.try_cast("double"))


def usable(num: Column) -> Column:
    """Finite and of a magnitude that can be averaged."""
    return num.isNotNull() & ~F.isnan(num) & (F.abs(num) < F.lit(MAX_MEASURE))


def guarded(num: Column) -> Column:
    """``num`` where usable, else NULL."""
    return F.when(usable(num), num)


def clean_text(cell: Column) -> Column:
    """Strip surrounding white space and lower-case."""
    return F.lower(F.regexp_replace(cell, r"^\s+|\s+$", ""))
