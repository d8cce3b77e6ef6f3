"""Expressions on the cells of one row. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text NaN is a missing number, but a value like any other in a text column.
NULL_TOKENS = ("", "NA")
TRUE_WORDS = ("T", "TRUE", "1")
FALSE_WORDS = ("F", "FALSE", "0")
NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(v: Column | float | str) -> Column:
    """A Column as it is, anything else as a literal."""
    return v if isinstance(v, Column) else F.lit(v)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient; NULL instead of a division by zero or a non-finite result."""
    return finite(F.try_divide(col(top).cast("double"), col(bottom).cast("double")))


def count_ratio(top: Column, bottom: Column) -> Column:
    """Quotient of two counts; NULL over zero. Cheaper than ``ratio``, being finite."""
    return F.try_divide(top, bottom)


def without_tokens(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    c = col(c)
    return F.when(~c.isin(*tokens), c)


def _bounded(c: Column) -> Column:
    """Infinities become NULL; unlike ``finite`` this evaluates ``c`` only once."""
    return F.nullif(F.nullif(c, F.lit(float("inf"))), F.lit(float("-inf")))


def parse_number(c: Column | str) -> Column:
    """First number in the text, grouping commas dropped; NULL if there is none."""
    plain = F.translate(col(c), ",", "")
    found = F.nullif(F.regexp_extract(plain, NUMBER, 0), F.lit(""))
    return _bounded(found.try_cast("double"))


def parse_logical(c: Column | str) -> Column:
    word = F.upper(F.trim(col(c)))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_date(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def to_number(c: Column | str) -> Column:
    """Strict cast of text; what is not a number becomes NULL.

    The pattern comes first because a failing cast costs an exception per row.
    """
    text = F.trim(col(c))
    return _bounded(F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double")))


def band(c: Column | str, upper_bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first bound the value lies below; missing stays missing."""
    c = col(c)
    labels = F.when(c.isNull(), None)
    for bound, label in upper_bounds:
        labels = labels.when(c < bound, label)
    return labels.otherwise(otherwise)


def flag(condition: Column) -> Column:
    """The condition with missing taken as false."""
    return F.coalesce(condition, F.lit(False))


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Mapped value; a value outside the mapping is kept."""
    c = col(c)
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def not_negative(c: Column | str) -> Column:
    """Negative values become NULL, zero stays."""
    c = col(c)
    return F.when(c >= 0, c)


def row_mean(*cols: Column | str) -> Column:
    """Mean of the values present in the row; NULL if there are none."""
    cells = [col(c).cast("double") for c in cols]
    present = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    return F.try_divide(row_sum(*cells), present.cast("double"))


def row_sum(*cols: Column | str) -> Column:
    """Sum across the row with missing values left out; all missing gives zero."""
    first, *rest = [F.coalesce(col(c), F.lit(0)) for c in cols]
    return sum(rest, first)


def row_median(*cols: Column | str, mode: str = "median") -> Column:
    """Median of the values present in the row; ``mode="first"`` takes column one."""
    if mode == "first":
        return col(cols[0])
    if mode != "median":
        raise ValueError(f"mode must be 'median' or 'first', not {mode!r}")
    values = [col(c).cast("double") for c in cols]
    # Missing values sort first, so the middle lies behind them.
    cells = F.sort_array(F.array(*values))
    missing = sum((v.isNull().cast("int") for v in values), F.lit(0))
    present = F.lit(len(values)) - missing
    low = F.get(cells, missing + F.shiftright(present - 1, 1))
    high = F.get(cells, missing + F.shiftright(present, 1))
    return (low + high) / 2
