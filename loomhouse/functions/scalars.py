"""Conversions of single values, as Column expressions.

Every function takes a Column or a column name and gives a Column; a value that cannot be
converted gives the default.  Nothing here leaves the JVM.
"""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as true and as false.
TRUE_VALUES = (True, 1, "1", "t", "true", "True")
FALSE_VALUES = (False, 0, "0", "f", "false", "False")

Value = Column | str


def _c(value: Value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _or(value: Column, default: Any) -> Column:
    return value if default is None else F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def getint(value: Value, default: Any = None) -> Column:
    return _or(_c(value).try_cast("bigint"), default)


def getfloat(value: Value, default: Any = None) -> Column:
    return _or(_c(value).try_cast("double"), default)


def getstr(value: Value, default: Any = None) -> Column:
    """The text of a value; null is 'None' unless a default is given."""
    return _or(_c(value).cast("string"), "None" if default is None else default)


def getstrippedstr(value: Value, default: Any = None) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(getstr(value, default), r"^\s+|\s+$", "")


def getstrornullvalue(value: Value, nullvalue: str = "None") -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit(nullvalue))


def getdbfriendlystr(value: Value, nullvalue: str = "None", boolean: bool = False) -> Column:
    """Text for a bulk file; with `boolean`, true and false become 1 and 0."""
    v = _c(value)
    text = v.cast("int").cast("string") if boolean else v.cast("string")
    return F.coalesce(text, F.lit(nullvalue))


def getsqlfriendlystr(value: Value, quoted: bool = True) -> Column:
    """A SQL literal: NULL, a number, or a quoted text with its quotes doubled."""
    text = _c(value).cast("string")
    if quoted:
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def getbool(value: Value, default: Any = None, truevalues: tuple = TRUE_VALUES, falsevalues: tuple = FALSE_VALUES) -> Column:
    """Membership in the two lists, compared as text."""
    text = _c(value).cast("string")
    said = lambda some: text.isin(sorted({str(x).lower() if isinstance(x, bool) else str(x) for x in some}))
    return _or(F.when(said(truevalues), F.lit(True)).when(said(falsevalues), F.lit(False)), default)


def getdate(value: Value, default: Any = None) -> Column:
    """A date from year-month-day text, digits not padded or padded."""
    return _or(F.try_to_timestamp(_c(value).cast("string"), F.lit("y-M-d")).cast("date"), default)


def gettimestamp(value: Value, default: Any = None) -> Column:
    """A timestamp without time zone from year-month-day hour:minute:second text."""
    return _or(_c(value).cast("string").try_cast("timestamp_ntz"), default)


def ymdparser(value: Value) -> Column:
    """A date from text that may stand in quotes; dates pass through."""
    return F.to_date(F.trim(F.regexp_replace(_c(value).cast("string"), "^[\\s'\"]+|[\\s'\"]+$", "")))


def ymdhmsparser(value: Value) -> Column:
    """A timestamp from text that may stand in quotes; timestamps pass through."""
    return F.regexp_replace(_c(value).cast("string"), "^[\\s'\"]+|[\\s'\"]+$", "").cast("timestamp_ntz")


def datereader(attribute: str, parser=ymdparser):
    """A finder of from-dates: a function of the mapped attributes that reads one of them as a date."""

    def find(namemapping: dict[str, str]) -> Column:
        return parser(F.col(f"`{namemapping.get(attribute, attribute)}`"))

    return find


def datetimereader(attribute: str, parser=ymdhmsparser):
    return datereader(attribute, parser)


_frozen: dict[str, Any] = {}


def today() -> Column:
    """The date of the first call in this load, the same ever after."""
    return F.lit(_frozen.setdefault("today", datetime.date.today()))


def now() -> Column:
    """The time of the first call in this load, the same ever after."""
    return F.lit(_frozen.setdefault("now", datetime.datetime.now())).cast("timestamp_ntz")


def toupper(value: Value) -> Column:
    return F.upper(_c(value))


def tolower(value: Value) -> Column:
    return F.lower(_c(value))


def keepasis(value: Value) -> Column:
    return _c(value)
