"""A table drawn with | and -, put into a warehouse or compared with what is there.

    | id:int (pk) | title:text (not null) | genreid:int (fk genre(id)) |
    | ----------- | --------------------- | -------------------------- |
    | 1           | Unknown               | $genre                     |

Types and constraints stand in the header; columns of the primary key come first.  A cell that
reads like `nullsubst` is null.  A cell that starts with `variableprefix` is a variable: it takes
the value that the warehouse has in the one row that is equal in all other cells; all uses of
one name must agree, $_ may be anything, and $_! anything but null.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal
from typing import Any

from loomhouse.plans.store import Warehouse, getdefaulttargetconnection, quoted
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types of a drawing, their Spark types, and how a cell is read.
TYPES: dict[str, tuple[T.DataType, Callable[[str], Any]]] = {
    "smallint": (T.ShortType(), int),
    "int": (T.IntegerType(), int),
    "integer": (T.IntegerType(), int),
    "bigint": (T.LongType(), int),
    "real": (T.FloatType(), float),
    "double precision": (T.DoubleType(), float),
    "char": (T.StringType(), str),
    "varchar": (T.StringType(), str),
    "text": (T.StringType(), str),
    "boolean": (T.BooleanType(), lambda x: x.lower() in ("1", "t", "true")),
    "date": (T.DateType(), datetime.date.fromisoformat),
    "timestamp": (T.TimestampNTZType(), datetime.datetime.fromisoformat),
}

_known: dict[str, tuple[str, Any]] = {}


def clearvariables() -> None:
    """Forget the values that variables have taken."""
    _known.clear()


class Variable:
    def __init__(self, text: str, prefix: str):
        self.text, self.name = text, text[len(prefix) :]

    def __repr__(self) -> str:
        return self.text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Variable) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)

    def take(self, value: Any, where: str) -> Any:
        if self.name == "_":
            return value
        if self.name == "_!":
            if value is None:
                raise AssertionError(f"{where} must not be null")
            return value
        origin, known = _known.setdefault(self.text, (where, value))
        if known != value:
            raise AssertionError(f"{self.text} is {known!r} in {origin} and {value!r} in {where}")
        return value


def _type(text: str) -> tuple[T.DataType, Callable[[str], Any]]:
    text = re.sub(r"\s+", " ", text.strip().lower())
    base = re.sub(r"\s*\(.*", "", text)
    if base in ("decimal", "numeric"):
        size = re.search(r"\((\d+)(?:\s*,\s*(\d+))?\)", text)
        kind = T.DecimalType(int(size[1]), int(size[2] or 0)) if size else T.DecimalType(38, 0)
        return kind, lambda x: Decimal(x).quantize(Decimal(1).scaleb(-kind.scale))
    if base not in TYPES:
        raise ValueError(f"no type {text}")
    return TYPES[base]


class Table:
    """A drawn table; operations that change it give a new one."""

    def __init__(self, name: str, table: str, nullsubst: str = "NULL", variableprefix: str = "$", loadFrom: str | Iterable[Mapping[str, Any]] | None = None, testconnection: Warehouse | None = None):
        self.name, self.nullsubst, self.variableprefix = name, nullsubst, variableprefix
        self.warehouse = testconnection or getdefaulttargetconnection()
        lines = [x.strip() for x in table.strip().splitlines() if x.strip()]
        if not lines:
            raise ValueError("an empty drawing")
        if isinstance(loadFrom, str):
            with open(loadFrom) as more:
                lines += [x.strip() for x in more if x.strip()]
            loadFrom = None
        self.columns: list[str] = []
        self.types: list[str] = []
        self.keyrefs: list[str] = []
        self.unique: list[str] = []
        self.notnull: list[str] = []
        self.foreign: dict[str, tuple[str, str]] = {}
        for cell in self._cells(lines[0]):
            self._column(cell)
        if self.keyrefs != self.columns[: len(self.keyrefs)]:
            raise ValueError("columns of the primary key come first")
        if len(lines) > 1 and not re.fullmatch(r"[|\s:-]+", lines[1]):
            raise ValueError("the second line must separate the header")
        self.rows: list[tuple] = [self._row(self._cells(x)) for x in lines[2:]]
        for given in loadFrom or ():
            self.rows.append(tuple(self._value(c, given[c]) for c in self.columns))

    # reading the drawing
    @staticmethod
    def _cells(line: str) -> list[str]:
        line = line.strip()
        if not line.startswith("|") or not line.endswith("|"):
            raise ValueError(f"a line must stand between pipes: {line}")
        return [c.strip() for c in line[1:-1].split("|")]

    def _column(self, cell: str) -> None:
        m = re.fullmatch(r"(\w+)\s*:\s*([a-zA-Z ]+?(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?)\s*(?:\((.*)\))?", cell)
        if not m:
            raise ValueError(f"a column is name:type (constraints): {cell}")
        name, kind, rest = m.groups()
        _type(kind)
        self.columns.append(name)
        self.types.append(kind)
        for one in re.split(r",(?![^(]*\))", rest or ""):
            one = one.strip()
            low = one.lower()
            if not one:
                continue
            if low in ("pk", "primary key"):
                self.keyrefs.append(name)
            elif low == "unique":
                self.unique.append(name)
            elif low == "not null":
                self.notnull.append(name)
            elif fk := re.fullmatch(r"fk\s+(\w+)\s*\(\s*(\w+)\s*\)", one, re.I):
                self.foreign[name] = (fk[1], fk[2])
            else:
                raise ValueError(f"no constraint {one}")

    def _value(self, column: str, value: Any) -> Any:
        if not isinstance(value, str):
            return value
        if value == self.nullsubst:
            return None
        if self.variableprefix and value.startswith(self.variableprefix) and len(value) > len(self.variableprefix):
            return Variable(value, self.variableprefix)
        return _type(self.types[self.columns.index(column)])[1](value)

    def _row(self, cells: Sequence[str]) -> tuple:
        if len(cells) != len(self.columns):
            raise ValueError(f"{len(cells)} cells for {len(self.columns)} columns")
        return tuple(self._value(c, v) for c, v in zip(self.columns, cells))

    # the object as a value
    def _with(self, rows: list[tuple]) -> Table:
        new = object.__new__(Table)
        new.__dict__.update(self.__dict__, rows=rows)
        return new

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        return (dict(zip(self.columns, r)) for r in self.rows)

    def __getitem__(self, at: int) -> dict[str, Any]:
        return dict(zip(self.columns, self.rows[at]))

    def __add__(self, line: str) -> Table:
        new = self._with([*self.rows, self._row(self._cells(line))])
        new.first = getattr(self, "first", len(self.rows))
        return new

    def update(self, index: int, line: str) -> Table:
        """Row `index` with the cells that are not empty."""
        old, cells = self.rows[index], self._cells(line)
        if len(cells) != len(self.columns):
            raise ValueError(f"{len(cells)} cells for {len(self.columns)} columns")
        row = tuple(self._value(c, v) if v else o for c, v, o in zip(self.columns, cells, old))
        new = self._with([*self.rows[:index], row, *self.rows[index + 1 :]])
        new.first = min(getattr(self, "first", len(self.rows)), index)
        return new

    def additions(self, withKey: bool = False) -> list[dict[str, Any]]:
        """The rows that + has added, with or without the primary key."""
        left = [c for c in self.columns if withKey or c not in self.keyrefs]
        return [{c: r[c] for c in left} for r in list(self)[getattr(self, "first", len(self.rows)) :]]

    def key(self) -> str:
        if len(self.keyrefs) != 1:
            raise ValueError("the primary key has not one column")
        return self.keyrefs[0]

    def attributes(self) -> list[str]:
        return [c for c in self.columns if c not in self.keyrefs]

    def __str__(self) -> str:
        return drawing(self.header(), [[self._shown(v) for v in r] for r in self.rows])

    def _shown(self, value: Any) -> str:
        return self.nullsubst if value is None else str(value)

    def header(self) -> list[str]:
        out = []
        for c, k in zip(self.columns, self.types):
            said = [*(["pk"] if c in self.keyrefs else []), *(["unique"] if c in self.unique else []), *(["not null"] if c in self.notnull else []), *([f"fk {self.foreign[c][0]}({self.foreign[c][1]})"] if c in self.foreign else [])]
            out.append(f"{c}:{k}" + (f" ({', '.join(said)})" if said else ""))
        return out

    # as a DataFrame and in the warehouse
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _type(k)[0]) for c, k in zip(self.columns, self.types)])

    def frame(self) -> DataFrame:
        if any(isinstance(v, Variable) for r in self.rows for v in r):
            raise ValueError("a variable has no value to store")
        return self.warehouse.spark.createDataFrame(self.rows, self.schema())

    def getSQLToCreate(self) -> str:
        fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" + (" NOT NULL" if f.name in (*self.keyrefs, *self.notnull) else "") for f in self.schema())
        return f"CREATE TABLE {quoted(self.name)} ({fields}) USING parquet"

    def getSQLToInsert(self) -> str:
        def literal(v: Any) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, (bool, int, float, Decimal)):
                return str(v)
            if isinstance(v, datetime.datetime):
                return f"TIMESTAMP_NTZ'{v}'"
            if isinstance(v, datetime.date):
                return f"DATE'{v}'"
            return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

        return f"INSERT INTO {quoted(self.name)} ({', '.join(map(quoted, self.columns))}) VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)

    def _stored(self) -> DataFrame:
        return self.warehouse.read(self.name)

    def check(self, frame: DataFrame) -> None:
        """Primary key, unique, not null and foreign keys, by aggregates and anti joins."""
        for keys in [self.keyrefs, *[[u] for u in self.unique]]:
            if keys and not frame.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ValueError(f"{self.name}: {', '.join(keys)} is not unique")
        for c in (*self.keyrefs, *self.notnull):
            if not frame.where(F.col(c).isNull()).isEmpty():
                raise ValueError(f"{self.name}: {c} is null")
        for c, (other, key) in self.foreign.items():
            known = self.warehouse.read(other).select(F.col(key).alias("_key"))
            if not frame.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("_key"), "left_anti").isEmpty():
                raise ValueError(f"{self.name}: {c} refers to no row of {other}")

    def create(self) -> None:
        """An empty table of this shape; it must not be there."""
        if self.name in self.warehouse.tables():
            raise ValueError(f"{self.name} is there already")
        self._publish(self.warehouse.spark.createDataFrame([], self.schema()))

    def _publish(self, frame: DataFrame) -> None:
        self.check(frame)
        self.warehouse.write(self.name, frame)
        self.warehouse.commit()

    def ensure(self) -> None:
        """Create and fill the table; one that is there must have these rows."""
        if self.name in self.warehouse.tables():
            self.assertEqual()
        else:
            self._publish(self.frame())

    def reset(self) -> None:
        """The table with these rows, whatever was there."""
        self._publish(self.frame())

    def clear(self) -> None:
        self._publish(self._stored().limit(0))

    def drop(self) -> None:
        self.warehouse.drop(self.name)

    # comparing
    def _resolved(self, stored: list[tuple]) -> list[tuple]:
        out = []
        for n, row in enumerate(self.rows):
            if not any(isinstance(v, Variable) for v in row):
                out.append(row)
                continue
            fits = [s for s in stored if all(isinstance(v, Variable) or v == w for v, w in zip(row, s))]
            if len(fits) != 1:
                raise ValueError(f"{len(fits)} rows of {self.name} fit row {n}, so its variables have no clear value")
            out.append(tuple(v.take(w, f"{self.name}, row {n}, column {c}") if isinstance(v, Variable) else v for v, w, c in zip(row, fits[0], self.columns)))
        return out

    def _compare(self, verbose: bool, wrong: Callable[[list[tuple], list[tuple]], tuple[list[tuple], list[tuple]]], said: str) -> None:
        stored = [tuple(r) for r in self._stored().select(*self.columns).collect()]  # a test's table, small by its nature
        expected = self._resolved(stored)
        for what, some in (("expected", expected), ("stored", stored)):
            if len(set(some)) < len(some):
                raise ValueError(f"{self.name}: {what} rows repeat")
        e, d = wrong(expected, stored)
        if e or d:
            text = f"{self.name}: {said}"
            if verbose:
                marks = ["E"] * len(e) + ["D"] * len(d)
                text += "\n" + drawing(self.header(), [[self._shown(v) for v in r] for r in (*e, *d)], marks)
            raise AssertionError(text)

    def assertEqual(self, verbose: bool = True) -> None:
        self._compare(verbose, lambda e, d: ([r for r in e if r not in d], [r for r in d if r not in e]), "expected and stored rows differ")

    def assertDisjoint(self, verbose: bool = True) -> None:
        self._compare(verbose, lambda e, d: ([r for r in e if r in d], []), "rows are in both")

    def assertSubset(self, verbose: bool = True) -> None:
        self._compare(verbose, lambda e, d: ([r for r in e if r not in d], []), "expected rows are not stored")


def drawing(header: Sequence[str], rows: Sequence[Sequence[str]], marks: Sequence[str] | None = None) -> str:
    """Aligned text of a table; marks stand before the rows."""
    width = [max(map(len, column)) for column in zip(header, *rows)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    lines = [line(header), line(["-" * w for w in width]), *map(line, rows)]
    if marks is not None:
        lines = [f"{m} {x}" for m, x in zip(["  "[:1], " ", *marks], lines)]
    return "\n".join(lines)


def align(text: str, at: int) -> str:
    """The text with the drawn table around line `at` (from 0) aligned; other lines as they are."""
    lines = text.splitlines()
    first = last = at
    while first > 0 and lines[first - 1].strip().startswith("|"):
        first -= 1
    while last + 1 < len(lines) and lines[last + 1].strip().startswith("|"):
        last += 1
    if not lines[at].strip().startswith("|"):
        return text
    cells = [Table._cells(x) for x in lines[first : last + 1]]
    body = [c for k, c in enumerate(cells) if k != 1]
    indent = lines[first][: len(lines[first]) - len(lines[first].lstrip())]
    drawn = [indent + x for x in drawing(body[0], body[1:]).splitlines()]
    return "\n".join([*lines[:first], *drawn, *lines[last + 1 :]])
