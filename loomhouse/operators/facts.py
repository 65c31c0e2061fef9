"""Fact tables, accumulating snapshots, and files for bulk loaders."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Mapping, Sequence
from itertools import chain
from typing import Any

from loomhouse.functions.scalars import getdbfriendlystr
from loomhouse.plans.store import Error, Held, Warehouse, getdefaulttargetconnection, shared_dir, staged
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import Mapped, differs, extreme, mapped, own, prefixed, require, same

ARRIVAL = "_arrival"


class FactTable(Held):
    """Facts named by `keyrefs` (references to dimensions), with measures; `table` is the current state."""

    def __init__(self, name: str, keyrefs: Sequence[str], measures: Sequence[str] = (), targetconnection: Warehouse | None = None, *, table: DataFrame | None = None, order_by: Sequence[str] | None = None, dependson: Sequence[Any] = ()):
        self.name, self.keyrefs, self.measures = name, list(keyrefs), list(measures)
        self.all = [*self.keyrefs, *self.measures]
        self.order_by, self.dependson = order_by, tuple(dependson)
        self.targetconnection = targetconnection or getdefaulttargetconnection()
        if table is None:
            if self.targetconnection is None:
                raise ValueError("a table or a warehouse is needed")
            table = self.targetconnection.read(name)
            self.published(table)
        else:
            self.table = table
        require(table, self.all)
        if self.targetconnection is not None:
            self.targetconnection.register(self)

    def _rows(self, df: DataFrame, namemapping: Mapped, arrival: bool = True) -> DataFrame:
        """The rows by the table's names, attributes that are there only."""
        require(df, [mapped(a, namemapping) for a in self.keyrefs])
        chosen = [own(mapped(a, namemapping)).alias(a) for a in self.table.columns if mapped(a, namemapping) in df.columns]
        order = list(self.order_by) if self.order_by else list(df.columns)
        return df.select(*chosen, *([F.struct(*[own(c) for c in order]).alias(ARRIVAL)] if arrival else []))

    def _shaped(self, df: DataFrame) -> DataFrame:
        return df.select(*[(own(c) if c in df.columns else F.lit(None)).cast(self.table.schema[c].dataType).alias(c) for c in self.table.columns])

    def insert(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """Append the rows.  Returns what was appended."""
        new = self._shaped(self._rows(df, namemapping, arrival=False))
        self.grow(new)
        return new

    def _on(self, prefix: str) -> Column:
        return same([(own(k), own(prefix + k)) for k in self.keyrefs], null_safe=False)

    def lookup(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """The fact of each row's keyrefs, all nulls where there is none."""
        asked = df.select(*[own(mapped(k, namemapping)).alias(f"_q_{k}") for k in self.keyrefs])
        met = asked.join(self.table, same([(own(f"_q_{k}"), own(k)) for k in self.keyrefs], null_safe=False), "left")
        return met.select(*[own(c) for c in self.all])

    def ensure(self, df: DataFrame, compare: bool = False, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """Insert the first row of each absent fact.  Returns the rows with whether the fact was there before.

        With `compare`, a row whose measures differ from the fact's raises.
        """
        into = into or "existed"
        rows = self._rows(df, namemapping)
        known = prefixed(self.table.select(*self.keyrefs).distinct(), "_t_")
        first = extreme(rows.join(known, self._on("_t_"), "left_anti"), self.keyrefs, [ARRIVAL])
        new = staged(self._shaped(first.drop(ARRIVAL)), "facts")
        before = self.table
        if compare:
            here = [m for m in self.measures if m in rows.columns]
            all_facts = prefixed(before.unionByName(new), "_t_")
            wrong = F.lit(False)
            for m in here:
                wrong = wrong | differs(own(m), own(f"_t_{m}"))
            if here and not rows.join(all_facts, self._on("_t_")).where(wrong).isEmpty():
                raise ValueError("a fact exists with other measures")
        self.grow(new)
        there = prefixed(before.select(*self.keyrefs).distinct().withColumn("hit", F.lit(True)), "_t_")
        names = {k: mapped(k, namemapping) for k in self.keyrefs}
        met = df.join(there, same([(own(names[k]), own(f"_t_{k}")) for k in self.keyrefs], null_safe=False), "left")
        return met.select(*[own(c) for c in df.columns if c != into], F.coalesce(own("_t_hit"), F.lit(False)).alias(into))

    def endload(self) -> None:
        """Nothing is held back."""


class BatchFactTable(FactTable):
    """A FactTable: a DataFrame is a batch already, so batch sizes are taken and not needed."""

    def __init__(self, *args: Any, batchsize: int = 10_000, usemultirow: bool = False, **named: Any):
        super().__init__(*args, **named)
        self.batchsize, self.awaitingrows = batchsize, 0


class AccumulatingSnapshotFactTable(FactTable):
    """Facts that are filled in over time: later rows set otherrefs and measures, nulls set nothing unless told otherwise.

    factexpander: {attribute: f(changed)} where changed(name) is a Column that is true if the row
    changed `name` of a fact that was there; the expression may use the row's other attributes as they then stand.
    """

    def __init__(self, name: str, keyrefs: Sequence[str], otherrefs: Sequence[str] = (), measures: Sequence[str] = (), ignorenonerefs: bool = True, ignorenonemeasures: bool = True, factexpander: Mapping[str, Callable[[Callable[[str], Column]], Column]] | None = None, **named: Any):
        super().__init__(name, keyrefs, [*otherrefs, *measures], **named)
        self.otherrefs = list(otherrefs)
        self.ignores = {a: (ignorenonerefs if a in self.otherrefs else ignorenonemeasures) for a in self.measures}
        self.factexpander = dict(factexpander or {})

    def _fold(self, rows: DataFrame, only_known: bool) -> DataFrame:
        here = [a for a in self.measures if a in rows.columns]
        old = self.table.select(*self.all)
        keys = [own(k) for k in self.keyrefs]
        touched = rows.select(*self.keyrefs).distinct()
        start = old.join(prefixed(touched, "_b_"), same([(own(k), own(f"_b_{k}")) for k in self.keyrefs], null_safe=False), "left_semi")
        arrival = rows.schema[ARRIVAL].dataType
        shape = lambda d, o: d.select(*keys, *[(own(a) if a in d.columns else F.lit(None)).cast(self.table.schema[a].dataType).alias(a) for a in self.measures], F.lit(o).alias("_old"), (own(ARRIVAL) if ARRIVAL in d.columns else F.lit(None).cast(arrival)).alias(ARRIVAL))
        if only_known:
            rows = rows.join(prefixed(old.select(*self.keyrefs).distinct(), "_o_"), same([(own(k), own(f"_o_{k}")) for k in self.keyrefs], null_safe=False), "left_semi")
        both = shape(start, 0).unionByName(shape(rows, 1))
        rank = F.struct("_old", ARRIVAL)
        skips = {a: self.ignores[a] or a not in here for a in self.measures}
        if not self.factexpander:  # the last value of each, combined before the shuffle: a fact of very many rows is one row for each task
            last = {a: F.max_by(own(a), F.when(own(a).isNotNull() | F.lit(not skips[a]), rank)) for a in self.measures}
            return both.groupBy(*keys).agg(*[v.alias(a) for a, v in last.items()])
        window = Window.partitionBy(*keys).orderBy("_old", ARRIVAL)
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        state = both.withColumns({a: F.last(own(a), ignorenulls=skips[a]).over(upto) for a in self.measures if a not in self.factexpander})
        # a row that inserts its fact changes nothing, so it is not expanded
        changed = lambda name: F.coalesce(F.lag("_old").over(window).isNotNull() & differs(own(name), F.lag(own(name)).over(window)), F.lit(False))
        # an expanded attribute keeps its value until the next row that its expression speaks of
        made = {a: F.coalesce(f(changed), own(a)) for a, f in self.factexpander.items()}
        state = state.withColumns(made)
        state = state.withColumns({a: F.last(own(a), ignorenulls=True).over(upto) for a in self.factexpander})
        return state.groupBy(*keys).agg(*[F.max_by(own(a), rank).alias(a) for a in self.measures])

    def _merge(self, folded: DataFrame) -> DataFrame:
        """The table with folded facts, written: the next load's plan begins there, however many loads went before."""
        new = staged(self._shaped(folded), "folded")
        rest = self.table.join(prefixed(new.select(*self.keyrefs), "_f_"), self._on("_f_"), "left_anti")
        self.table = staged(rest.unionByName(new), "snapshot")
        return self.table

    def ensure(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:  # type: ignore[override]
        """Insert absent facts and fill in known ones, row after row in arrival order.  Returns the new table."""
        return self._merge(self._fold(staged(self._rows(df, namemapping), "rows"), only_known=False))

    def update(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """Fill in known facts; rows of absent ones raise."""
        rows = staged(self._rows(df, namemapping), "rows")
        known = prefixed(self.table.select(*self.keyrefs).distinct(), "_t_")
        if not rows.join(known, self._on("_t_"), "left_anti").isEmpty():
            raise KeyError("an absent fact cannot be updated")
        return self._merge(self._fold(rows, only_known=True))


class BulkFile:
    """Rows as text files for a DBMS's loader: one folder for each load, no escaping, as loaders expect."""

    def __init__(self, name: str, atts: Sequence[str], bulkloader: Callable, fieldsep: str = "\t", rowsep: str = "\n", nullsubst: str | None = None, tempdest: str | None = None, strconverter: Callable[[Column], Column] | None = None):
        self.name, self.atts, self.bulkloader = name, list(atts), bulkloader
        self.fieldsep, self.rowsep, self.nullsubst, self.tempdest, self.strconverter = fieldsep, rowsep, nullsubst, tempdest, strconverter
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)

    def lines(self, df: DataFrame) -> DataFrame:
        return df.select(*[_text(df, a, self.nullsubst, self.strconverter).alias(a) for a in self.atts]).select(F.concat_ws(self.fieldsep, *[own(a) for a in self.atts]).alias("value"))

    def load(self) -> list[str]:
        """Write what was added and call the loader for each folder of files."""
        paths = []
        for k, df in enumerate(self.parts):
            if self.nullsubst is None:
                none = F.lit(False)
                for a in self.atts:
                    none = none | own(a).isNull()
                if not df.where(none).isEmpty():
                    raise TypeError("nulls need a nullsubst")
            path = f"{self.tempdest or shared_dir(df.sparkSession)}/bulk-{self.name}-{k}-{id(self)}"
            self.lines(df).write.mode("overwrite").option("lineSep", self.rowsep).text(path)
            self.bulkloader(self.name, self.atts, self.fieldsep, self.rowsep, self.nullsubst, path)
            paths.append(path)
        self.parts = []
        return paths


def _text(df: DataFrame, att: str, nullsubst: str | None, strconverter: Callable[[Column], Column] | None = None) -> Column:
    if strconverter is not None:  # its nulls are substituted too
        return F.coalesce(strconverter(own(att)), F.lit("" if nullsubst is None else nullsubst))
    boolean = isinstance(df.schema[att].dataType, T.BooleanType)
    return getdbfriendlystr(own(att), "" if nullsubst is None else nullsubst, boolean)


class BulkFactTable(FactTable):
    """A FactTable whose rows also go to a bulk loader at endload."""

    def __init__(self, name: str, keyrefs: Sequence[str], measures: Sequence[str] = (), bulkloader: Callable | None = None, fieldsep: str = "\t", rowsep: str = "\n", nullsubst: str | None = None, tempdest: str | None = None, bulksize: int = 500_000, strconverter: Callable[[Column], Column] | None = None, **named: Any):
        super().__init__(name, keyrefs, measures, **named)
        self.bulk = BulkFile(name, self.all, bulkloader, fieldsep, rowsep, nullsubst, tempdest, strconverter) if bulkloader else None

    def insert(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        new = super().insert(df, namemapping)
        if self.bulk is not None:
            self.bulk.add(new.select(*self.all))
        return new

    def endload(self) -> None:
        if self.bulk is not None:
            self.bulk.load()


class SubprocessFactTable:
    """Rows as lines of text to a shell command, one process for each task (one in all with parallel=False)."""

    def __init__(self, keyrefs: Sequence[str], measures: Sequence[str], executable: str, initcommand: str | None = None, endcommand: str | None = None, fieldsep: str = "\t", rowsep: str = "\n", nullsubst: str = "", parallel: bool = True, strconverter: Callable[[Column], Column] | None = None):
        self.all, self.strconverter = [*keyrefs, *measures], strconverter
        self.executable, self.initcommand, self.endcommand = executable, initcommand, endcommand
        self.fieldsep, self.rowsep, self.nullsubst, self.parallel = fieldsep, rowsep, nullsubst, parallel

    def insert(self, df: DataFrame, namemapping: Mapped = None) -> None:
        chosen = df.select(*[own(mapped(a, namemapping)).alias(a) for a in self.all])
        lines = chosen.select(F.concat_ws(self.fieldsep, *[_text(chosen, a, self.nullsubst, self.strconverter) for a in self.all]).alias("value"))
        command, before, after, sep = self.executable, self.initcommand, self.endcommand, self.rowsep

        def pipe(rows) -> None:
            run = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE)
            try:
                for line in chain([before] if before else [], (row[0] for row in rows), [after] if after else []):
                    run.stdin.write((line + sep).encode())
                run.stdin.close()
            except BrokenPipeError:  # it ended early: the code below says how
                pass
            if run.wait():
                raise Error(f"{command} ended with {run.returncode}")

        (lines if self.parallel else lines.coalesce(1)).foreachPartition(pipe)


class Decoupled:
    """A dimension or fact table behind the same methods: Spark runs each load in parallel, so nothing is put aside."""

    def __init__(self, table: Any, returnvalues: bool = True, **_: Any):
        self._table = table

    def __getattr__(self, name: str) -> Any:
        return getattr(self._table, name)


DecoupledDimension = DecoupledFactTable = Decoupled
