"""Dimensions: a whole batch of rows is looked up, ensured, updated or inserted at once.

A dimension holds its current members as a DataFrame in `table`.  Operators take a DataFrame
of incoming rows, plan joins and aggregates, and set `table` to the new state; those that give
keys return the rows with the key column added.  Arrival order is explicit: `order_by` names
the columns that say which of several rows for one member came first (all columns, if not
given).  `namemapping` is {attribute of the dimension: column of the rows}.

Nulls in a business key match each other unless null_safe is False.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from loomhouse.plans.store import Held, Warehouse, getdefaulttargetconnection, staged
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import highest, numbered
from .matching import Mapped, differs, extreme, mapped, own, prefixed, require, same

ARRIVAL = "_arrival"


class Dimension(Held):
    """A dimension with a surrogate key, attributes, and a business key (`lookupatts`, all attributes if not given).

    idfinder(new rows) -> Column gives keys in place of consecutive ones; rowexpander(new rows)
    -> rows fills in attributes of members that are about to be inserted; a member whose key is
    `defaultidvalue` counts as absent.
    """

    def __init__(
        self,
        name: str,
        key: str,
        attributes: Sequence[str],
        lookupatts: Sequence[str] = (),
        idfinder: Callable[[DataFrame], Column] | None = None,
        defaultidvalue: Any = None,
        rowexpander: Callable[[DataFrame], DataFrame] | None = None,
        targetconnection: Warehouse | None = None,
        *,
        table: DataFrame | None = None,
        order_by: Sequence[str] | None = None,
        null_safe: bool = True,
        dependson: Sequence[Any] = (),
    ):
        if not isinstance(name, str) or not name:
            raise ValueError("a name is needed")
        if not isinstance(key, str) or not key:
            raise ValueError("a key is needed")
        if isinstance(attributes, str) or not len(attributes):
            raise ValueError("attributes are needed")
        if isinstance(lookupatts, str) or set(lookupatts) - set(attributes):
            raise ValueError("lookupatts must be attributes")
        if key in attributes:
            raise ValueError("the key is no attribute")
        self.name, self.key = name, key
        self.attributes, self.lookupatts = list(attributes), list(lookupatts) or list(attributes)
        self.all = [key, *self.attributes]
        self.idfinder, self.defaultidvalue, self.rowexpander = idfinder, defaultidvalue, rowexpander
        self.order_by, self.null_safe, self.dependson = order_by, null_safe, tuple(dependson)
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

    # what other operators build on
    def _order(self, df: DataFrame) -> list[str]:
        return list(self.order_by) if self.order_by else list(df.columns)

    def _incoming(self, df: DataFrame, namemapping: Mapped, atts: Sequence[str]) -> DataFrame:
        """The rows by the dimension's names: `atts` that are there, and what the order needs under names of its own."""
        order = self._order(df)
        chosen = [own(mapped(a, namemapping)).alias(a) for a in atts if mapped(a, namemapping) in df.columns]
        return df.select(*chosen, F.struct(*[own(c) for c in order]).alias(ARRIVAL))

    def _current(self) -> DataFrame:
        """(business key, surrogate key), one row for each business key."""
        found = self.table
        if self.defaultidvalue is not None:
            found = found.where(differs(own(self.key), F.lit(self.defaultidvalue)))
        return found.groupBy(*[own(a) for a in self.lookupatts]).agg(F.min(own(self.key)).alias(self.key))

    def _on(self, df: DataFrame, namemapping: Mapped, prefix: str) -> Column:
        require(df, [mapped(a, namemapping) for a in self.lookupatts])
        return same([(own(mapped(a, namemapping)), own(prefix + a)) for a in self.lookupatts], self.null_safe)

    def lookup(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """The rows with the key of the member they name, `defaultidvalue` where there is none."""
        into = into or mapped(self.key, namemapping)
        left = df.drop(into)
        members = prefixed(self._current(), "_m_")
        met = left.join(members, self._on(left, namemapping, "_m_"), "left")
        key = own(f"_m_{self.key}")
        if self.defaultidvalue is not None:
            key = F.coalesce(key, F.lit(self.defaultidvalue))
        return met.select(*[own(c) for c in left.columns], key.alias(into))

    def lookuprow(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """The rows' business keys with the whole member; nulls where there is none."""
        keyed = self.lookup(df.select(*[own(mapped(a, namemapping)).alias(f"_q_{a}") for a in self.lookupatts]), {a: f"_q_{a}" for a in self.lookupatts}, into="_found")
        return keyed.join(prefixed(self.table, "_t_"), own("_found") == own(f"_t_{self.key}"), "left").select(*[own(f"_t_{a}").alias(a) for a in self.all])

    def getbykey(self, keys: Any) -> DataFrame:
        """Whole members by key: a value, a dict, or a DataFrame with the key column; all nulls where there is none."""
        if isinstance(keys, Mapping):
            keys = keys[self.key]
        if not isinstance(keys, DataFrame):
            keys = self.table.sparkSession.createDataFrame([(keys,)], f"{self.key} bigint")
        asked = keys.select(own(self.key).alias("_asked"))
        return asked.join(prefixed(self.table, "_t_"), own("_asked") == own(f"_t_{self.key}"), "left").select(*[own(f"_t_{a}").alias(a) for a in self.all])

    def getbyvals(self, values: Mapping[str, Any] | DataFrame, namemapping: Mapped = None) -> DataFrame:
        """All members equal on the attributes given: a dict, or a DataFrame of combinations."""
        if isinstance(values, DataFrame):
            atts = [a for a in self.all if mapped(a, namemapping) in values.columns]
            if not atts:
                raise ValueError("no attribute to search by")
            asked = values.select(*[own(mapped(a, namemapping)).alias(f"_q_{a}") for a in atts]).distinct()
            return self.table.join(asked, same([(own(a), own(f"_q_{a}")) for a in atts], self.null_safe), "left_semi").select(*self.all)
        atts = [a for a in self.all if mapped(a, namemapping) in values]
        if not atts:
            raise ValueError("no attribute to search by")
        out = self.table
        for a in atts:
            value = F.lit(values[mapped(a, namemapping)])
            out = out.where(own(a).eqNullSafe(value) if self.null_safe else own(a) == value)
        return out.select(*self.all)

    def update(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """Set the attributes that the rows have, by key; of several rows for a key the last counts.  Returns the new table."""
        key = mapped(self.key, namemapping)
        require(df, [key])
        atts = [a for a in self.attributes if mapped(a, namemapping) in df.columns]
        if atts:
            rows = extreme(self._incoming(df, namemapping, [self.key, *atts]), [self.key], [ARRIVAL], last=True)
            met = self.table.join(prefixed(rows.drop(ARRIVAL), "_n_"), own(self.key) == own(f"_n_{self.key}"), "left")
            hit = own(f"_n_{self.key}").isNotNull()
            self.table = met.select(*[(F.when(hit, own(f"_n_{c}")).otherwise(own(c)).cast(self.table.schema[c].dataType).alias(c) if c in atts else own(c)) for c in self.table.columns])
        return self.table

    def _with_keys(self, new: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        """New members with their keys under `_key`: own ones that are not null, else idfinder's or the next numbers."""
        if self.idfinder is not None:
            made = staged(new.withColumn("_made", self.idfinder(new)))
        else:
            needs = new
            if self.key in new.columns:
                given = new.where(own(self.key).isNotNull()).withColumn("_made", own(self.key).cast("bigint"))
                top = max(highest(self.table, self.key), highest(given, self.key))
                made = given.unionByName(numbered(new.where(own(self.key).isNull()), order, "_made", top))
            else:
                made = numbered(needs, order, "_made", highest(self.table, self.key))
        key = F.coalesce(own(self.key).cast(made.schema["_made"].dataType), own("_made")) if self.key in new.columns else own("_made")
        return made.withColumn("_key", key).drop("_made")

    def _member(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows in the shape of the table; attributes that are not there are null."""
        cast = lambda c, v: v.cast(self.table.schema[c].dataType).alias(c)
        return rows.select(*[cast(c, own(key)) if c == self.key else cast(c, own(c) if c in rows.columns else F.lit(None)) for c in self.table.columns])

    def _expanded(self, new: DataFrame) -> DataFrame:
        if self.rowexpander is None:
            return new
        out = self.rowexpander(new)
        if not isinstance(out, DataFrame):
            raise TypeError("rowexpander must return a DataFrame")
        return out

    def missing(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """The first row of each member that the dimension lacks."""
        rows = self._incoming(df, namemapping, [a for a in self.attributes])
        members = prefixed(self._current(), "_m_")
        absent = rows.join(members, self._on(rows, None, "_m_"), "left_anti")
        return extreme(absent, self.lookupatts, [ARRIVAL])

    def ensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """The rows with their members' keys, after members that were absent have been inserted."""
        new = self._expanded(self.missing(df, namemapping))
        kept = self._with_keys(new, [ARRIVAL])
        self.grow(self._member(kept, "_key"))
        return self.lookup(df, namemapping, into)

    def insert(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """Insert every row, without a look for members that are there; returns the rows with their keys."""
        into = into or mapped(self.key, namemapping)
        key = mapped(self.key, namemapping)
        order = [own(c) for c in self._order(df)]
        rows = df.withColumns({f"_a_{a}": own(mapped(a, namemapping)) for a in self.attributes if mapped(a, namemapping) in df.columns})
        if key != self.key and key in rows.columns:
            rows = rows.withColumn(self.key, own(key))
        keyed = self._with_keys(rows, order)
        member = keyed.select(own("_key"), *[own(f"_a_{a}").alias(a) for a in self.attributes if f"_a_{a}" in keyed.columns])
        self.grow(self._member(member, "_key"))
        return keyed.select(*[own(c) for c in df.columns if c != into], own("_key").alias(into))

    def endload(self) -> None:
        """Nothing is held back: `table` is the whole state."""


class CachedDimension(Dimension):
    """A Dimension; sizes of caches are taken and not needed, as Spark broadcasts members that are small."""

    def __init__(self, *args: Any, size: int = 10_000, prefill: bool = False, cachefullrows: bool = False, cacheoninsert: bool = True, usefetchfirst: bool = False, **named: Any):
        super().__init__(*args, **named)
        if prefill:
            self.table = self.table.persist()


class BulkDimension(Dimension):
    """A Dimension whose new members also go to a loader: bulkloader(name, attributes, fieldsep, rowsep, nullsubst, path) at endload."""

    def __init__(self, *args: Any, bulkloader: Callable | None = None, fieldsep: str = "\t", rowsep: str = "\n", nullsubst: str | None = None, tempdest: str | None = None, bulksize: int = 500_000, strconverter: Callable[[Column], Column] | None = None, **named: Any):
        super().__init__(*args, **named)
        from .facts import BulkFile

        self.bulk = BulkFile(self.name, self.all, bulkloader, fieldsep, rowsep, nullsubst, tempdest, strconverter) if bulkloader else None

    def _with_keys(self, new: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        kept = super()._with_keys(new, order)
        if self.bulk is not None:
            self.bulk.add(self._member(kept, "_key").select(*self.all))
        return kept

    def endload(self) -> None:
        if self.bulk is not None:
            self.bulk.load()


class CachedBulkDimension(BulkDimension):
    def __init__(self, *args: Any, cachesize: int = 10_000, **named: Any):
        super().__init__(*args, **named)


class TypeOneSlowlyChangingDimension(Dimension):
    """Members whose type 1 attributes are overwritten (all but the business key, unless given)."""

    def __init__(self, name: str, key: str, attributes: Sequence[str], lookupatts: Sequence[str], type1atts: Sequence[str] = (), cachesize: int = 10_000, prefill: bool = False, **named: Any):
        super().__init__(name, key, attributes, lookupatts, **named)
        free = [a for a in self.attributes if a not in self.lookupatts]
        if set(type1atts) - set(self.attributes):
            raise ValueError("type1atts must be attributes")
        if set(type1atts) & set(self.lookupatts):
            raise ValueError("a business key does not change")
        if not free:
            raise ValueError("no attribute may change")
        self.type1atts = list(type1atts) or free

    def scdensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """Insert members that are absent; else overwrite type 1 attributes that the rows have, the last row winning."""
        atts = [a for a in self.type1atts if mapped(a, namemapping) in df.columns]
        rows = self._incoming(df, namemapping, [*self.lookupatts, *atts])
        last = extreme(rows, self.lookupatts, [ARRIVAL], last=True)
        out = self.ensure(df, namemapping, into)
        if atts:
            news = prefixed(last.drop(ARRIVAL).withColumn("_hit", F.lit(True)), "_n_")
            met = self.table.join(news, same([(own(a), own(f"_n_{a}")) for a in self.lookupatts], self.null_safe), "left")
            hit = F.coalesce(own("_n__hit"), F.lit(False))
            self.table = met.select(*[(F.when(hit, own(f"_n_{c}")).otherwise(own(c)).cast(self.table.schema[c].dataType).alias(c) if c in atts else own(c)) for c in self.table.columns])
        return out
