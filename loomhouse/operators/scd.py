"""Type 2 slowly changing dimensions: versions with validity, planned as windows over members."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from loomhouse.functions.scalars import datereader, today, ymdparser
from loomhouse.plans.store import staged
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dimension import ARRIVAL, Dimension
from .keys import highest, numbered
from .matching import Mapped, differs, mapped, own, prefixed, require, same
from .ordered import BITS, PLACE, RANGE, carried, follows, last_rows, ranged, running, within


class SlowlyChangingDimension(Dimension):
    """A dimension with one row for each version of a member.

    orderingatt (or else versionatt, toatt, fromatt) tells which version is newest.  With
    srcdateatt, a row of another date than the newest version's makes a new version, even if
    nothing else changed.  fromfinder and tofinder are functions of the name mapping to a Column;
    by default they read srcdateatt, or give the load's date.  minfrom is the from-date of first
    versions ((None,) for null), maxto the to-date of open ones.  type1atts are overwritten: in
    all versions, or for (attribute, False) in the newest only.
    """

    def __init__(
        self,
        name: str,
        key: str,
        attributes: Sequence[str],
        lookupatts: Sequence[str],
        orderingatt: str | None = None,
        versionatt: str | None = None,
        fromatt: str | None = None,
        fromfinder: Callable[[dict], Column] | None = None,
        toatt: str | None = None,
        tofinder: Callable[[dict], Column] | None = None,
        minfrom: Any = None,
        maxto: Any = None,
        srcdateatt: str | None = None,
        srcdateparser: Callable[[Column], Column] = ymdparser,
        type1atts: Sequence[Any] = (),
        **named: Any,
    ):
        for extra in ("cachesize", "prefill", "usefetchfirst", "useorderby"):
            named.pop(extra, None)
        super().__init__(name, key, attributes, lookupatts, **named)
        for a in (orderingatt, versionatt, fromatt, toatt):
            if a is not None and a not in self.attributes:
                raise ValueError(f"{a} is no attribute")
        self.versionatt, self.fromatt, self.toatt, self.srcdateatt, self.srcdateparser = versionatt, fromatt, toatt, srcdateatt, srcdateparser
        self.orderingatt = orderingatt or versionatt or toatt or fromatt
        if self.orderingatt is None:
            raise ValueError("orderingatt, versionatt, toatt or fromatt is needed")
        default = datereader(srcdateatt, srcdateparser) if srcdateatt else (lambda namemapping: today())
        self.fromfinder = fromfinder or default
        self.tofinder = tofinder or self.fromfinder
        self.minfrom, self.maxto = minfrom, maxto
        pairs = [(a, True) if isinstance(a, str) else (a[0], bool(a[1])) for a in type1atts]
        if {a for a, _ in pairs} - set(self.attributes) or {a for a, _ in pairs} & set(self.lookupatts):
            raise ValueError("type1atts must be attributes outside the business key")
        self.type1everywhere = [a for a, every in pairs if every]
        self.type1newest = [a for a, every in pairs if not every]
        special = {self.orderingatt, versionatt, fromatt, toatt, *self.lookupatts, *(a for a, _ in pairs)}
        self.type2atts = [a for a in self.attributes if a not in special]

    def _newest_first(self) -> Column:
        at = own(self.orderingatt)
        return at.desc_nulls_first() if self.orderingatt == self.toatt else at.desc_nulls_last()

    def _ranked(self) -> DataFrame:
        """The table with `_rank`, 1 for each member's newest version."""
        window = Window.partitionBy(*[own(a) for a in self.lookupatts]).orderBy(self._newest_first(), own(self.key).desc())
        return self.table.withColumn("_rank", F.row_number().over(window))

    def _current(self) -> DataFrame:
        # the newest version by an aggregate: a member with very many versions is one row for each task
        at = own(self.orderingatt)
        null = at.isNull() if self.orderingatt == self.toatt else at.isNotNull()
        rank = F.struct(null.alias("n"), at.alias("a"), own(self.key).alias("k"))
        found = self.table
        if self.defaultidvalue is not None:
            found = found.where(differs(own(self.key), F.lit(self.defaultidvalue)))
        return found.groupBy(*[own(a) for a in self.lookupatts]).agg(F.max(rank)["k"].alias(self.key))

    def scdensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """Add new members and new versions, close the versions they follow, and overwrite type 1 attributes.

        Returns the rows with the key (and version and dates) of the version each one led to.
        """
        into = into or mapped(self.key, namemapping)
        names = dict(namemapping or {})
        require(df, [mapped(a, names) for a in self.lookupatts])
        here = [a for a in self.attributes if mapped(a, names) in df.columns]
        arrival = self._order(df)
        schema = self.table.schema
        typed = lambda a, v: v.cast(schema[a].dataType)

        # the batch, with what every row says about validity
        rows = df.withColumns({"_from": self.fromfinder(names), "_to": self.tofinder(names), "_src": self.srcdateparser(own(mapped(self.srcdateatt, names))) if self.srcdateatt else F.lit(None)})
        # where a row stands: its arrival, ties by a number; the newest known version stands before all rows
        rows = staged(rows.withColumn("_seq", F.struct(F.lit(1).alias("n"), *[own(c).alias(f"a{i}") for i, c in enumerate(arrival)], F.monotonically_increasing_id().alias("id"))), "batch")
        place = rows.schema["_seq"].dataType
        kind = schema[self.fromatt].dataType if self.fromatt else rows.schema["_from"].dataType
        to_kind = schema[self.toatt].dataType if self.toatt else rows.schema["_to"].dataType
        maxto = F.lit(self.maxto).cast(to_kind)
        batch = rows.select(
            own("_seq"),
            *[(typed(a, own(mapped(a, names))) if a in here else F.lit(None).cast(schema[a].dataType)).alias(a) for a in self.attributes],
            own("_from").cast(kind).alias("_from"),
            own("_to").cast(to_kind).alias("_to"),
            own("_src").cast(kind).alias("_src"),
            F.lit(None).cast(schema[self.key].dataType).alias("_key"),
            F.lit(None).cast("bigint").alias("_version"),
        )
        # each member's newest version stands before the batch
        newest = self.table.join(prefixed(self._current(), "_c_"), own(self.key) == own(f"_c_{self.key}"), "left_semi")
        touched = newest.join(prefixed(batch.select(*self.lookupatts).distinct(), "_b_"), same([(own(a), own(f"_b_{a}")) for a in self.lookupatts], self.null_safe), "left_semi")
        before = touched.select(
            F.struct(F.lit(0).alias("n"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in place.fields[1:-1]], F.lit(0).cast("bigint").alias("id")).alias("_seq"),
            *[own(a) for a in self.attributes],
            F.lit(None).cast(kind).alias("_from"),
            F.lit(None).cast(to_kind).alias("_to"),
            F.lit(None).cast(kind).alias("_src"),
            own(self.key).alias("_key"),
            (own(self.versionatt).cast("bigint") if self.versionatt else F.lit(0).cast("bigint")).alias("_version"),
        )
        # in order of member and arrival, dealt to ranges: a member of very many rows spreads over several tasks
        order = [*self.lookupatts, "_seq"]
        both = ranged(before.unionByName(batch), order)
        members = [own(a) for a in self.lookupatts]
        absent = lambda a: a not in here
        if self.minfrom is not None:
            start = F.lit(self.minfrom[0] if isinstance(self.minfrom, tuple) else self.minfrom).cast(kind)
        else:
            start = own("_from")
        given_from = own(self.fromatt) if self.fromatt and self.fromatt in here else None
        given_to = own(self.toatt) if self.toatt and self.toatt in here else None
        new_from = F.coalesce(given_from, start) if given_from is not None else start
        new_to = F.coalesce(given_to, maxto) if given_to is not None else maxto
        valid = lambda first: {
            "_eff": F.when(own("_key").isNotNull(), own(self.fromatt) if self.fromatt else F.lit(None)).when(first, new_from).otherwise(own("_from")).cast(kind),
            "_own": F.when(own("_key").isNotNull(), own(self.toatt) if self.toatt else F.lit(None)).when(first, new_to).otherwise(maxto).cast(to_kind),
        }
        told = lambda: F.struct(*members, *[own(a) for a in self.type2atts], own("_eff"), own("_own"))
        # the last row of each range, with what it says as a version, goes before the first row of the next range
        lasts = staged(last_rows(both), "lasts")
        numbers = sorted(r[0] for r in lasts.select(RANGE).collect())
        if len(numbers) > 1:
            mine = same([(own(a), own(f"_e_{a}")) for a in self.lookupatts]) & (F.col(RANGE) == F.col("_e_r"))
            here_of = both.join(F.broadcast(prefixed(lasts.select(*self.lookupatts, F.col(RANGE).alias("r")), "_e_")), mine, "left_semi").groupBy(F.col(RANGE).alias("_e_range")).agg(F.count(F.lit(1)).alias("_rows"))
            counted = lasts.join(F.broadcast(here_of), F.col(RANGE) == F.col("_e_range")).drop("_e_range")
            alone = (F.col("_rows") == 1) & (F.row_number().over(Window.partitionBy(*members).orderBy(RANGE)) == 1)
            ends = follows(numbers, counted.withColumn("_alone", alone), "_this").withColumns(valid(F.col("_alone"))).select("_this", told().alias("_last_row"))
            both = both.join(F.broadcast(ends), (F.col(RANGE) == F.col("_this")) & (F.col(PLACE) == 0), "left").drop("_this")
            both = both.withColumn("_last_row", F.when(same([(own(a), F.col("_last_row")[a]) for a in self.lookupatts]), F.col("_last_row")))
        else:
            both = both.withColumn("_last_row", F.lit(None).cast(both.withColumns(valid(F.lit(True))).select(told().alias("r")).schema["r"].dataType))
        # within a range and member: all windows share one exchange and one sort
        window = Window.partitionBy(RANGE, *members).orderBy(PLACE)
        first = F.lag(F.lit(True)).over(window).isNull() & F.col("_last_row").isNull()
        both = both.withColumn("_first", first).withColumns(valid(own("_first")))
        both = both.withColumn("_p", F.coalesce(F.lag(told()).over(window), F.col("_last_row")))
        lag = lambda c: F.col("_p")[c]
        changed = F.lit(False)
        for a in self.type2atts:
            if not absent(a):
                changed = changed | differs(own(a), lag(a))
        if self.srcdateatt and self.fromatt and self.fromatt != self.orderingatt:
            changed = changed | differs(own("_src"), lag("_eff"))
        if self.toatt and self.toatt != self.orderingatt:
            changed = changed | differs(lag("_own"), maxto)
        # a row that begins a version is one step; the newest known version says where numbers go on
        both = both.withColumn("_new", own("_key").isNull() & (own("_first") | changed))
        both = both.withColumn("_step", F.when(own("_key").isNotNull(), F.coalesce(own("_version"), F.lit(0))).otherwise(own("_new").cast("bigint"))).drop("_p", "_last_row", "_first", "_src", "_version")
        inside = staged(within(both, self.lookupatts, "_step", "_part"), "versions")
        both = carried(inside, inside, self.lookupatts, "_step", "_part", "_grp")
        # one row for each version that the batch made or met: the row that begins it
        keep = [a for a in self.attributes if a not in self.lookupatts]
        last = [a for a in self.type1newest if not absent(a)]
        if last:
            where = F.shiftleft(F.col(RANGE).cast("bigint"), BITS) + F.col(PLACE)
            one = F.min_by(F.struct(*[own(a) for a in keep if a not in last], *[own(c) for c in ("_seq", "_key", "_eff", "_own")]), where)
            versions = both.groupBy(*members, own("_grp")).agg(one.alias("_one"), F.max_by(F.struct(*[own(a) for a in last]), where).alias("_newest"))
            versions = versions.select(*members, own("_grp"), "_one.*", "_newest.*")
        else:
            versions = both.where(own("_new") | own("_key").isNotNull()).select(*members, own("_grp"), *[own(a) for a in keep], *[own(c) for c in ("_seq", "_key", "_eff", "_own")])
        # and it closes the one before it
        starts = both.where("_new").select(*[own(a).alias(f"_n_{a}") for a in self.lookupatts], (own("_grp") - 1).alias("_n_grp"), own("_to").alias("_next"), F.lit(True).alias("_n_is"))
        versions = versions.join(starts, same([(own(a), own(f"_n_{a}")) for a in self.lookupatts]) & (own("_grp") == own("_n_grp")), "left")
        versions = versions.withColumn("_isnext", F.coalesce(own("_n_is"), F.lit(False)))
        end = F.when(differs(own("_own"), maxto), own("_own")).when(own("_isnext"), own("_next")).otherwise(maxto)
        out = {}
        for a in keep:
            value = own(a)
            if absent(a) and a not in (self.versionatt, self.fromatt, self.toatt):
                value = F.when(own("_key").isNotNull(), own(a))
            if a in self.type1everywhere and not absent(a):
                continue
            out[a] = value
        made = versions.withColumns(out)
        made = made.withColumns({c: v for c, v in (
            (self.versionatt, typed(self.versionatt, own("_grp")) if self.versionatt else None),
            (self.fromatt, own("_eff") if self.fromatt else None),
            (self.toatt, end if self.toatt else None),
        ) if c})
        fresh = made.where(own("_key").isNull()).drop(self.key)
        if self.idfinder is not None:
            fresh = staged(fresh.withColumn("_key", self.idfinder(fresh)))
        else:
            fresh = numbered(fresh.drop("_key"), [own("_seq")], "_key", highest(self.table, self.key))
        known = made.where(own("_key").isNotNull())
        changed_rows = staged(fresh.unionByName(known, allowMissingColumns=True), "changed")
        # type 1 attributes: the last value, in all versions of the member
        everywhere = [a for a in self.type1everywhere if not absent(a)]
        if everywhere:
            last = batch.groupBy(*[own(a) for a in self.lookupatts]).agg(*[F.max_by(own(a), own("_seq")).alias(f"_l_{a}") for a in everywhere], F.lit(True).alias("_hit"))
            last = last.select(*[own(a).alias(f"_m_{a}") for a in self.lookupatts], *[own(f"_l_{a}") for a in everywhere], own("_hit"))
        shape = changed_rows.select(*[(own("_key") if c == self.key else own(c)).cast(schema[c].dataType).alias(c) for c in self.table.columns])
        old = self.table.join(prefixed(known.select(own("_key").alias(self.key)), "_k_"), own(self.key) == own(f"_k_{self.key}"), "left_anti")
        table = old.unionByName(shape)
        if everywhere:
            met = table.join(last, same([(own(a), own(f"_m_{a}")) for a in self.lookupatts], self.null_safe), "left")
            hit = F.coalesce(own("_hit"), F.lit(False))
            table = met.select(*[(F.when(hit, own(f"_l_{c}")).otherwise(own(c)).cast(schema[c].dataType).alias(c) if c in everywhere else own(c)) for c in self.table.columns])
        self.table = table
        # back to the rows
        told = [a for a in (self.versionatt, self.fromatt, self.toatt) if a]
        found = both.where(F.col("_seq.n") == 1).select(own("_seq"), *[own(a).alias(f"_g_{a}") for a in self.lookupatts], own("_grp").alias("_g_grp"))
        led = changed_rows.select(*[own(a).alias(f"_v_{a}") for a in self.lookupatts], own("_grp").alias("_v_grp"), own("_key").alias("_v_key"), *[own(a).alias(f"_v__{a}") for a in told])
        link = found.join(led, same([(own(f"_g_{a}"), own(f"_v_{a}")) for a in self.lookupatts], True) & (own("_g_grp") == own("_v_grp"))).select(own("_seq").alias("_l_seq"), own("_v_key").cast(schema[self.key].dataType).alias("_l_key"), *[own(f"_v__{a}") for a in told])
        result = rows.join(link, own("_seq") == own("_l_seq"))
        extra = {mapped(a, names): own(f"_v__{a}") for a in told}
        plain = [c for c in df.columns if c != into and c not in extra]
        return result.select(*[own(c) for c in plain], *[v.alias(c) for c, v in extra.items()], own("_l_key").alias(into))

    def closecurrent(self, df: DataFrame, namemapping: Mapped = None, end: Any = None) -> DataFrame:
        """Set the to-date of the newest version of each named member, if it is open.  Unknown members raise."""
        if not self.toatt:
            raise RuntimeError("there is no toatt")
        asked = df.select(*[own(mapped(a, namemapping)).alias(f"_q_{a}") for a in self.lookupatts]).distinct()
        members = self._current()
        if not asked.join(members, same([(own(f"_q_{a}"), own(a)) for a in self.lookupatts], self.null_safe), "left_anti").isEmpty():
            raise RuntimeError("an unknown member cannot be closed")
        chosen = members.join(asked, same([(own(a), own(f"_q_{a}")) for a in self.lookupatts], self.null_safe), "left_semi").select(own(self.key).alias("_q_key"))
        kind = self.table.schema[self.toatt].dataType
        stop = (today() if end is None else end if isinstance(end, Column) else F.lit(end)).cast(kind)
        met = self.table.join(chosen, own(self.key) == own("_q_key"), "left")
        close = own("_q_key").isNotNull() & own(self.toatt).eqNullSafe(F.lit(self.maxto).cast(kind))
        self.table = met.select(*[(F.when(close, stop).otherwise(own(c)).alias(c) if c == self.toatt else own(c)) for c in self.table.columns])
        return self.table

    def _asof(self, df: DataFrame, when: str | Column, inclusive: bool | tuple[bool, bool], namemapping: Mapped, wanted: Sequence[str]) -> DataFrame:
        """df with `_v`, the version valid at `when` (its key as k, and the attributes wanted), or null.

        By to-dates, the version is the member's first one, in order, that ends after `when`; the first that does also has
        the first running maximum of to-dates after it, so versions below an earlier maximum never count.  By
        from-dates alone it is the newest one that has begun, and running minima from the newest on tell it alike.
        What is left rises with time: rows and versions stand in one order of member and time, dealt to ranges, and
        each row takes the version next to it.  No task sees all rows or versions of a member.
        """
        if not self.fromatt and not self.toatt:
            raise RuntimeError("neither fromatt nor toatt is known")
        by_to = bool(self.toatt)
        if isinstance(inclusive, tuple):
            from_in, to_in = inclusive
        elif by_to and self.fromatt:
            from_in, to_in = (True, False) if inclusive else (False, False)
        else:
            from_in = to_in = bool(inclusive)
        if self.fromatt and self.toatt and not from_in and not to_in:
            raise ValueError("one end must be inclusive")
        kind = self.table.schema[self.toatt or self.fromatt].dataType
        end = own(self.toatt if by_to else self.fromatt)
        # an end that is not set lies beyond all others, or before all; a moment that is null meets such ends alone
        time = lambda value, null, other: F.struct(F.when(value.isNull(), null).otherwise(other).alias("o"), value.alias("t"))
        beyond, plain = (2, 0) if by_to else (0, 2)
        atts = [f"_m{i}" for i in range(len(self.lookupatts))]
        at = own(self.orderingatt)
        null = at.isNull() if by_to else at.isNotNull()  # nulls last when ascending by to, and when descending by from
        newest = F.struct(null.alias("n"), at.alias("a"), own(self.key).alias("k"))
        versions = self.table.select(
            *[own(a).alias(m) for a, m in zip(self.lookupatts, atts)],
            newest.alias("_at"),
            time(end, beyond, plain).alias("_time"),
            F.struct(own(self.key).alias("k"), *[own(c) for c in self.attributes if c in wanted or by_to and c == self.fromatt]).alias("_v"),
        )
        steps = ranged(versions, [*atts, "_at"], descending=[] if by_to else ["_at"])
        steps = running(steps, atts, ["_at"], "_time", "_top", how="max" if by_to else "min", descending=not by_to, before=True)
        # of versions of one running maximum the first counts: the one that lies beyond all before it
        records = steps.where(F.col("_top").isNull() | (F.col("_time") > F.col("_top") if by_to else F.col("_time") < F.col("_top"))).select(*atts, "_time", "_v")
        moment = own(when) if isinstance(when, str) else when
        inside = to_in if by_to else from_in
        # what a row is placed by is not sent twice
        kept = {mapped(a, namemapping): m for a, m in zip(self.lookupatts, atts)}
        if isinstance(when, str) and df.schema[when].dataType == kind:
            kept.setdefault(when, "_time.t")
        asked = df.select(
            *[own(mapped(a, namemapping)).alias(m) for a, m in zip(self.lookupatts, atts)],
            time(moment.cast(kind), 1, plain).alias("_time"),
            F.struct(*[own(c) for c in df.columns if c not in kept], F.lit(True).alias("_is")).alias("_row"),
        )
        # by to-dates in falling order of time, else in rising order, the version of a row is the last one before it: at the same time, if that end is inclusive
        both = asked.select(*atts, "_time", F.lit(1 if inside else 0).alias("_late"), "_row", F.lit(None).cast(records.schema["_v"].dataType).alias("_v"))
        both = both.unionByName(records.select(*atts, "_time", F.lit(0 if inside else 1).alias("_late"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_v"))
        falls = ["_time"] if by_to else []
        both = ranged(both, [*atts, "_time", "_late"], descending=falls)
        met = running(both, atts, ["_time", "_late"], "_v", "_v", how="last", descending=falls).where("_row is not null")
        known = F.lit(True) if self.null_safe else reduce(Column.__and__, [F.col(m).isNotNull() for m in atts])
        met = met.select(*[(F.col(kept[c]) if c in kept else F.col("_row")[c]).alias(c) for c in df.columns], F.col("_time.t").alias("_when"), F.when(known, F.col("_v")).alias("_v"))
        if by_to and self.fromatt:  # the version is picked by its end and then must have begun
            begun = F.col("_v")[self.fromatt]
            ok = begun.isNull() | ((begun <= own("_when")) if from_in else (begun < own("_when")))
            met = met.withColumn("_v", F.when(ok, F.col("_v")))
        return met.drop("_when")

    def lookupasof(self, df: DataFrame, when: str | Column, inclusive: bool | tuple[bool, bool] = True, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """The rows with the key of the version valid at `when` (a column), null where there is none."""
        into = into or mapped(self.key, namemapping)
        out = self._asof(df.drop(into), when, inclusive, namemapping, ())
        return out.withColumn(into, F.col("_v")["k"]).drop("_v")

    def lookuprowasof(self, df: DataFrame, when: str | Column, inclusive: bool | tuple[bool, bool] = True, namemapping: Mapped = None) -> DataFrame:
        """The whole version valid at `when` for each row, all nulls where there is none."""
        out = self._asof(df, when, inclusive, namemapping, self.attributes)
        return out.select(F.col("_v")["k"].alias(self.key), *[F.col("_v")[c].alias(c) for c in self.attributes])

    def getversions(self, values: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """All versions of the named members, oldest first."""
        found = self.getbyvals(values.select(*[own(mapped(a, namemapping)).alias(a) for a in self.lookupatts]))
        at = own(self.orderingatt)
        return found.orderBy(*self.lookupatts, at.asc_nulls_last() if self.orderingatt == self.toatt else at.asc_nulls_first())


SCDimension = SlowlyChangingDimension
