"""Further registered queries: sources, steps, loads and the warehouse, each with its SQL; `plans.queries` adds them."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from loomhouse.functions import aggregators as A
from loomhouse.functions import rows as R
from loomhouse.functions import scalars as S
from loomhouse.functions.fifo import FIFODict
from loomhouse.operators.dimension import CachedBulkDimension, Dimension
from loomhouse.operators.facts import AccumulatingSnapshotFactTable, BulkFactTable, DecoupledDimension, FactTable, SubprocessFactTable
from loomhouse.operators.keys import getsharedsequencefactory
from loomhouse.operators.partitioning import BasePartitioner, DimensionPartitioner, FactTablePartitioner
from loomhouse.operators.scd import SlowlyChangingDimension
from loomhouse.operators.snowflake import SnowflakedDimension
from loomhouse.plans import flow as W
from loomhouse.plans import steps as P
from loomhouse.plans.queries import ENSURE_SQL, LINES_SQL, PLACES_SQL, SCD2_SQL, _brands, _customers, _history, _lines, _places, _sales, cents, empty, query, t
from loomhouse.plans.store import Error, JdbcWarehouse, Warehouse, definequote, getdefaulttargetconnection, quoted, shared_dir
from loomhouse.sources import readers as I
from loomhouse.sources import transforming as X
from loomhouse.streaming.loads import stream_load
from loomhouse.testkit import Table
from loomhouse.testkit.drawn import align
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def house(spark: SparkSession) -> Warehouse:
    """A warehouse of its own; the default one stays what it was."""
    before = getdefaulttargetconnection()
    out = Warehouse(spark, folder(spark, "house"))
    if before is None:
        out.close()
    return out


# ---------------------------------------------------------------- sources


def _csv(spark: SparkSession, df: DataFrame) -> str:
    path = folder(spark, "csv")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("select cast(c_custkey as varchar) as c_custkey, 'a \"' || c_name || '\", b' as name, case when c_nationkey > 9 then c_mktsegment else '-' end as segment from customer")
def csv_source(spark, sf_dir):
    """Quotes and separators within fields, and empty fields."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('a "'), "c_name", F.lit('", b')).alias("name"), F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment")).alias("segment"))
    return I.csvsource(spark, _csv(spark, c), restval="-")


@query("select o_orderkey, cast(o_orderdate as date) as day, cast(round(o_totalprice) as integer) as price, o_orderstatus = 'F' as done, lower(o_orderpriority) as priority from orders")
def typed_csv_source(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice").cast("int").alias("price"), F.col("o_orderstatus").alias("done"), F.col("o_orderpriority").alias("priority"))
    return I.typedcsvsource(spark, _csv(spark, o), {"o_orderkey": "bigint", "day": "date", "price": "int", "done": lambda c: c == "F", "priority": F.lower})


@query("select n_nationkey, n_name, n_regionkey from nation")
def pandas_source(spark, sf_dir):
    return I.pandassource(spark, t(spark, sf_dir, "nation").toPandas()).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("select cast(r_regionkey as bigint) as a, r_name as b from region")
def row_factory(spark, sf_dir):
    return I.rowfactory(spark, iter([tuple(r) for r in t(spark, sf_dir, "region").collect()]), ["a", "b"])


@query("select p_partkey, p_brand from part")
def process_source(spark, sf_dir):
    return I.processsource(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), batchsize=100)


@query("select s_suppkey, s_name from supplier where s_nationkey >= 12")
def jdbc_source(spark, sf_dir):
    """Suppliers written to an embedded database by JDBC, and read in ranges and by a query."""
    base = JdbcWarehouse(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    some = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ID"), F.col("s_name").cast("varchar(50)").alias("NAME"), F.col("s_nationkey").alias("NATION"))
    base.write("SUPPLIERS", some, mode="overwrite")
    split = base.read("SUPPLIERS", column="ID", lower=1, upper=1000, parts=4).where("NATION >= 18")
    asked = base.query('select "ID", "NAME", "NATION" from SUPPLIERS where "NATION" >= 12 and "NATION" < 18')
    return split.unionByName(asked).select(F.col("ID").alias("s_suppkey"), F.col("NAME").alias("s_name"))


# ---------------------------------------------------------------- rows and scalars


@query("select n_nationkey as k, n_name as name, n_regionkey as other, 'none' as absent from nation")
def get_value(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.select(R.getvalue("k", {"k": "n_nationkey"}).alias("k"), R.getvalue("n_name").alias("name"), R.getvalueor(n, "r", {"r": "n_regionkey"}).alias("other"), R.getvalueor(n, "x", default="none").alias("absent"))


@query("""select o_orderkey, coalesce(case when o_orderstatus = 'F' then cast(o_orderkey as varchar) end, 'None') as text,
  coalesce(case when o_orderstatus = 'F' then cast(o_orderkey as varchar) end, '?') as other, o_orderpriority as kept,
  cast(o_orderdate as timestamp) as moment, cast(o_orderdate as date) as day, cast(o_orderdate as timestamp) as read_moment from orders""")
def get_text_and_time(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    some = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    o = o.withColumns({"at": F.concat(F.lit("'"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("'")), "on": F.date_format("o_orderdate", "yyyy-MM-dd")})
    return o.select("o_orderkey", S.getstr(some).alias("text"), S.getstr(some, "?").alias("other"), S.keepasis("o_orderpriority").alias("kept"), S.ymdhmsparser("at").alias("moment"), S.datereader("day")({"day": "on"}).alias("day"), S.datetimereader("when")({"when": "at"}).alias("read_moment"))


@query("select r_regionkey, true as one_day, true as one_time, '\"a b\"' as quoted, '`a b`' as plain from region")
def today_and_now(spark, sf_dir):
    """The same day and moment in every row and use of a load; identifiers in quotes that are set."""
    definequote('"')
    double = quoted("a b")
    definequote("`")
    r = t(spark, sf_dir, "region")
    first = r.select("r_regionkey", S.today().alias("d"), S.now().alias("m"))
    return first.select("r_regionkey", (F.col("d") == S.today()).alias("one_day"), (F.col("m") == S.now()).alias("one_time"), F.lit(double).alias("quoted"), F.lit(quoted("a b")).alias("plain"))


@query("""select p_brand, coalesce(cast(sum(case when p_size > 48 then p_size end) as bigint), -1) as big, max(p_size) - min(p_size) as spread from part group by 1""")
def agg_default_and_own(spark, sf_dir):
    big = A.Sum().finish(F.when(F.col("p_size") > 48, F.col("p_size")), -1)
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(big.alias("big"), A.Own(lambda c: F.max(c) - F.min(c)).finish(F.col("p_size")).alias("spread"))


@query("select k, k * 10 as v from (select range as k from range(2, 5))")
def fifo_dict(spark, sf_dir):
    """The last three of five, in the order in which they came."""
    held = FIFODict(3)
    for k in range(5):
        held.add(k, k * 10)
    return spark.createDataFrame([(k, held[k]) for k in held], "k bigint, v bigint")


# ---------------------------------------------------------------- dimensions


@query("select o_orderkey, c_custkey, c_name, c_mktsegment, c_nationkey from orders left join customer on c_custkey = o_custkey and o_orderkey % 7 <> 0")
def dim_lookuprow(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    asked = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("nobody")).otherwise(F.col("c_name")).alias("who"))
    found = _customers(spark, sf_dir).lookuprow(asked.select("who").distinct(), {"c_name": "who"})
    met = asked.join(found, F.col("who") == F.col("c_name"), "left")
    return met.select("o_orderkey", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")


@query(f"""with d as ({ENSURE_SQL}) select id, p_brand, p_type from d""")
def cached_bulk_dimension(spark, sf_dir):
    seen: list[str] = []
    brand = _brands(spark, CachedBulkDimension, bulkloader=lambda *a: seen.append(a[-1]), nullsubst="")
    part = t(spark, sf_dir, "part")
    brand.ensure(part.where("p_size < 20"))
    brand.ensure(part)
    brand.endload()
    again = _brands(spark)
    again.ensure(part)
    loaded = spark.read.option("sep", "\t").schema("id bigint, p_brand string, p_type string").csv(seen).select("p_brand", "p_type")
    return again.table.join(loaded, ["p_brand", "p_type"]).select("id", "p_brand", "p_type")


@query(f"with h as ({SCD2_SQL} from v) select c_custkey, version from customer left join h on c_custkey = o_custkey and todate is null")
def scd2_lookup(spark, sf_dir):
    """The newest version of every customer's history, null for those without one; the order may be left to the table."""
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    found = history.lookup(t(spark, sf_dir, "customer").select("c_custkey"), {"o_custkey": "c_custkey"}, into="key")
    return found.join(history.table.selectExpr("id", "version"), F.col("key") == F.col("id"), "left").select("c_custkey", "version")


@query(f"""with h as ({SCD2_SQL} from v), r as (select o_custkey, max(o_orderdate) as last, min(o_orderdate) as first from orders group by 1),
m as (select o_custkey, cast(first as date) + cast(date_diff('day', cast(first as date), cast(last as date)) // 2 as integer) as mid from r)
select h.o_custkey, h.version, h.o_orderpriority, h.fromdate, h.todate from m join h on h.o_custkey = m.o_custkey and fromdate <= mid
  and version = (select min(i.version) from h i where i.o_custkey = m.o_custkey and (i.todate is null or i.todate > mid))""")
def scd2_lookuprowasof(spark, sf_dir):
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    asked = ends.select("o_custkey", F.date_add(F.col("first").cast("date"), F.floor(F.datediff("last", "first") / 2).cast("int")).alias("mid"))
    return history.lookuprowasof(asked, "mid", (True, False)).where("id is not null").select("o_custkey", "version", "o_orderpriority", "fromdate", "todate")


@query(f"with h as ({SCD2_SQL} from v) select h.* from h where o_custkey % 10 = 3")
def scd2_getversions(spark, sf_dir):
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    return history.getversions(orders.where("o_custkey % 10 = 3").select("o_custkey").distinct()).drop("id")


@query(f"""{SCD2_SQL}, last_in as o_orderstatus from v
  join (select o_custkey, version, max_by(o_orderstatus, struct_pack(d := d, k := o_orderkey)) as last_in from g group by 1, 2) using (o_custkey, version)""")
def scd2_type1_newest(spark, sf_dir):
    """A type 1 attribute that is overwritten in the newest version alone: each version keeps its last value."""
    history, orders = _history(spark, sf_dir, type1=[("o_orderstatus", False)], status=True)
    history.scdensure(orders)
    return history.table.drop("id")


@query(f"with d as ({ENSURE_SQL}) select p_partkey, d.id from part left join d on part.p_brand = d.p_brand and part.p_type = d.p_type and part.p_size > 9")
def partition_lookup(spark, sf_dir):
    """A partitioned dimension's members are found again in the part that has them."""
    parts = DimensionPartitioner([_brands(spark) for _ in range(3)])
    one = _brands(spark)
    part = t(spark, sf_dir, "part")
    parts.ensure(part)
    one.ensure(part)
    asked = part.withColumn("p_type", F.when(F.col("p_size") > 9, F.col("p_type")))
    found = parts.lookup(asked.select("p_partkey", "p_brand", "p_type"), into="there").where("there is not null")
    keys = one.lookup(found.select("p_partkey", "p_brand", "p_type"), into="id")
    return asked.select(F.col("p_partkey").alias("k")).join(keys.select("p_partkey", "id"), F.col("k") == F.col("p_partkey"), "left").select(F.col("k").alias("p_partkey"), "id")


@query("select n_nationkey, n_name, n_nationkey % 2 = 1 as odd from nation")
def base_partitioner(spark, sf_dir):
    """Parts by any Column of whole numbers, which a partitioner of its own gives."""

    class ByKey(BasePartitioner):
        def part(self, df, namemapping=None):
            return F.col("n_nationkey") % F.lit(len(self.parts))

    parts = ByKey([0, 1, 2])
    parts.droppart(2)
    return parts.getpart(t(spark, sf_dir, "nation"), into="part").select("n_nationkey", "n_name", (F.col("part") == 1).alias("odd"))


# ---------------------------------------------------------------- snowflakes


@query(PLACES_SQL.format("supplierid, s_name, nationid, n_name, regionid, r_name") + " where s_suppkey % 5 = 0")
def snowflake_getbykey(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    keyed = places.ensure(flow)
    return places.getbykey(keyed.where("s_suppkey % 5 = 0").select("supplierid"), fullrow=True)


@query(PLACES_SQL.format("s_suppkey, supplierid, s_name, nationid") + " where n_name <> 'CHINA'")
def snowflake_lookuprow(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    places.ensure(flow)
    rows = flow.where("n_name <> 'CHINA'")
    found = places.lookuprow(rows)
    return rows.select("s_suppkey", F.col("s_name").alias("n")).join(found, F.col("n") == F.col("s_name")).select("s_suppkey", "supplierid", "s_name", "nationid")


@query(PLACES_SQL.format("supplierid, s_name, nationid, n_name, regionid, case when r_name = 'ASIA' then 'East' else r_name end as r_name"))
def snowflake_update(spark, sf_dir):
    """A change of a member two levels up is seen in all rows below it."""
    places, flow = _places(spark, sf_dir)
    places.ensure(flow)
    asia = places.levels[-1].table.where("r_name = 'ASIA'").select("regionid", F.lit("East").alias("r_name"), F.lit(0).alias("s_suppkey"))
    places.update(asia)
    return places.table


@query(PLACES_SQL.format("s_suppkey, supplierid, nationid, regionid, false as refused") + " union all select cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), true")
def snowflake_insert(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    keyed = places.insert(flow)
    refused = False
    try:
        places.insert(flow)
    except ValueError:
        refused = True
    whole = places.table.select(F.col("supplierid").alias("k"), "nationid", "regionid")
    told = keyed.join(whole, F.col("supplierid") == F.col("k")).select("s_suppkey", "supplierid", "nationid", "regionid", F.lit(False).alias("refused"))
    return told.unionByName(spark.createDataFrame([(None, None, None, None, refused)], "s_suppkey bigint, supplierid bigint, nationid bigint, regionid bigint, refused boolean"))


@query("""with r as (select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey),
v as (select c_custkey, n_name, 1 as version, date '2020-01-01' as fromdate, case when c_custkey % 3 = 0 then date '2021-01-01' end as todate from r
  union all select c_custkey, n_name, 2, date '2021-01-01', null from r where c_custkey % 3 = 0)
select c_custkey, n_name, version, fromdate, todate, case when version = 2 then 'moved' else 'home' end as kind from v""")
def snowflake_scdensure(spark, sf_dir):
    """A root with versions above a plain level: one in three customers changes."""
    nation = Dimension("nation", "nationid", ["n_name"], table=empty(spark, "nationid bigint, n_name string"), order_by=["c_custkey"])
    root = SlowlyChangingDimension("customer", "id", ["c_custkey", "kind", "nationid", "version", "fromdate", "todate"], ["c_custkey"], versionatt="version", fromatt="fromdate", toatt="todate", fromfinder=lambda names: F.col("day"), table=empty(spark, "id bigint, c_custkey bigint, kind string, nationid bigint, version int, fromdate date, todate date"), order_by=["c_custkey"])
    places = SnowflakedDimension([(root, nation)])
    rows = X.hashjoin(t(spark, sf_dir, "customer"), "c_nationkey", t(spark, sf_dir, "nation"), "n_nationkey").select("c_custkey", "n_name", F.lit("home").alias("kind"), F.lit(datetime.date(2020, 1, 1)).alias("day"))
    places.scdensure(rows)
    places.scdensure(rows.where("c_custkey % 3 = 0").withColumns({"kind": F.lit("moved"), "day": F.lit(datetime.date(2021, 1, 1))}))
    return places.table.select("c_custkey", "n_name", "version", "fromdate", "todate", "kind")


# ---------------------------------------------------------------- facts


@query("""with o as (select o_custkey, min(o_orderdate) as first, max(o_orderdate) as last, count(*) as n from orders group by 1)
select o_custkey, cast(first as date) as first, case when n > 1 then cast(last as date) end as last from o""")
def acc_snapshot_update(spark, sf_dir):
    """Facts that the first order inserts and the last one fills in; an absent fact is refused."""
    orders = t(spark, sf_dir, "orders")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"), F.count(F.lit(1)).alias("n"))
    facts = AccumulatingSnapshotFactTable("span", ["o_custkey"], ["first", "last"], table=empty(spark, "o_custkey bigint, first date, last date"), order_by=["o_custkey"])
    facts.ensure(ends.select("o_custkey", "first"))
    facts.update(ends.where("n > 1").select("o_custkey", "last"))
    try:
        facts.update(spark.createDataFrame([(-1, None)], "o_custkey bigint, last date"))
    except KeyError:
        return facts.table
    raise AssertionError("an absent fact was updated")


@query(LINES_SQL + " where l_orderkey % 2 = 0 union all select cast(null as bigint), cast(null as integer), cast(null as bigint), cast(null as bigint) where false")
def fact_compare_refuses(spark, sf_dir):
    """With compare, the same measures are let through and others are refused."""
    facts = _sales(spark)
    lines = _lines(spark, sf_dir).where("l_orderkey % 2 = 0")
    facts.insert(lines)
    single = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("l_partkey"), F.min("price").alias("price")).where("n = 1").drop("n")
    facts.ensure(single, compare=True)
    try:
        facts.ensure(single.withColumn("price", F.col("price") + 1), compare=True)
    except ValueError:
        return facts.table
    raise AssertionError("another measure was let through")


@query("select n_nationkey, n_name, coalesce(nullif(n_regionkey, 1), 1) as n_regionkey from nation")
def subprocess_facts(spark, sf_dir):
    """Rows piped to a command, one process for each task, and read again from what it wrote."""
    path = folder(spark, "piped").removeprefix("file:")
    facts = SubprocessFactTable(["n_nationkey"], ["n_name", "n_regionkey"], f"mkdir -p {path} && cat > {path}/$$.txt", fieldsep="|")
    facts.insert(t(spark, sf_dir, "nation").repartition(3))
    return spark.read.option("sep", "|").schema("n_nationkey int, n_name string, n_regionkey int").csv(path)


@query(f"with d as ({ENSURE_SQL}) select p_partkey, id from part left join d using (p_brand, p_type)")
def decoupled_dimension(spark, sf_dir):
    brand = DecoupledDimension(_brands(spark))
    return brand.ensure(t(spark, sf_dir, "part")).select("p_partkey", "id")


@query("select s_suppkey, upper(s_name) as s_name, case when s_acctbal > 0 then 1 else 0 end as positive from supplier")
def bulk_converted(spark, sf_dir):
    """Attributes converted by a function of their own on the way to the loader's files."""
    seen: list[str] = []
    facts = BulkFactTable("supplier", ["s_suppkey"], ["s_name", "positive"], bulkloader=lambda *a: seen.append(a[-1]), nullsubst="", strconverter=lambda c: F.upper(c.cast("string")), table=empty(spark, "s_suppkey bigint, s_name string, positive int"))
    facts.insert(t(spark, sf_dir, "supplier").withColumn("positive", (F.col("s_acctbal") > 0).cast("int")))
    facts.endload()
    return spark.read.option("sep", "\t").schema("s_suppkey bigint, s_name string, positive int").csv(seen)


@query(LINES_SQL + " where l_linenumber = 2")
def partition_fact_lookup(spark, sf_dir):
    """A fact of each key, found in the part that has it."""
    parts = FactTablePartitioner([_sales(spark) for _ in range(3)])
    lines = _lines(spark, sf_dir).where("l_linenumber = 2")
    parts.insert(lines)
    return parts.lookup(lines.select("l_orderkey", "l_linenumber").distinct())


# ---------------------------------------------------------------- steps and flows


@query("""with g as (select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (order by event_id rows between unbounded preceding and 1 preceding), 0) as grp from events),
r as (select grp, sum(event_id) as total, avg(event_id) as mean, min(event_id) as low from g where event_type <> 'purchase' group by 1)
select g.event_id, cast(coalesce(r.total, 0) as bigint) as total, coalesce(r.mean, 0) as mean, r.low from g left join r on g.grp = r.grp where g.event_type = 'purchase'""")
def agg_step_sum_avg(spark, sf_dir):
    """One group after the other over all rows: the sum and the average of a group without rows are 0."""
    step = P.AggregatingStep({"total": P.sumaggregator("event_id"), "mean": P.avgaggregator("event_id"), "low": P.minaggregator("event_id")}, F.col("event_type") == "purchase", ["event_id"])
    source = P.SourceStep(t(spark, sf_dir, "events").select("event_id", "event_type"), step)
    source.start()
    return step.result().select("event_id", "total", "mean", "low")


@query(f"with h as ({SCD2_SQL} from v) select o_orderkey, (select max(version) from h where h.o_custkey = o.o_custkey and fromdate <= cast(o.o_orderdate as date) and o.o_orderpriority = h.o_orderpriority) is not null as found, 'kept' as way from orders o")
def step_scd_renaming(spark, sf_dir):
    """A type 2 load in a chain of steps; a garbage step ends what nobody wants."""
    history, orders = _history(spark, sf_dir)
    garbage = P.GarbageStep()
    last = P.Step(lambda d: d.select("key", F.col("version").isNotNull().alias("found"), F.lit("kept").alias("way")))
    back = P.RenamingToFromStep({"key": "o_orderkey"}, next=last)
    source = P.SourceStep(orders)
    P.connectsteps(source, P.SCDimensionStep(history, "historyid", next=P.CopyStep(back, garbage)))
    source.start()
    assert garbage.result().count() == 0
    return last.result().withColumnRenamed("key", "o_orderkey")


@query("select n_nationkey * 2 as twice, upper(n_name) as name from nation")
def split_points(spark, sf_dir):
    """Functions behind split points, their results in a list of their own; a shared warehouse is the warehouse."""
    seen: list[DataFrame] = []

    @W.splitpoint(instances=3, output=seen)
    def double(df):
        return df.select((F.col("n_nationkey") * 2).alias("twice"), "n_name")

    @W.splitpoint
    def up(df):
        return df.select("twice", F.upper("n_name").alias("name"))

    out = up(double(t(spark, sf_dir, "nation")))
    W.endsplits()
    assert len(seen) == 1 and W.shareconnectionwrapper(out) is out
    return out


@query("select count(*) as n, count(distinct c_custkey) as different, min(0) as least from (select c_custkey from customer union all select c_custkey + 1000000 from customer)")
def shared_sequence(spark, sf_dir):
    """Numbers of two users of one sequence never meet; the first begins at its start."""
    numbers = getsharedsequencefactory(0, 100)
    c = t(spark, sf_dir, "customer").select("c_custkey")
    both = numbers(c, "k").union(numbers(c, "k"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("different"), F.min("k").cast("int").alias("least"))


# ---------------------------------------------------------------- the warehouse


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey in (1, 2) and n_nationkey < 20 union all select cast(r_regionkey as integer), r_name, -1 from region where r_regionkey = 3")
def warehouse_execute(spark, sf_dir):
    """Parameters by name and by place, many statements, and rows as dicts and tuples."""
    w = house(spark)
    w.write("nation", t(spark, sf_dir, "nation"))
    w.write("region", t(spark, sf_dir, "region"))
    w.commit()
    some = w.executemany("select n_nationkey, n_name, n_regionkey from nation where n_regionkey = %(r)s and n_nationkey < %(most)s", [{"r": 1, "most": 20}, {"r": 2, "most": 20}])
    rest = w.cursor().execute("select r_regionkey, r_name, -1 from region where r_regionkey = ?", [3])
    one = w.fetchonetuple(rest)
    assert w.rowcount(rest) == 1 and w.resultnames(rest)[0] == "r_regionkey" and w.fetchone(rest)["r_name"] == one[1]
    assert [r["r_name"] for r in w.rowfactory(rest)] == [one[1]] and w.fetchalltuples(rest) == [one]
    return reduce(DataFrame.unionAll, some).unionAll(spark.createDataFrame([one], some[0].schema))


@query("select s_suppkey, s_name from supplier order by s_suppkey limit 7")
def warehouse_fetchmany(spark, sf_dir):
    w = house(spark)
    w.write("supplier", t(spark, sf_dir, "supplier"))
    return spark.createDataFrame(w.fetchmanytuples(w.execute("select s_suppkey, s_name from supplier order by s_suppkey"), 7), "s_suppkey bigint, s_name string")


@query(f"with d as ({ENSURE_SQL}) select d.id, d.p_brand, d.p_type, cast(count(*) as bigint) as n from part join d using (p_brand, p_type) group by 1, 2, 3")
def warehouse_commits(spark, sf_dir):
    """Two loads, each with a commit, and one that is rolled back; a new warehouse at the same place sees the committed state."""
    w = house(spark)
    w.write("brand", empty(spark, "id bigint, p_brand string, p_type string"))
    w.write("stock", empty(spark, "id bigint, p_partkey bigint"))
    w.commit()
    brand = Dimension("brand", "id", ["p_brand", "p_type"], order_by=["p_partkey"], targetconnection=w)
    stock = FactTable("stock", ["id", "p_partkey"], dependson=[brand], targetconnection=w)
    part = t(spark, sf_dir, "part")
    half = part.agg((F.max("p_partkey") / 2).cast("bigint")).first()[0]
    for some in (part.where(F.col("p_partkey") <= half), part.where(F.col("p_partkey") > half)):
        stock.insert(brand.ensure(some))
        w.commit()
    stock.insert(brand.ensure(part.withColumn("p_brand", F.lit("none"))))
    w.rollback()
    again = Warehouse(spark, w.root)
    out = again.execute("select b.id, b.p_brand, b.p_type, count(*) as n from stock s join brand b on s.id = b.id group by 1, 2, 3")
    again.close()
    return out


@query("select event_id, user_id from events")
def stream_micro_batches(spark, sf_dir):
    """Events come as files, one micro-batch each; facts are inserted once, though the last batch comes twice."""
    w = house(spark)
    w.write("event", empty(spark, "event_id bigint, user_id bigint"))
    w.commit()
    fact = FactTable("event", ["event_id"], ["user_id"], targetconnection=w)
    path, checkpoint = folder(spark, "stream"), folder(spark, "checkpoint")
    events = t(spark, sf_dir, "events").select("event_id", "user_id")
    events.repartitionByRange(3, "event_id").write.parquet(path)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream_load(stream(), fact.insert, w, checkpoint).awaitTermination()
    last = w.loaded(checkpoint)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
    stream_load(stream(), fact.insert, w, checkpoint).awaitTermination()
    return w.read("event")


# ---------------------------------------------------------------- the test kit


REGION = """
| r_regionkey:int (pk) | r_name:text |
| -------------------- | ----------- |
| 0                    | AFRICA      |
"""


@query("select cast(r_regionkey as integer) as r_regionkey, r_name, r_name <> 'ASIA' as stays from region union all select 77, 'NEW', true")
def drawn_tables(spark, sf_dir):
    """A table drawn and loaded, grown and changed; its state is compared with the warehouse's."""
    w = house(spark)
    rows = [r.asDict() for r in t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    head = "\n".join(REGION.strip().splitlines()[:2])
    region = Table("region", head, loadFrom=rows, testconnection=w) + "| 77 | NEW |"
    region.ensure()
    region.assertEqual(verbose=False)
    Table("region", REGION, testconnection=w).assertSubset(verbose=False)
    other = Table("region", head + "\n| 5 | NOWHERE |", testconnection=w)
    other.assertDisjoint(verbose=False)
    told = False
    try:
        other.assertEqual(verbose=False)
    except AssertionError:
        told = True
    assert told and len(region) == len(rows) + 1 and region.key() == "r_regionkey" and region.additions(withKey=True)[0]["r_regionkey"] == 77
    assert align(str(region), 1).count("\n") >= len(region) and "region" in region.getSQLToCreate() and "NEW" in region.getSQLToInsert()
    out = w.read("region").withColumn("stays", F.col("r_name") != "ASIA").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name", "stays")
    return out


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey < 4")
def drawn_variables(spark, sf_dir):
    """Keys that the warehouse gave are named by variables and must fit wherever they are used."""
    w = house(spark)
    first = t(spark, sf_dir, "nation").where("n_nationkey < 4")
    rows = first.join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    w.write("r", empty(spark, "rid bigint, r_name string"))
    w.write("n", empty(spark, "nid bigint, n_name string, rid bigint"))
    w.commit()
    r = Dimension("r", "rid", ["r_name"], order_by=["n_nationkey"], targetconnection=w)
    n = Dimension("n", "nid", ["n_name", "rid"], ["n_name"], order_by=["n_nationkey"], targetconnection=w)
    n.ensure(r.ensure(rows))
    w.commit()
    names = {x["r_name"]: k for k, x in enumerate(r.table.collect())}
    drawn = [f"| $r{names[x['r_name']]} | {x['r_name']} |" for x in r.table.collect()]
    Table("r", "| rid:bigint (pk) | r_name:text |\n| - | - |\n" + "\n".join(drawn), testconnection=w).assertEqual(verbose=False)
    lines = [f"| $_ | {x['n_name']} | $r{names[x['r_name']]} |" for x in rows.collect()]
    Table("n", "| nid:bigint (pk) | n_name:text | rid:bigint |\n| - | - | - |\n" + "\n".join(lines), testconnection=w).assertEqual(verbose=False)
    refused = 0
    try:
        w.read("absent")
    except Error:
        refused = 1
    assert refused
    return n.table.join(r.table, "rid").select("n_name", "r_name")


@query("select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as price from lineitem where l_quantity > 40 and l_discount = 0")
def as_is_pushdown(spark, sf_dir):
    """Several filters and a projection over sources, all of which reach the scan."""
    lines = X.filteringsource(X.filteringsource(t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 40), lambda d: d["l_discount"] == 0)
    return R.project(lines.withColumn("price", cents("l_extendedprice")), ["l_orderkey", "l_linenumber", "price"])


