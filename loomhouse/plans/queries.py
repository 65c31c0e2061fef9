"""The registered queries: one for each operator of the toolkit, over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from loomhouse.functions import aggregators as A
from loomhouse.functions import rows as R
from loomhouse.functions import scalars as S
from loomhouse.operators.dimension import BulkDimension, CachedDimension, Dimension, TypeOneSlowlyChangingDimension
from loomhouse.operators.facts import AccumulatingSnapshotFactTable, BatchFactTable, BulkFactTable, FactTable
from loomhouse.operators.keys import numbered
from loomhouse.operators.partitioning import DimensionPartitioner, FactTablePartitioner
from loomhouse.operators.scd import SlowlyChangingDimension
from loomhouse.operators.snowflake import SnowflakedDimension
from loomhouse.plans import flow as W
from loomhouse.plans import steps as P
from loomhouse.sources import readers as I
from loomhouse.sources import transforming as X
from loomhouse.streaming.loads import sessions, windowed
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- the flagship: a star schema and a report

REVENUE_SQL = """
select c_mktsegment as segment, cast(year(o_orderdate) as integer) as year,
  cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as revenue_cents, count(*) as n_lines
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1, 2
"""


@query(REVENUE_SQL)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensure a customer and a date dimension, insert the facts, and report revenue by segment and year."""
    orders = t(spark, sf_dir, "orders")
    customers = X.hashjoin(t(spark, sf_dir, "customer"), "c_nationkey", t(spark, sf_dir, "nation"), "n_nationkey")
    customer = Dimension("customer", "customerid", ["c_custkey", "c_name", "c_mktsegment", "n_name"], ["c_custkey"], table=empty(spark, "customerid bigint, c_custkey bigint, c_name string, c_mktsegment string, n_name string"), order_by=["c_custkey"])
    customer.ensure(customers)
    first, last = orders.agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    days = I.datespan(spark, first, last)
    dates = Dimension("date", "dateid", ["date", "monthname", "weekday", "year", "month", "day"], ["date"], table=days)
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("price"))
    flow = lines.join(orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")), F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = dates.lookup(customer.lookup(flow, {"c_custkey": "o_custkey"}))
    facts = FactTable("sales", ["customerid", "dateid"], ["price"], table=empty(spark, "customerid bigint, dateid int, price bigint"))
    facts.insert(keyed)
    report = facts.table.join(customer.table, "customerid").join(dates.table, "dateid")
    return report.groupBy(F.col("c_mktsegment").alias("segment"), "year").agg(F.sum("price").alias("revenue_cents"), F.count(F.lit(1)).alias("n_lines"))


# ---------------------------------------------------------------- scalar functions


@query("""select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
  coalesce(case when regexp_matches(event_type, '^[0-9]+$') then cast(event_type as bigint) end, -1) as no_int,
  cast(cast(value as varchar) as double) as v from events""")
def get_int_default(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", S.getint(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"), S.getint("event_type", -1).alias("no_int"), S.getfloat(F.col("value").cast("string")).alias("v"))


@query("""select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false else null end as done,
  coalesce(case o_orderstatus when 'F' then true when 'O' then false end, false) as done_or_false from orders""")
def get_bool(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.getbool("o_orderstatus", truevalues=("F",), falsevalues=("O",)).alias("done"), S.getbool("o_orderstatus", False, ("F",), ("O",)).alias("done_or_false"))


@query("""select c_custkey, trim(c_name) as name, upper(c_mktsegment) as up, lower(c_mktsegment) as low,
  '''' || replace(c_name, '''', '''''') || '''' as quoted, coalesce(cast(c_nationkey as varchar), 'None') as nation,
  cast(case when c_acctbal > 0 then '1' else '0' end as varchar) as flag from customer""")
def strip_and_quote(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("padded", F.concat(F.lit(" \t"), "c_name", F.lit(" \n"))).withColumn("positive", F.col("c_acctbal") > 0)
    return c.select("c_custkey", S.getstrippedstr("padded").alias("name"), S.toupper("c_mktsegment").alias("up"), S.tolower("c_mktsegment").alias("low"), S.getsqlfriendlystr("c_name").alias("quoted"), S.getstrornullvalue("c_nationkey").alias("nation"), S.getdbfriendlystr("positive", boolean=True).alias("flag"))


@query("""select o_orderkey, cast(o_orderdate as date) as day, cast(o_orderdate as timestamp) as moment, cast(null as date) as bad,
  cast(o_orderdate as date) as quoted from orders""")
def get_date(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-M-d")
    quoted = F.concat(F.lit("'"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'"))
    return o.select("o_orderkey", S.getdate(text).alias("day"), S.gettimestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("moment"), S.getdate("o_orderstatus").alias("bad"), S.ymdparser(quoted).alias("quoted"))


# ---------------------------------------------------------------- rows


@query("select c_custkey as id, c_name as name, c_mktsegment as segment from customer")
def project_rename(spark, sf_dir):
    return R.project(t(spark, sf_dir, "customer"), ["id", "name", "segment"], {"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"})


@query("select c_acctbal, c_nationkey, c_mktsegment, c_custkey as id, c_custkey as id2, c_name as name from customer")
def copy_rename(spark, sf_dir):
    return R.copy(t(spark, sf_dir, "customer"), id="c_custkey", id2="c_custkey", name="c_name")


@query("select n_nationkey as id, n_name as name, n_regionkey, 'unknown' as continent, cast(7 as integer) as level from nation")
def setdefaults(spark, sf_dir):
    n = R.renametofrom(R.renamefromto(t(spark, sf_dir, "nation"), {"n_nationkey": "id"}), {"name": "n_name"})
    return R.setdefaults(n, ["continent", "name", "level"], ["unknown", "x", 7])


# ---------------------------------------------------------------- sources


@query("""select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as l_extendedprice, lower(l_returnflag) as l_returnflag,
  l_shipdate from lineitem""")
def mapping_source(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    return X.mappingsource(lines, {"l_extendedprice": lambda c: F.round(c * 100).cast("bigint"), "l_returnflag": F.lower})


@query("""select p_partkey, p_brand || '/' || p_type as kind, p_size * 2 as twice from part where p_size > 10""")
def transforming_source(spark, sf_dir):
    part = X.filteringsource(t(spark, sf_dir, "part"), F.col("p_size") > 10)
    return X.transformingsource(part, lambda d: d.withColumn("kind", F.concat_ws("/", "p_brand", "p_type")), lambda d: d.withColumn("twice", F.col("p_size") * 2), lambda d: d.select("p_partkey", "kind", "twice"))


@query("select s_suppkey, length(s_name) + s_nationkey as code from supplier")
def row_transformation(spark, sf_dir):
    def change(row: dict) -> None:
        row["code"] = len(row["s_name"]) + row["s_nationkey"]

    return X.transformingsource(t(spark, sf_dir, "supplier"), X.rowtransformation(change, "s_suppkey bigint, code bigint"))


@query("select l_orderkey, l_linenumber, l_discount from lineitem where l_discount > 0.05")
def filtering_source(spark, sf_dir):
    return X.filteringsource(t(spark, sf_dir, "lineitem"), lambda d: d["l_discount"] > 0.05).select("l_orderkey", "l_linenumber", "l_discount")


JOIN_SQL = "select o_orderkey, o_custkey, c_custkey, c_name as label, c_mktsegment from orders join customer on o_custkey = c_custkey"


def _joined(spark, sf_dir, join):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    customers = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"), "c_mktsegment")
    return join(orders, "o_custkey", customers, "c_custkey")


@query(JOIN_SQL)
def hash_join(spark, sf_dir):
    return _joined(spark, sf_dir, X.hashjoin)


@query(JOIN_SQL)
def merge_join(spark, sf_dir):
    return _joined(spark, sf_dir, X.mergejoin)


@query("""select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as varchar) as segment, 0 as source from supplier
  union all select c_custkey, c_name, cast(null as double), c_mktsegment, 1 from customer""")
def union_source(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    c = t(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment")
    return X.unionsource(s, c, index="source")


@query("""select id, cast((row_number() over (partition by source order by id) - 1) // 100 as bigint) as round, source
  from (select s_suppkey as id, 0 as source from supplier union all select c_custkey, 1 from customer)""")
def round_robin(spark, sf_dir):
    s, c = t(spark, sf_dir, "supplier").selectExpr("s_suppkey id"), t(spark, sf_dir, "customer").selectExpr("c_custkey id")
    return X.roundrobinsource([s, c], 100, order_by=["id"], position="at").select("id", "at.round", "at.source")


@query("""select l_returnflag, coalesce(cast(sum(case when l_linestatus = 'F' then cast(round(l_quantity * 100) as bigint) end) as bigint), 0) as F,
  coalesce(cast(sum(case when l_linestatus = 'O' then cast(round(l_quantity * 100) as bigint) end) as bigint), 0) as O from lineitem group by 1""")
def crosstab_sum(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", cents("l_quantity").alias("q"))
    return X.crosstab(lines, "l_returnflag", "l_linestatus", "q", columns=["F", "O"])


@query("""select o_orderpriority, cast(coalesce(sum(case when o_orderstatus = 'F' then 1 end), -1) as bigint) as F,
  cast(coalesce(sum(case when o_orderstatus = 'O' then 1 end), -1) as bigint) as O, cast(coalesce(sum(case when o_orderstatus = 'P' then 1 end), -1) as bigint) as P,
  cast(-1 as bigint) as X from orders group by 1""")
def crosstab_count_nonevalue(spark, sf_dir):
    return X.crosstab(t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey", A.Count(), -1, sortrows=True, columns=["F", "O", "P", "X"])


def _aggregate(aggregator, value):
    def run(spark, sf_dir):
        return t(spark, sf_dir, "part").groupBy("p_brand").agg(aggregator.finish(value(), None).alias("value"))

    return run


for _name, _aggregator, _value, _sql in (
    ("agg_sum", A.Sum(), lambda: cents("p_retailprice"), "cast(sum(cast(round(p_retailprice * 100) as bigint)) as bigint)"),
    ("agg_count", A.Count(), lambda: F.col("p_type"), "count(*)"),
    ("agg_count_distinct", A.CountDistinct(), lambda: F.when(F.col("p_size") > 5, F.col("p_type")), "count(distinct case when p_size > 5 then p_type else 'null' end)"),
    ("agg_max", A.Max(), lambda: F.col("p_retailprice"), "max(p_retailprice)"),
    ("agg_min", A.Min(), lambda: F.col("p_name"), "min(p_name)"),
    ("agg_avg", A.Avg(), lambda: F.col("p_size"), "avg(p_size)"),
):
    query(f"select p_brand, {_sql} as value from part group by 1", _name)(_aggregate(_aggregator, _value))


@query("select event_type, count(*) as n, max(value) as top from events group by 1 having count(*) > 10")
def sql_transform(spark, sf_dir):
    return X.sqltransformingsource(t(spark, sf_dir, "events"), "moved", "select event_type, count(*), max(value) from moved group by 1 having count(*) > 10", columnnames=["event_type", "n", "top"])


@query("""select batch, event_type, count(*) as n from (select *, cast((row_number() over (order by event_id) - 1) // 1000 as bigint) as batch from events) group by 1, 2""")
def sql_transform_perbatch(spark, sf_dir):
    return X.sqltransformingsource(t(spark, sf_dir, "events"), "moved", "select batch, event_type, count(*) n from moved group by 1, 2", batchsize=1000, perbatch=True, order_by=["event_id"], batchcolumn="batch")


@query("""select 'batch' as label, count(*) as n, min(event_id) as low from (select *, (row_number() over (order by event_id) - 1) // 2500 as b from events) group by b""")
def sql_transform_each_batch(spark, sf_dir):
    """A query that knows nothing of batches, run over each."""
    return X.sqltransformingsource(t(spark, sf_dir, "events"), "moved", "select 'batch' as label, count(*) as n, min(event_id) as low from moved", batchsize=2500, perbatch=True, order_by=["event_id"])


@query("""select cast(strftime(d, '%Y%m%d') as integer) as dateid, strftime(d, '%Y-%m-%d') as date, strftime(d, '%B') as monthname, strftime(d, '%A') as weekday,
  strftime(d, '%U') as week, strftime(d, '%W') as monday_week, cast(year(d) as integer) as year, cast(dayofyear(d) as integer) as yday, year(d) % 4 = 0 as leap
  from (select cast(range as date) as d from range(date '1995-01-01', date '2001-08-01', interval 1 day))""")
def datespan_dim(spark, sf_dir):
    return I.datespan(spark, "1995-01-01", "2001-08-01", todateincl=False, strings={"date": "%Y-%m-%d", "monthname": "%B", "weekday": "%A", "week": "%U", "monday_week": "%W"}, ints={"year": "%Y", "yday": "%j"}, expander=lambda day, d: d.withColumn("leap", F.year(day) % 4 == 0))


@query("select n_nationkey as a, n_name as b from nation where n_regionkey = 1")
def sql_source(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("nation_source")
    return I.sqlsource(spark, "select n_nationkey, n_name from nation_source where n_regionkey = :r", ["a", "b"], parameters={"r": 1})


@query("select n_nationkey, n_name, n_regionkey from nation union all select r_regionkey, r_name, cast(null as integer) from region")
def foreach_source(spark, sf_dir):
    return I.foreachsource(["nation", "region"], lambda name: t(spark, sf_dir, name).toDF(*["n_nationkey", "n_name", "n_regionkey"][: 3 if name == "nation" else 2]))


# ---------------------------------------------------------------- dimensions


def _brands(spark: SparkSession, kind=Dimension, **named):
    return kind("brand", "id", ["p_brand", "p_type"], table=empty(spark, "id bigint, p_brand string, p_type string"), order_by=["p_partkey"], **named)


ENSURE_SQL = """with f as (select p_brand, p_type, min(p_partkey) as s from part group by 1, 2)
select cast(row_number() over (order by s) as bigint) as id, p_brand, p_type from f"""


@query(ENSURE_SQL)
def dim_ensure(spark, sf_dir):
    brand = _brands(spark)
    brand.ensure(t(spark, sf_dir, "part"))
    return brand.table


@query(ENSURE_SQL)
def dim_ensure_existing(spark, sf_dir):
    """Two loads: the second finds the members of the first."""
    brand = _brands(spark, CachedDimension)
    part = t(spark, sf_dir, "part")
    half = part.agg((F.max("p_partkey") / 2).cast("bigint")).first()[0]
    brand.ensure(part.where(F.col("p_partkey") <= half))
    brand.ensure(part)
    return brand.table


@query(f"with d as ({ENSURE_SQL}) select p_partkey, id from part left join d using (p_brand, p_type)")
def dim_ensure_keys(spark, sf_dir):
    return _brands(spark).ensure(t(spark, sf_dir, "part")).select("p_partkey", "id")


@query("""with d as (select n_nationkey as id, n_name from nation where n_regionkey < 2)
select n.n_nationkey, coalesce(d.id, -1) as id from nation n left join d on n.n_name = d.n_name""")
def dim_lookup_default(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    known = nation.where("n_regionkey < 2").selectExpr("cast(n_nationkey as int) id", "n_name")
    return Dimension("nation", "id", ["n_name"], table=known, defaultidvalue=-1).lookup(nation, into="id").select("n_nationkey", "id")


@query("select c_custkey, c_name, c_mktsegment, c_nationkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def dim_getbyvals(spark, sf_dir):
    return _customers(spark, sf_dir).getbyvals({"c_mktsegment": "BUILDING", "c_nationkey": 3})


def _customers(spark, sf_dir):
    return Dimension("customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"], ["c_name"], table=t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))


@query("""select o_orderkey, c_custkey, c_name, c_mktsegment, c_nationkey from orders join customer on o_custkey = c_custkey where o_totalprice > 100000""")
def dim_getbykey(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").where("o_totalprice > 100000")
    members = _customers(spark, sf_dir).getbykey(orders.selectExpr("o_custkey c_custkey").distinct())
    return orders.select("o_orderkey", "o_custkey").join(members, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")


@query("""with u as (select o_custkey, max_by(o_orderpriority, o_orderkey) as p from orders group by 1)
select c_custkey, c_name, coalesce(p, c_mktsegment) as c_mktsegment, c_nationkey from customer left join u on c_custkey = o_custkey""")
def dim_update(spark, sf_dir):
    customer = _customers(spark, sf_dir)
    customer.order_by = ["o_orderkey"]
    return customer.update(t(spark, sf_dir, "orders"), {"c_custkey": "o_custkey", "c_mktsegment": "o_orderpriority"})


@query("""select c_custkey + 100000 as id, c_name, c_mktsegment from customer""")
def dim_insert_idfinder(spark, sf_dir):
    customer = Dimension("customer", "id", ["c_name", "c_mktsegment"], ["c_name"], idfinder=lambda new: F.col("c_custkey") + 100000, table=empty(spark, "id bigint, c_name string, c_mktsegment string"))
    customer.insert(t(spark, sf_dir, "customer"))
    return customer.table


@query("""with f as (select p_brand, min(p_partkey) as s from part group by 1)
select cast(row_number() over (order by s) as bigint) as id, p_brand, 'brand ' || p_brand as label from f""")
def dim_rowexpander(spark, sf_dir):
    brand = Dimension("brand", "id", ["p_brand", "label"], ["p_brand"], table=empty(spark, "id bigint, p_brand string, label string"), order_by=["p_partkey"], rowexpander=lambda new: new.withColumn("label", F.concat(F.lit("brand "), F.col("p_brand"))))
    brand.ensure(t(spark, sf_dir, "part"))
    return brand.table


@query("""select dense_rank() over (order by s) as id, user_id, event_type, value from (
  select user_id, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value, min(event_id) as s from events group by 1)""")
def type1_scd(spark, sf_dir):
    users = TypeOneSlowlyChangingDimension("user", "id", ["user_id", "event_type", "value"], ["user_id"], table=empty(spark, "id bigint, user_id bigint, event_type string, value double"), order_by=["event_id"])
    users.scdensure(t(spark, sf_dir, "events"))
    return users.table


SCD2_SQL = """with x as (select o_custkey, o_orderpriority, cast(o_orderdate as date) as d, o_orderkey, o_orderstatus,
    case when lag(o_orderkey) over w is null or o_orderpriority is distinct from lag(o_orderpriority) over w then 1 else 0 end as ch
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
g as (select *, cast(sum(ch) over (partition by o_custkey order by d, o_orderkey rows unbounded preceding) as integer) as version from x),
s as (select o_custkey, max_by(o_orderstatus, struct_pack(d := d, k := o_orderkey)) as last_status from g group by 1),
v as (select o_custkey, version, min(d) as fromdate, min(o_orderpriority) as o_orderpriority, min_by(o_orderstatus, struct_pack(d := d, k := o_orderkey)) as first_status from g group by 1, 2)
select o_custkey, version, o_orderpriority, fromdate, lead(fromdate) over (partition by o_custkey order by version) as todate"""


def _history(spark, sf_dir, type1=(), status=False):
    orders = t(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    atts = ["o_custkey", "o_orderpriority", "version", "fromdate", "todate", *(["o_orderstatus"] if status else [])]
    table = empty(spark, "id bigint, o_custkey bigint, o_orderpriority string, version int, fromdate date, todate date" + (", o_orderstatus string" if status else ""))
    history = SlowlyChangingDimension("priority", "id", atts, ["o_custkey"], versionatt="version", fromatt="fromdate", toatt="todate", fromfinder=lambda names: F.col("day"), type1atts=type1, table=table, order_by=["o_orderdate", "o_orderkey"])
    return history, orders


@query(f"{SCD2_SQL} from v")
def scd2_scdensure(spark, sf_dir):
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    return history.table.drop("id")


@query(f"{SCD2_SQL} from v")
def scd2_two_batches(spark, sf_dir):
    """The same history from two loads, cut at a date."""
    history, orders = _history(spark, sf_dir)
    cut = orders.agg(F.expr("timestampadd(day, datediff(max(o_orderdate), min(o_orderdate)) div 2, min(o_orderdate))")).first()[0]
    history.scdensure(orders.where(F.col("o_orderdate") < cut))
    history.scdensure(orders.where(F.col("o_orderdate") >= cut))
    return history.table.drop("id")


@query(f"{SCD2_SQL}, last_status as o_orderstatus from v join s using (o_custkey)")
def scd2_type1_mix(spark, sf_dir):
    history, orders = _history(spark, sf_dir, type1=["o_orderstatus"], status=True)
    history.scdensure(orders)
    return history.table.drop("id")


@query(f"""select o_custkey, version, o_orderpriority, fromdate, coalesce(todate, case when c_mktsegment = 'BUILDING' then date '2030-01-01' end) as todate
  from ({SCD2_SQL} from v) left join customer on o_custkey = c_custkey""")
def scd2_closecurrent(spark, sf_dir):
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    gone = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(orders.select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    history.closecurrent(gone, {"o_custkey": "c_custkey"}, F.lit("2030-01-01").cast("date"))
    return history.table.drop("id")


def _asof(spark, sf_dir, which):
    history, orders = _history(spark, sf_dir)
    history.scdensure(orders)
    if which == "to":
        history.fromatt = None
    if which == "from":
        history.toatt = None
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("ship"))
    rows = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    inclusive = {"both": (True, False), "from": True, "to": False}[which]
    found = history.lookupasof(rows, "ship", inclusive, into="id")
    versions = history.table.selectExpr("id v_id", "version")
    return found.join(versions, F.col("id") == F.col("v_id"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship", "version")


ASOF_SQL = f"""with h as ({SCD2_SQL} from v), r as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) as ship, o_custkey from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, ship, (select {{}} from h where h.o_custkey = r.o_custkey {{}}) as version from r"""


@query(ASOF_SQL.format("min(version)", "and (todate is null or todate > ship) and fromdate <= ship"))
def scd2_asof_both(spark, sf_dir):
    return _asof(spark, sf_dir, "both")


@query(ASOF_SQL.format("max(version)", "and fromdate <= ship"))
def scd2_asof_from(spark, sf_dir):
    return _asof(spark, sf_dir, "from")


@query(ASOF_SQL.format("min(version)", "and (todate is null or todate > ship)"))
def scd2_asof_to(spark, sf_dir):
    return _asof(spark, sf_dir, "to")


def _places(spark, sf_dir):
    region = Dimension("region", "regionid", ["r_name"], table=empty(spark, "regionid bigint, r_name string"), order_by=["s_suppkey"])
    nation = Dimension("nation", "nationid", ["n_name", "regionid"], ["n_name"], table=empty(spark, "nationid bigint, n_name string, regionid bigint"), order_by=["s_suppkey"])
    supplier = Dimension("supplier", "supplierid", ["s_name", "nationid"], ["s_name"], table=empty(spark, "supplierid bigint, s_name string, nationid bigint"), order_by=["s_suppkey"])
    flow = X.hashjoin(X.hashjoin(t(spark, sf_dir, "supplier"), "s_nationkey", t(spark, sf_dir, "nation"), "n_nationkey"), "n_regionkey", t(spark, sf_dir, "region"), "r_regionkey")
    return SnowflakedDimension([(supplier, nation), (nation, region)]), flow


PLACES_SQL = """with f as (select * from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
r as (select r_name, cast(row_number() over (order by min(s_suppkey)) as bigint) as regionid from f group by 1),
n as (select n_name, r_name, cast(row_number() over (order by min(s_suppkey)) as bigint) as nationid from f group by 1, 2),
s as (select s_name, n_name, s_suppkey, cast(row_number() over (order by s_suppkey) as bigint) as supplierid from f)
select {} from s join n using (n_name) join r using (r_name)"""


@query(PLACES_SQL.format("s_suppkey, supplierid"))
def snowflake_ensure(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    return places.ensure(flow).select("s_suppkey", "supplierid")


@query(PLACES_SQL.format("supplierid, s_name, nationid, n_name, regionid, r_name"))
def snowflake_fullrow(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    places.ensure(flow)
    return places.table


@query(PLACES_SQL.format("supplierid, s_name, nationid") + " where n_name = 'FRANCE' or r_name = 'ASIA'")
def snowflake_getbyvals(spark, sf_dir):
    places, flow = _places(spark, sf_dir)
    places.ensure(flow)
    return places.getbyvals({"n_name": "FRANCE"}).union(places.getbyvals({"r_name": "ASIA"}))


# ---------------------------------------------------------------- facts


def _sales(spark, kind=FactTable, **named):
    return kind("sales", ["l_orderkey", "l_linenumber"], ["l_partkey", "price"], table=empty(spark, "l_orderkey bigint, l_linenumber int, l_partkey bigint, price bigint"), order_by=["l_partkey", "price"], **named)


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents("l_extendedprice").alias("price"))


LINES_SQL = "select l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice * 100) as bigint) as price from lineitem"
FIRST_SQL = f"select l_orderkey, l_linenumber, l_partkey, price from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, price) as r from ({LINES_SQL})) where r = 1"


@query(LINES_SQL)
def fact_insert(spark, sf_dir):
    facts = _sales(spark, BatchFactTable)
    facts.insert(_lines(spark, sf_dir))
    return facts.table


@query(FIRST_SQL)
def fact_ensure(spark, sf_dir):
    facts = _sales(spark)
    facts.ensure(_lines(spark, sf_dir))
    return facts.table


@query(f"""with k as (select distinct l_orderkey, l_linenumber from lineitem where l_partkey > 50), f as ({FIRST_SQL})
select l.l_orderkey, l.l_linenumber, k.l_orderkey is not null as existed from lineitem l left join k on l.l_orderkey = k.l_orderkey and l.l_linenumber = k.l_linenumber
union all select l_orderkey, l_linenumber, true from f""")
def fact_ensure_compare(spark, sf_dir):
    """Facts that are there already are told from new ones, and compared."""
    facts = _sales(spark)
    lines = _lines(spark, sf_dir)
    facts.ensure(lines.where("l_partkey > 50"))
    told = facts.ensure(lines).select("l_orderkey", "l_linenumber", "existed")
    return told.union(facts.ensure(facts.table, compare=True).select("l_orderkey", "l_linenumber", "existed"))


@query(f"with f as ({FIRST_SQL}) select f.* from orders join f on o_orderkey = l_orderkey and l_linenumber = 1")
def fact_lookup(spark, sf_dir):
    facts = _sales(spark)
    facts.ensure(_lines(spark, sf_dir))
    found = facts.lookup(t(spark, sf_dir, "orders").selectExpr("o_orderkey", "1 as one"), {"l_orderkey": "o_orderkey", "l_linenumber": "one"})
    return found.where("l_orderkey is not null")


@query("""with e as (select *, case when event_type = 'view' then value end as v, case when event_type = 'purchase' then value end as p from events)
select user_id, max_by(v, event_id) filter (where v is not null) as viewed, max_by(p, event_id) filter (where p is not null) as bought from e group by 1""")
def acc_snapshot(spark, sf_dir):
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    events = t(spark, sf_dir, "events").select("user_id", "event_id", when("view").alias("viewed"), when("purchase").alias("bought"))
    facts = AccumulatingSnapshotFactTable("user", ["user_id"], measures=["viewed", "bought"], table=empty(spark, "user_id bigint, viewed double, bought double"), order_by=["event_id"])
    facts.ensure(events)
    return facts.table


@query("""with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as d, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey) as r from orders),
f as (select o_custkey, max(case when r = 1 then d end) as first, max(case when r = 1 and s = 'F' then d end) as guess, max(case when r = 2 then d end) as later from o group by 1)
select o_custkey, first, coalesce(later, guess) as second, case when later is distinct from guess and later is not null then cast(later - first as integer) end as lag_days from f""")
def acc_snapshot_expander(spark, sf_dir):
    """First and second order of each customer; the lag is worked out when a second date comes to a fact that is there.

    First orders of status F come with a guess of the second date, which inserts no lag.
    """
    orders = numbered(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d")), ["o_custkey", "o_orderkey"], "at")
    least = orders.groupBy("o_custkey").agg(F.min("at").alias("least"))
    nth = F.col("at") - F.col("least")
    second = F.when(nth == 1, F.col("d")).when((nth == 0) & (F.col("o_orderstatus") == "F"), F.col("d"))
    rows = orders.join(least, "o_custkey").select("o_custkey", "o_orderkey", F.when(nth == 0, F.col("d")).alias("first"), second.alias("second"))
    facts = AccumulatingSnapshotFactTable("lag", ["o_custkey"], ["first", "second"], ["lag_days"], factexpander={"lag_days": lambda changed: F.when(changed("second"), F.datediff("second", "first"))}, table=empty(spark, "o_custkey bigint, first date, second date, lag_days int"), order_by=["o_orderkey"])
    facts.ensure(rows)
    return facts.table


@query(f"select l_orderkey, l_linenumber, l_partkey, price, cast((l_orderkey + l_linenumber) % 4 as integer) as part from ({LINES_SQL})")
def partition_fact(spark, sf_dir):
    parts = FactTablePartitioner([_sales(spark) for _ in range(4)])
    parts.insert(_lines(spark, sf_dir))
    return reduce(DataFrame.union, [p.table.withColumn("part", F.lit(k)) for k, p in enumerate(parts.parts)])


@query("""with f as (select p_brand, p_type, min(p_partkey) as s, length(p_brand || p_type) % 3 as part from part group by 1, 2)
select cast(row_number() over (partition by part order by s) as bigint) as id, p_brand, p_type, cast(part as integer) as part from f""")
def partition_dim(spark, sf_dir):
    parts = DimensionPartitioner([_brands(spark) for _ in range(3)], partitioner=lambda d: F.length(F.concat("p_brand", "p_type")))
    parts.ensure(t(spark, sf_dir, "part"))
    return reduce(DataFrame.union, [p.table.withColumn("part", F.lit(k)) for k, p in enumerate(parts.parts)])


@query("select n_nationkey, n_name, case when n_regionkey > 1 then n_regionkey end as n_regionkey from nation")
def bulk_roundtrip(spark, sf_dir):
    """Facts written as a loader's text files, with a text for nulls, and read again."""
    seen: list[str] = []
    nation = t(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")))
    facts = BulkFactTable("nation", ["n_nationkey"], ["n_name", "n_regionkey"], bulkloader=lambda *a: seen.append(a[-1]), nullsubst="\\N", table=empty(spark, "n_nationkey int, n_name string, n_regionkey int"))
    facts.insert(nation)
    facts.endload()
    back = spark.read.option("sep", "\t").option("nullValue", "\\N").schema("n_nationkey int, n_name string, n_regionkey int").csv(seen)
    return back


@query(ENSURE_SQL)
def bulk_dimension(spark, sf_dir):
    seen: list[str] = []
    brand = _brands(spark, BulkDimension, bulkloader=lambda *a: seen.append(a[-1]), nullsubst="")
    brand.ensure(t(spark, sf_dir, "part"))
    brand.endload()
    return spark.read.option("sep", "\t").schema("id bigint, p_brand string, p_type string").csv(seen)


# ---------------------------------------------------------------- steps, flows, streams


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' else 'open' end as kind from orders")
def step_conditional(spark, sf_dir):
    end = P.Step()
    final = P.Step(lambda d: d.select("o_orderkey", F.lit("final").alias("kind")), end)
    others = P.Step(lambda d: d.select("o_orderkey", F.lit("open").alias("kind")), end)
    source = P.SourceStep(t(spark, sf_dir, "orders"))
    P.connectsteps(source, P.ConditionalStep(F.col("o_orderstatus") == "F", final, others))
    source.start()
    return end.result()


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then null else '?' end as status from orders")
def step_valuemap(spark, sf_dir):
    source, last = P.SourceStep(t(spark, sf_dir, "orders")), P.ValueMappingStep("status", "o_orderstatus", {"F": "final", "O": None}, defaultvalue="?")
    P.connectsteps(source, last)
    source.start()
    return last.result().select("o_orderkey", "status")


@query("""select n_nationkey as id, upper(n_name) as name, 'copy' as way from nation union all select n_nationkey, lower(n_name), 'original' from nation""")
def step_copy(spark, sf_dir):
    end = P.Step(lambda d: d.select("id", "name", "way"))
    copy = P.MappingStep([("name", F.upper)], next=P.Step(lambda d: d.withColumn("way", F.lit("copy")), end))
    original = P.MappingStep([("name", F.lower), ("absent", F.lower)], requiretargets=False, next=P.Step(lambda d: d.withColumn("way", F.lit("original")), end))
    source = P.SourceStep(t(spark, sf_dir, "nation"))
    P.connectsteps(source, P.RenamingFromToStep({"n_nationkey": "id", "n_name": "name"}), P.CopyStep(original, copy))
    source.start()
    return end.result()


@query(f"with d as ({ENSURE_SQL}) select p_partkey, id as brandid from part left join d using (p_brand, p_type)")
def step_dimension(spark, sf_dir):
    source, last = P.SourceStep(t(spark, sf_dir, "part")), P.DimensionStep(_brands(spark), "brandid")
    P.connectsteps(source, last)
    source.start()
    return last.result().select("p_partkey", "brandid")


@query("""with g as (select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as grp from events)
select e.event_id, e.user_id, coalesce(r.n, 0) as n, r.top from g e left join (select user_id, grp, count(*) as n, max(value) as top from g where event_type <> 'purchase' group by 1, 2) r
  on e.user_id = r.user_id and e.grp = r.grp where e.event_type = 'purchase'""")
def agg_step_punctuation(spark, sf_dir):
    step = P.AggregatingStep({"n": F.count(F.lit(1)), "top": P.maxaggregator("value")}, F.col("event_type") == "purchase", ["event_id"], ["user_id"])
    source = P.SourceStep(t(spark, sf_dir, "events"), step)
    source.start()
    return step.result().select("event_id", "user_id", "n", "top")


@query("select p_partkey, p_size + 1 as size, upper(p_brand) as brand from part where p_size > 3")
def flow_functions(spark, sf_dir):
    flow = W.createflow(lambda d: d.where("p_size > 3"), [lambda d: d.withColumn("size", F.col("p_size") + 1), lambda d: d.withColumn("brand", F.upper("p_brand"))])
    flow.process(t(spark, sf_dir, "part"))
    flow.close()
    return flow.getall().select("p_partkey", "size", "brand")


@query("""select event_type, date_trunc('hour', ts) as hour, count(*) as n, max(value) as top from events group by 1, 2""")
def window_tumbling(spark, sf_dir):
    out = windowed(t(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", ["event_type"], {"n": F.count(F.lit(1)), "top": F.max("value")})
    return out.select("event_type", F.col("window.start").alias("hour"), "n", "top")


@query("""with x as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from x)
select user_id, min(ts) as began, count(*) as n from g group by user_id, k""")
def window_session(spark, sf_dir):
    out = sessions(t(spark, sf_dir, "events"), "ts", "6 hours", "1 day", ["user_id"], {"n": F.count(F.lit(1))})
    return out.select("user_id", F.col("window.start").alias("began"), "n")


from loomhouse.plans import more_queries as _more  # noqa: E402, F401  (adds its queries to the same tables)
