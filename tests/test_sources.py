import datetime
import os
import random
import sqlite3
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomhouse.functions import aggregators as A
from loomhouse.functions import rows as R
from loomhouse.functions import scalars as S
from loomhouse.plans.queries import SQL
from loomhouse.sources import readers as I
from loomhouse.sources import transforming as X
from pyspark.sql import functions as F

BOOKS = [(1, "Unknown", "Unknown"), (2, "Nineteen Eighty-Four", "Novel"), (3, "Calvin and Hobbes One", "Comic"), (4, "Calvin and Hobbes Two", "Comic"), (5, "The Silver Spoon", "Cookbook")]


@pytest.fixture
def book(spark):
    return spark.createDataFrame(BOOKS, "id int, title string, genre string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,"x ""q"", y",\n2,"two\nlines",2020-01-31\n')
    assert rows(I.csvsource(spark, str(path))) == [("1", 'x "q", y', ""), ("2", "two\nlines", "2020-01-31")]
    typed = I.typedcsvsource(spark, str(path), {"a": "int", "b": F.upper})
    assert typed.schema["a"].dataType.simpleString() == "int" and rows(typed)[0][1] == 'X "Q", Y'
    with pytest.raises(TypeError):
        I.typedcsvsource(spark, str(path), [("a", "int")])
    with pytest.raises(KeyError):
        I.typedcsvsource(spark, str(path), {"z": "int"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        I.typedcsvsource(spark, str(path), {"b": "int"}).collect()
    assert I.csvsource(spark, str(path), fieldnames=["x", "y", "z"]).count() == 3


def test_sql_and_database(spark, tmp_path, book):
    book.createOrReplaceTempView("book_view")
    assert rows(I.sqlsource(spark, "select id, title from book_view where id > :n", ["i", "t"], parameters={"n": 4})) == [(5, "The Silver Spoon")]
    with pytest.raises(ValueError):
        I.sqlsource(spark, "select id, title from book_view", ["i"])
    path = str(tmp_path / "db.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table book (id int, title text)")
        db.executemany("insert into book values (?, ?)", [b[:2] for b in BOOKS])
    for size in (2, 0):
        got = I.dbsource(spark, lambda: sqlite3.connect(path), "select id, title from book", "id int, title string", ["i", "t"], fetchsize=size)
        assert got.columns == ["i", "t"] and got.count() == 5


def test_small_sources(spark, book):
    assert rows(I.pandassource(spark, pd.DataFrame({"a": [1, 2]}))) == [(1,), (2,)]
    assert rows(I.rowfactory(spark, [(1, "a"), (2, "b")], ["x", "y"])) == [(1, "a"), (2, "b")]
    db = sqlite3.connect(":memory:")
    assert rows(I.rowfactory(spark, db.execute("select 1, 2 union select 3, 4"), ["a", "b"])) == [(1, 2), (3, 4)]
    assert I.foreachsource([1, 2], lambda k: book.where(F.col("id") == k)).count() == 2
    assert I.processsource(book) is book
    with pytest.raises(ValueError):
        I.processsource(book, 0)


PATTERNS = ["%Y-%m-%d", "%B %A %d", "%U %W %w %u %V", "%y%j%%", "%b %a"]


def test_datespan(spark):
    out = I.datespan(spark, "1999-12-20", datetime.date(2001, 1, 10), fromdateincl=False, strings={f"s{k}": p for k, p in enumerate(PATTERNS)}, ints={"y": "%Y"})
    day = datetime.date(1999, 12, 21)
    for r in out.orderBy("dateid").collect():
        assert r["dateid"] == int(day.strftime("%Y%m%d")) and r["y"] == day.year
        assert [r[f"s{k}"] for k in range(len(PATTERNS))] == [day.strftime(p) for p in PATTERNS]
        day += datetime.timedelta(1)
    assert day == datetime.date(2001, 1, 11)
    assert I.datespan(spark, "2001-01-01", "2001-01-01", todateincl=False).count() == 0
    with pytest.raises(ValueError):
        I.datespan(spark, 5, "2001-01-01")


@settings(max_examples=25, deadline=None)
@given(st.one_of(st.integers(-(10**6), 10**6).map(str), st.sampled_from([" 12 ", "+5", "3.7", "abc", "", "1e3", "inf"])))
def test_numbers_like_python(spark, text):
    def python(f):
        try:
            return f(text)
        except ValueError:
            return -1

    assert one(spark, S.getint(F.lit(text), -1)) == python(int)
    assert one(spark, S.getfloat(F.lit(text), -1.0)) == python(float)


def test_scalars(spark):
    for value, want in (("t", True), ("0", False), ("x", None), ("True", True)):
        assert one(spark, S.getbool(F.lit(value))) is want
    assert one(spark, S.getbool(F.lit(True))) is True and one(spark, S.getbool(F.lit("x"), False)) is False
    assert one(spark, S.getstr(F.lit(None).cast("int"))) == "None" and one(spark, S.getstrippedstr(F.lit(" \ta "))) == "a"
    assert one(spark, S.getstrornullvalue(F.lit(None).cast("int"), "-")) == "-" and one(spark, S.getdbfriendlystr(F.lit(True), boolean=True)) == "1"
    assert one(spark, S.getsqlfriendlystr(F.lit("o'c"))) == "'o''c'" and one(spark, S.getsqlfriendlystr(F.lit(None).cast("string"))) == "NULL" and one(spark, S.getsqlfriendlystr(F.lit(5), quoted=False)) == "5"
    assert one(spark, S.getdate(F.lit("2020-1-5"))) == datetime.date(2020, 1, 5) and one(spark, S.getdate(F.lit("bad"))) is None
    assert one(spark, S.gettimestamp(F.lit("2020-01-05 01:02:03"))) == datetime.datetime(2020, 1, 5, 1, 2, 3)
    assert one(spark, S.ymdparser(F.lit("'2020-01-05'"))) == datetime.date(2020, 1, 5) and one(spark, S.ymdhmsparser(F.lit('"2020-01-05 01:02:03"'))) == datetime.datetime(2020, 1, 5, 1, 2, 3)
    assert one(spark, S.today()) == one(spark, S.today()) and one(spark, S.now()) == one(spark, S.now())
    assert (one(spark, S.toupper(F.lit("a"))), one(spark, S.tolower(F.lit("A"))), one(spark, S.keepasis(F.lit("a")))) == ("A", "a", "a")


def test_rows(spark, book):
    assert R.project(book, ["t", "id"], {"t": "title"}).columns == ["t", "id"]
    assert sorted(R.copy(book, name="title", other="title").columns) == ["genre", "id", "name", "other"]
    assert R.renamefromto(book, {"title": "t"}).columns == ["id", "t", "genre"] and R.renametofrom(book, {"t": "title"}).columns == ["id", "t", "genre"]
    with pytest.raises(ValueError):
        R.renamefromto(book, {"title": "genre", "genre": "title"})
    with pytest.raises(KeyError):
        R.rename(book, {"absent": "x"})
    assert book.select(R.getvalueor(book, "absent", default=3).alias("x")).first()[0] == 3
    assert R.setdefaults(book, [("id", 9), ("new", 9)]).where("new = 9 and id < 9").count() == 5
    with pytest.raises(ValueError):
        R.setdefaults(book, ["a"], [])


def test_transforming(spark, book):
    with pytest.raises(KeyError):
        X.mappingsource(book, {"absent": F.upper})
    with pytest.raises(TypeError):
        X.mappingsource(book, {"title": "upper"})
    assert rows(X.mappingsource(book, {"genre": F.upper}))[0][2] == "UNKNOWN"
    seen = X.transformingsource(book, X.rowtransformation(lambda r: {"n": r["id"] * 2}, "n bigint"))
    assert sorted(rows(seen)) == [(2,), (4,), (6,), (8,), (10,)]
    batches = X.sqltransformingsource(book, "b", "select batch, genre, count(*) from b group by 1, 2", batchsize=1, perbatch=True, columnnames=["batch", "genre", "n"], order_by=["id"], batchcolumn="batch")
    assert sorted(r["genre"] for r in batches.collect()) == ["Comic", "Comic", "Cookbook", "Novel", "Unknown"]
    each = X.sqltransformingsource(book, "b", "select genre, count(*) n from b group by 1", batchsize=1, perbatch=True, order_by=["id"])
    assert each.columns == ["genre", "n"] and sorted(r["genre"] for r in each.collect()) == ["Comic", "Comic", "Cookbook", "Novel", "Unknown"]
    for k in (1, 2, 5):  # the word in the text of a query means nothing
        told = X.sqltransformingsource(book, "b", "select 'batch' as label, count(*) n from b", batchsize=k, perbatch=True, order_by=["id"])
        assert sorted((r["label"], r["n"]) for r in told.collect()) == sorted([("batch", k)] * (5 // k) + [("batch", 5 % k)] * (5 % k > 0))
    with pytest.raises(ValueError):
        X.sqltransformingsource(book, "b", "select 1", batchcolumn="batch")
    whole = X.sqltransformingsource(book, "b", "select genre, count(*) n from b group by 1")
    assert sorted(r["genre"] for r in whole.collect()) == ["Comic", "Cookbook", "Novel", "Unknown"]


def test_joins_unions_pivot(spark):
    left = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k2 int, v string")
    for join in (X.hashjoin, X.mergejoin):
        assert rows(join(left, "k", right, "k2")) == sorted([(1, 1, "x"), (1, 1, "y"), (None, None, "z")], key=repr)
    assert X.hashjoin(left, "k", right.limit(0), "k2").count() == 0
    assert X.unionsource(left, right).columns == ["k", "v", "k2"]
    turn = X.roundrobinsource([spark.range(5), spark.range(100, 103)], 2, order_by=["id"], position="p")
    assert [r["id"] for r in turn.orderBy("p").collect()] == [0, 1, 100, 101, 2, 3, 102, 4]
    with pytest.raises(ValueError):
        X.roundrobinsource([left], 0)
    cells = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("s", "b", 5)], "r string, c string, v int")
    assert rows(X.crosstab(cells, "r", "c", "v")) == [("r", 3, 0), ("s", 0, 5)]
    assert rows(X.crosstab(cells, "r", "c", "v", A.Max(), None)) == [("r", 2, None), ("s", None, 5)]


def test_aggregators(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), ("b", None)], "g string, v int")
    got = frame.groupBy("g").agg(*[a.finish(F.col("v"), d).alias(type(a).__name__) for a, d in ((A.Sum(), 0), (A.Count(), None), (A.CountDistinct(), None), (A.Max(), -1), (A.Min(), None), (A.Avg(), 0.0))], A.Own(lambda c: F.bit_or(c)).column(F.col("v")).alias("own"))
    assert rows(got) == sorted([("a", 2, 3, 2, 1, 1, 1.0, 1), ("b", 0, 1, 1, -1, None, 0.0, None)], key=repr)


def test_random_hash_join_against_loops(spark):
    r = random.Random(4)
    a = [(r.choice([1, 2, 3, None]), k) for k in range(30)]
    b = [(r.choice([1, 2, 5, None]), k) for k in range(20)]
    got = X.hashjoin(spark.createDataFrame(a, "k int, x int"), "k", spark.createDataFrame(b, "j int, y int"), "j")
    assert rows(got) == sorted([(*p, *q) for p in a for q in b if p[0] == q[0]], key=repr)


EACH = [
    "select 'batch' as label, count(*) as n, min(id) as low from b",
    "select g, count(*) n, sum(v) s from b group by g",
    "select count(*) n, coalesce(sum(v), 0) s from b where id > 10",
    "with x as (select g, count(*) n from b group by g) select max(n) m from x -- the end",
    "select id, row_number() over (order by id desc) r from b",
    "select a.id x, c.id y from b a join b c on a.id = c.id + 1",
    "select id from b where v = (select max(v) from b)",
]


@pytest.mark.parametrize("query", EACH)
def test_a_query_over_each_batch(spark, monkeypatch, query):
    """One plan for all batches gives what a plan for each of them does; batches planned by themselves read their own rows only."""
    frame = spark.range(23).selectExpr("id", "cast(id % 3 as int) g", "if(id = 4, null, id * 1.5D) v")
    want = []
    for k in range(0, 23, 5):
        frame.where(f"id between {k} and {k + 4}").createOrReplaceTempView("b")
        want += spark.sql(query).collect()
    each = lambda: X.sqltransformingsource(frame, "b", query, batchsize=5, perbatch=True, order_by=["id"])
    out = each()
    assert rows(out) == sorted(map(tuple, want), key=repr)
    assert ("Union" in out._jdf.queryExecution().analyzed().toString()) == ("(select max" in query)
    monkeypatch.setattr(X, "_lateral", lambda *a: None)
    monkeypatch.setattr(X, "PLANS", 2)
    assert rows(each()) == sorted(map(tuple, want), key=repr)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from loomhouse.plans import queries, store
store.CHUNK = 3
frame = queries.QUERIES["jdbc_source"](spark, "/root/testdata/sf0.001")
print("ROWS", sorted(map(tuple, frame.collect())))
base = store.JdbcWarehouse(spark, "jdbc:derby:memory:x;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
for k in range(2):
    base.write("T", spark.range(4, numPartitions=2).selectExpr("id as A", "if(id = 1, null, cast(id as double)) as B"), mode="append" if k else "overwrite")
print("BOTH", sorted(map(str, base.read("T").collect())), base.query('select "A" from T where "A" > 5').count())
"""


def test_embedded_database_with_executors_of_their_own(tmp_path):
    """Each process would open an embedded database of its own: the driver's must be written and read by the driver."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": home}, capture_output=True, text=True, timeout=300)
    told = dict(x.split(" ", 1) for x in ran.stdout.splitlines() if x.startswith(("ROWS", "BOTH")))
    with duckdb.connect() as duck:
        duck.execute("create view supplier as select * from '/root/testdata/sf0.001/supplier.parquet'")
        assert told["ROWS"] == str(sorted(duck.execute(SQL["jdbc_source"]).fetchall())), ran.stderr[-2000:]
    assert told["BOTH"] == str(sorted(2 * [f"Row(A={k}, B={None if k == 1 else float(k)})" for k in range(4)])) + " 0"
