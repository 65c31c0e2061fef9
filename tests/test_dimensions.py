"""Dimensions against expected values and against a fold over the rows, one after the other."""

import datetime
import random

import pytest
from loomhouse.operators.dimension import CachedDimension, Dimension, TypeOneSlowlyChangingDimension
from loomhouse.operators.keys import getsharedsequencefactory, numbered
from loomhouse.operators.scd import SlowlyChangingDimension
from loomhouse.operators.snowflake import SnowflakedDimension
from pyspark.sql import functions as F


def d(text):
    return None if text is None else datetime.date.fromisoformat(text)


BOOKS = [(1, "Unknown", "Unknown"), (2, "Nineteen Eighty-Four", "Novel"), (3, "Calvin and Hobbes One", "Comic"), (4, "Calvin and Hobbes Two", "Comic"), (5, "The Silver Spoon", "Cookbook")]


def books(spark, kind=Dimension, **named):
    return kind("book", "id", ["title", "genre"], table=spark.createDataFrame(BOOKS, "id int, title string, genre string"), **named)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_construction_is_checked(spark):
    table = spark.createDataFrame(BOOKS, "id int, title string, genre string")
    for bad in (("", "id", ["title"]), ("b", "", ["title"]), ("b", "id", []), ("b", "id", "title"), ("b", "id", ["id"])):
        with pytest.raises(ValueError):
            Dimension(*bad, table=table)
    with pytest.raises(ValueError):
        Dimension("b", "id", ["title"], ["genre"], table=table)
    with pytest.raises(KeyError):
        Dimension("b", "id", ["absent"], table=table)


def test_lookup_insert_ensure(spark):
    book = books(spark, CachedDimension, order_by=["n"])
    batch = spark.createDataFrame([(1, "The Silver Spoon", "Cookbook"), (2, "New", "Novel"), (3, "New", "Novel"), (4, None, "Novel"), (5, None, "Novel"), (6, "Second", "Comic")], "n int, t string, genre string")
    names = {"title": "t"}
    assert [r["id"] for r in book.lookup(batch, names).orderBy("n").collect()] == [5, None, None, None, None, None]
    assert [r["id"] for r in book.ensure(batch, names).orderBy("n").collect()] == [5, 6, 6, 7, 7, 8]
    assert [r["id"] for r in book.ensure(batch, names).orderBy("n").collect()] == [5, 6, 6, 7, 7, 8]
    assert book.table.count() == 8
    assert [r["id"] for r in book.insert(batch.where("n < 3"), names).orderBy("n").collect()] == [9, 10]
    given = spark.createDataFrame([(1, 77, "x", "y"), (2, None, "z", "y")], "n int, id int, title string, genre string")
    assert [r["id"] for r in book.insert(given).orderBy("n").collect()] == [77, 78]


def test_null_regimes(spark):
    batch = spark.createDataFrame([(None, "Novel")], "title string, genre string")
    strict = books(spark, null_safe=False)
    strict.ensure(batch)
    strict.ensure(batch)
    assert strict.table.where("title is null").count() == 2


def test_default_id_counts_as_absent(spark):
    book = books(spark, defaultidvalue=1)
    batch = spark.createDataFrame([("Unknown", "Unknown"), ("Nope", "Nope")], "title string, genre string")
    assert [r["id"] for r in book.lookup(batch).collect()] == [1, 1]
    assert sorted(r["id"] for r in book.ensure(batch).collect()) == [6, 7]


def test_getters_and_update(spark):
    book = books(spark)
    assert rows(book.getbykey(3)) == [BOOKS[2]] and rows(book.getbykey({"id": 99})) == [(None, None, None)]
    assert rows(book.getbyvals({"genre": "Comic"})) == BOOKS[2:4]
    with pytest.raises(ValueError):
        book.getbyvals({"absent": 1})
    assert rows(book.lookuprow(spark.createDataFrame([("The Silver Spoon", "Cookbook"), ("x", "y")], "title string, genre string"))) == [BOOKS[4], (None, None, None)]
    book.update(spark.createDataFrame([(2, "1984"), (99, "none")], "id int, title string"))
    assert rows(book.getbykey(2)) == [(2, "1984", "Novel")] and book.table.count() == 5
    with pytest.raises(KeyError):
        book.update(spark.createDataFrame([("x",)], "title string"))


def test_expander_and_finder(spark):
    book = Dimension("book", "id", ["title", "genre"], ["title"], rowexpander=lambda new: new.withColumn("genre", F.lit("?")), idfinder=lambda new: F.length("title"), table=spark.createDataFrame([], "id int, title string, genre string"))
    book.ensure(spark.createDataFrame([("abc",)], "title string"))
    assert rows(book.table) == [(3, "abc", "?")]
    book.rowexpander = lambda new: None
    with pytest.raises(TypeError):
        book.ensure(spark.createDataFrame([("abcd",)], "title string"))


def test_empty_batch(spark):
    book = books(spark)
    assert book.ensure(spark.createDataFrame([], "title string, genre string")).count() == 0
    assert book.table.count() == 5


def test_type_one(spark):
    with pytest.raises(ValueError):
        TypeOneSlowlyChangingDimension("b", "id", ["title"], ["title"], table=spark.createDataFrame(BOOKS, "id int, title string, genre string"))
    book = TypeOneSlowlyChangingDimension("b", "id", ["title", "genre"], ["title"], table=spark.createDataFrame(BOOKS, "id int, title string, genre string"), order_by=["n"])
    out = book.scdensure(spark.createDataFrame([(1, "Unknown", "A"), (2, "New", "B"), (3, "Unknown", None), (4, "New", "C")], "n int, title string, genre string"))
    assert [r["id"] for r in out.orderBy("n").collect()] == [1, 6, 1, 6]
    assert rows(book.table.where("id in (1, 6)")) == [(1, "Unknown", None), (6, "New", "C")]


CUSTOMERS = [
    (1, "Ann", 20, "Aalborg", d("2010-01-01"), d("2010-03-03"), 1),
    (2, "Bob", 31, "Boston", d("2010-02-02"), None, 1),
    (3, "Ann", 20, "Aarhus", d("2010-03-03"), None, 2),
    (4, "Charlie", 19, "Copenhagen", d("2011-01-01"), None, 1),
]
SHAPE = "id int, name string, age int, city string, fromdate date, todate date, version int"


def customers(spark, **named):
    named = {"type1atts": ["age"], "srcdateatt": "from", "order_by": ["n"]} | named
    return SlowlyChangingDimension("customers", "id", ["name", "age", "city", "fromdate", "todate", "version"], ["name"], versionatt="version", fromatt="fromdate", toatt="todate", table=spark.createDataFrame(CUSTOMERS, SHAPE), **named)


def batch(spark, *some):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(some)], "n int, name string, age int, city string, from string")


def table(dim):
    return sorted(map(tuple, dim.table.collect()))


def test_new_version(spark):
    c = customers(spark)
    out = c.scdensure(batch(spark, ("Ann", 20, "Aabenraa", "2010-04-04"))).first()
    assert (out["id"], out["version"], out["fromdate"], out["todate"]) == (5, 3, d("2010-04-04"), None)
    assert table(c) == [CUSTOMERS[0], CUSTOMERS[1], (3, "Ann", 20, "Aarhus", d("2010-03-03"), d("2010-04-04"), 2), CUSTOMERS[3], (5, "Ann", 20, "Aabenraa", d("2010-04-04"), None, 3)]


def test_type_one_in_all_or_newest_versions(spark):
    c = customers(spark)
    c.scdensure(batch(spark, ("Ann", 21, "Aarhus", "2010-03-03")))
    assert [r[2] for r in table(c)] == [21, 31, 21, 19]
    c = customers(spark, type1atts=[("age", False)])
    c.scdensure(batch(spark, ("Ann", 21, "Aarhus", "2010-03-03")))
    assert [r[2] for r in table(c)] == [20, 31, 21, 19]
    c = customers(spark, type1atts=[("age", False)])
    c.scdensure(batch(spark, ("Ann", 21, "Aabenraa", "2010-04-04")))
    assert [r[2] for r in table(c)] == [20, 31, 20, 19, 21]


def test_two_versions_unchanged_and_new_member(spark):
    c = customers(spark)
    out = c.scdensure(batch(spark, ("Ann", 20, "Aabenraa", "2010-04-04"), ("Ann", 20, "Aalborg", "2010-05-05"), ("Bob", 31, "Boston", "2010-02-02"), ("Dan", 40, "Dublin", "2012-01-01")))
    assert [(r["id"], r["version"]) for r in out.orderBy("n").collect()] == [(5, 3), (6, 4), (2, 1), (7, 1)]
    assert table(c)[4:] == [(5, "Ann", 20, "Aabenraa", d("2010-04-04"), d("2010-05-05"), 3), (6, "Ann", 20, "Aalborg", d("2010-05-05"), None, 4), (7, "Dan", 40, "Dublin", d("2012-01-01"), None, 1)]


def test_close_current_then_new_version(spark):
    c = customers(spark)
    c.closecurrent(spark.createDataFrame([("Ann",)], "name string"), end=d("2010-04-04"))
    assert table(c)[2][5] == d("2010-04-04")
    c.scdensure(batch(spark, ("Ann", 20, "Aarhus", "2010-05-05")))
    assert table(c)[2][5] == d("2010-04-04") and table(c)[4] == (5, "Ann", 20, "Aarhus", d("2010-05-05"), None, 3)
    with pytest.raises(RuntimeError):
        c.closecurrent(spark.createDataFrame([("Nobody",)], "name string"))


def fold(start, some, everywhere):
    """The same loads, one row after the other, in plain Python."""
    members = [dict(zip("id name age city fromdate todate version".split(), r)) for r in start]
    top = max((m["id"] for m in members), default=0)
    led = []
    for name, age, city, day in some:
        day = d(day)
        own = [m for m in members if m["name"] == name]
        new = max(own, key=lambda m: m["version"]) if own else None
        if new is None or new["city"] != city or new["fromdate"] != day or new["todate"] is not None:
            top += 1
            if new is not None and new["todate"] is None:
                new["todate"] = day
            members.append({"id": top, "name": name, "age": age, "city": city, "fromdate": day, "todate": None, "version": (new["version"] if new else 0) + 1})
            new = members[-1]
        for m in own + [new] if everywhere else [new]:
            m["age"] = age
        led.append(new["id"])
    return sorted(tuple(m.values()) for m in members), led


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("everywhere", [True, False])
def test_against_the_fold(spark, seed, everywhere):
    r = random.Random(seed)
    some = [(r.choice(["Ann", "Bob", "Eve", None]), r.choice([1, 2, None]), r.choice(["x", "y", None]), f"2015-01-{r.randint(1, 3):02d}") for _ in range(40)]
    c = customers(spark, type1atts=[("age", everywhere)])
    start, led = table(c), []
    for part in (some[:25], some[25:]):
        led += [x["id"] for x in c.scdensure(batch(spark, *part)).orderBy("n").collect()]
    want, want_led = fold(start, some, everywhere)
    # keys of one batch follow the first row of each version, as in the fold
    assert sorted(table(c), key=repr) == sorted(want, key=repr)
    assert led == want_led


BOTH = [(0, "Aida", "Astrup", None, None, 1), (1, "Ann", "Aalborg", d("2001-01-01"), d("2001-12-31"), 1), (2, "Bob", "Boston", d("2001-01-01"), d("2001-12-31"), 1), (3, "Ann", "Aarhus", d("2002-01-01"), d("2002-12-31"), 2), (4, "Charlie", "Copenhagen", d("2001-01-01"), None, 1), (5, "Ann", "Aabenraa", d("2003-01-01"), None, 3), (6, "Bob", "Birkelse", d("2002-01-01"), d("2002-12-31"), 2)]


@pytest.mark.parametrize("version", ["version", None])
def test_as_of(spark, version):
    shape = spark.createDataFrame(BOTH, "id int, name string, city string, fromdate date, todate date, version int")

    def ask(frm, to, inclusive, *questions):
        dim = SlowlyChangingDimension("c", "id", ["name", "city", "fromdate", "todate", "version"], ["name"], versionatt=version, fromatt=frm, toatt=to, table=shape)
        asked = spark.createDataFrame([(k, n, d(w)) for k, (n, w) in enumerate(questions)], "n int, name string, w date")
        return [r["id"] for r in dim.lookupasof(asked, "w", inclusive).orderBy("n").collect()]

    questions = [("Ann", "2001-06-06"), ("Ann", "2001-12-31"), ("Ann", "2002-06-06"), ("Ann", "2010-01-01"), ("Ann", "2000-01-01"), ("Bob", "2003-01-01"), ("Aida", "1990-01-01"), ("Charlie", "2050-01-01"), ("Nobody", "2001-01-01"), ("Ann", "2001-01-01")]
    assert ask("fromdate", "todate", (True, True), *questions) == [1, 1, 3, 5, None, None, 0, 4, None, 1]
    assert ask("fromdate", "todate", (True, False), *questions) == [1, None, 3, 5, None, None, 0, 4, None, 1]
    assert ask(None, "todate", True, *questions) == [1, 1, 3, 5, 1, None, 0, 4, None, 1]
    assert ask(None, "todate", False, *questions) == [1, 3, 3, 5, 1, None, 0, 4, None, 1]
    assert ask("fromdate", None, True, *questions) == [1, 1, 3, 5, None, 6, 0, 4, None, 1]
    assert ask("fromdate", None, False, *questions) == [1, 1, 3, 5, None, 6, 0, 4, None, None]
    with pytest.raises(ValueError):
        ask("fromdate", "todate", (False, False), *questions)


YEARS, MONTHS = [(1, 2000), (2, 2001), (3, 2002)], [(1, "January 2000", 1), (2, "February 2000", 1), (13, "January 2001", 2), (25, "January 2002", 3)]
DAYS = [(1, "January 1, 2000", 1), (32, "February 1, 2000", 2), (33, "February 2, 2000", 2), (366, "January 1, 2001", 13), (731, "January 1, 2002", 25)]


def calendar(spark):
    year = Dimension("year", "yid", ["year"], table=spark.createDataFrame(YEARS, "yid int, year int"))
    month = Dimension("month", "mid", ["month", "yid"], ["month"], table=spark.createDataFrame(MONTHS, "mid int, month string, yid int"))
    day = Dimension("day", "did", ["day", "mid"], ["day"], table=spark.createDataFrame(DAYS, "did int, day string, mid int"), order_by=["n"])
    return SnowflakedDimension([(day, month), (month, year)]), day, month, year


def test_snowflake(spark):
    flake, day, month, year = calendar(spark)
    some = spark.createDataFrame([(1, "January 1, 2000", "January 2000", 2000), (2, "March 1, 2003", "March 2003", 2003), (3, "March 2, 2003", "March 2003", 2003), (4, "March 1, 2003", "March 2003", 2003), (5, "January 2, 2002", "January 2002", 2002)], "n int, day string, month string, year int")
    assert [r["did"] for r in flake.ensure(some).orderBy("n").collect()] == [1, 732, 733, 732, 734]
    assert (day.table.count(), month.table.count(), year.table.count()) == (8, 5, 4)
    assert rows(flake.getbykey(732, fullrow=True)) == [(732, "March 1, 2003", 26, "March 2003", 4, 2003)]
    assert flake.getbyvals({"year": 2000}).count() == 3
    assert rows(flake.lookuprow(some.where("n = 1"), fullrow=True)) == [(1, "January 1, 2000", 1, "January 2000", 1, 2000)]
    flake.update(spark.createDataFrame([(1, 1999)], "yid int, year int"))
    assert flake.getbyvals({"year": 1999}).count() == 3
    with pytest.raises(ValueError):
        flake.insert(some)


def test_snowflake_is_checked(spark):
    _, day, month, year = calendar(spark)
    for bad in ([], [(day, year)], [(day, month), (year, month)], [(day, month), (day, month)]):
        with pytest.raises(ValueError):
            SnowflakedDimension(bad)


def test_numbers(spark):
    frame = spark.range(1000).withColumn("h", F.xxhash64("id")).repartition(7)
    got = [r["k"] for r in numbered(frame, ["h"], "k", 10).orderBy("h").collect()]
    assert got == list(range(11, 1011))
    some = getsharedsequencefactory(5)
    assert some.interval() == range(5, 5005) and some.interval() == range(5005, 10005)
    for first in (10005, 15005):
        told = some(frame, "u")
        assert sorted(r["u"] for r in told.collect()) == list(range(first, first + 1000))
        assert told.orderBy("id").collect() == told.orderBy("id").collect()
    for _ in range(2000):  # intervals go on as long as there are numbers
        some.interval()
    assert some.next == 20005 + 2000 * 5000
