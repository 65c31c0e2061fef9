"""The warehouse, steps, flows and streams."""

import random
from pathlib import Path

import pytest
from loomhouse.operators.dimension import Dimension
from loomhouse.operators.facts import FactTable
from loomhouse.plans import flow as W
from loomhouse.plans import steps as P
from loomhouse.plans.store import Error, Warehouse, endload, getdefaulttargetconnection
from loomhouse.streaming.loads import stream_load
from pyspark.sql import functions as F


@pytest.fixture
def house(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    house.setasdefault()
    yield house
    house.close()


def test_commit_and_rollback(spark, house):
    house.write("book", spark.createDataFrame([], "id bigint, title string"))
    house.write("sale", spark.createDataFrame([], "id bigint, n int"))
    assert house.commit() == {"book": 1, "sale": 1}
    book = Dimension("book", "id", ["title"])
    sale = FactTable("sale", ["id"], ["n"], dependson=[book])
    assert getdefaulttargetconnection() is house
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "title string, n int")
    sale.insert(book.ensure(rows))
    house.commit()
    assert house.read("book").count() == 2 and house.read("sale").count() == 2
    book.ensure(spark.createDataFrame([("c",)], "title string"))
    assert book.table.count() == 3
    house.rollback()
    assert book.table.count() == 2
    endload()
    assert set(house.pending) == {"book", "sale"}
    again = Warehouse(spark, house.root)
    assert again.tables() == ["book", "sale"] and again.read("sale").count() == 2
    with pytest.raises(Error):
        again.read("absent")


def test_a_second_writer_is_refused(spark, house, monkeypatch):
    house.write("a", spark.range(1))
    house.commit()
    other = Warehouse(spark, house.root)
    state = other._versions()
    house.write("a", spark.range(2))
    house.commit()
    monkeypatch.setattr(other, "_versions", lambda: dict(state))
    other.write("a", spark.range(3))
    with pytest.raises(Error):
        other.commit()
    assert house.read("a").count() == 2


def folders(house, name):
    return house._versions()["tables"][name]["folders"]


def test_commit_writes_what_is_new(spark, house):
    """Appended rows are one more folder; an update is a new state; what no state of the last two names is deleted."""
    house.write("book", spark.createDataFrame([], "id bigint, title string"))
    house.write("sale", spark.createDataFrame([], "id bigint, n int"))
    house.commit()
    book, sale = Dimension("book", "id", ["title"], ["title"]), FactTable("sale", ["id"], ["n"])
    first = folders(house, "sale")
    sale.insert(book.ensure(spark.createDataFrame([("a", 1), ("b", 2)], "title string, n int")))
    house.commit()
    second = folders(house, "sale")
    assert second[:-1] == first and len(folders(house, "book")) == 2
    sale.ensure(spark.createDataFrame([(1, 9), (7, 3)], "id bigint, n int"))
    house.commit()
    third = folders(house, "sale")
    assert third[:-1] == second and len(folders(house, "book")) == 2  # no new member, nothing written
    assert [r["n"] for r in spark.read.parquet(f"{house.root}/sale/{third[-1]}").collect()] == [3]
    assert sorted(r["n"] for r in sale.table.collect()) == [1, 2, 3]
    old = folders(house, "book")
    book.update(spark.createDataFrame([(1, "z")], "id bigint, title string"))
    house.commit()
    assert len(folders(house, "book")) == 1 and folders(house, "sale") == third
    house.commit()
    there = lambda name: {f.name for f in Path(house.root, name).iterdir()}
    assert not there("book") & set(old) and there("sale") == set(third) and len(there("manifest")) <= 5
    assert sorted(r["title"] for r in house.read("book").collect()) == ["b", "z"]
    house.drop("book")
    assert house.tables() == ["sale"]


def test_many_folders_become_one(spark, house, monkeypatch):
    monkeypatch.setattr(Warehouse, "MOST", 3)
    house.write("sale", spark.createDataFrame([], "id bigint, n int"))
    house.commit()
    sale = FactTable("sale", ["id"], ["n"])
    for k in range(6):
        sale.insert(spark.createDataFrame([(k, k)], "id bigint, n int"))
        house.commit()
        assert len(folders(house, "sale")) <= 3 and sale.table.count() == k + 1


def test_execute_and_fetch(spark, house):
    house.write("t", spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"))
    got = house.execute("select a, b from t where a >= %(low)s order by a", {"n": 2}, {"low": "n"})
    assert house.fetchalltuples(got) == [(2, "y")] and house.fetchonetuple(got) == (2, "y") and house.fetchone(got) == {"a": 2, "b": "y"}
    assert house.resultnames(got) == ("a", "b") and house.rowcount(got) == 1 and list(house.rowfactory(got, ["p", "q"])) == [{"p": 2, "q": "y"}]
    assert house.fetchmanytuples(house.execute("select a from t order by a"), 1) == [(1,)]
    assert [house.fetchonetuple(r)[0] for r in house.executemany("select b from t where a = :a", [{"a": 1}, {"a": 2}])] == ["x", "y"]
    for statement, values in (("select b from t where a = %s and b = %s", (2, "y")), ("select b from t where a = ? and b = ?", [2, "y"]), ("select b from t where b = :2 and a = :1", (2, "y"))):
        assert house.fetchalltuples(house.cursor().execute(statement, values)) == [("y",)]
    assert house.getunderlyingmodule().DataFrame
    assert house.fetchone(got.limit(0)) is None and house.fetchonetuple(got.limit(0)) == (None, None)


def test_steps(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string")
    end = P.Step(name="end")
    source = P.SourceStep(frame)
    P.connectsteps(source, P.ValueMappingStep("m", "v", {"a": "A", None: "none"}, defaultvalue="?"), P.PrintStep(), P.ConditionalStep(F.col("id") < 3, "end", P.GarbageStep()))
    source.start()
    assert sorted((r["id"], r["m"]) for r in end.result().collect()) == [(1, "A"), (2, "none")]
    P.Step.getstep("end").inject(frame, "end")
    assert end.result().count() == 5
    big = P.ValueMappingStep("m", "id", {k: str(k) for k in range(2000)} | {2: None}, defaultvalue="?")
    big(frame.union(spark.createDataFrame([(9999, "z")], "id int, v string")))
    assert sorted((r["id"], r["m"]) for r in big.result().collect()) == [(1, "1"), (2, None), (3, "3"), (9999, "?")]
    with pytest.raises(KeyError):
        P.MappingStep([("absent", F.upper)])(frame)
    with pytest.raises(KeyError):
        P.ValueMappingStep("m", "absent", {})(frame)
    with pytest.raises(ValueError):
        P.CopyStep(end, None)
    renamed = P.RenamingToFromStep({"key": "id"})
    renamed(frame)
    assert renamed.result().columns == ["key", "v"]


def test_punctuated_groups(spark):
    frame = spark.createDataFrame([(1, 5.0, False), (2, 7.0, False), (3, None, True), (4, None, True), (5, 1.0, False)], "n int, v double, e boolean")
    step = P.AggregatingStep({"s": P.sumaggregator("v"), "a": P.avgaggregator("v"), "lo": P.minaggregator("v")}, F.col("e"), ["n"])
    step(frame.drop("x"))
    assert sorted((r["n"], r["s"], r["a"], r["lo"]) for r in step.result().collect()) == [(3, 12.0, 6.0, 5.0), (4, 0.0, 0.0, None)]


def test_punctuated_groups_over_many_ranges(spark):
    """Against a plain loop, with and without a hot key, and no task that sees all rows."""
    r = random.Random(4)
    some = [(n, r.choice(["hot"] * 5 + ["a", None]), r.choice([None, 1, 2, 3]), r.random() < 0.2) for n in range(300)]
    frame = spark.createDataFrame(some, "n int, k string, v int, e boolean").repartition(5)
    for by in ([], ["k"]):
        step = P.AggregatingStep({"s": P.sumaggregator("v"), "c": F.count(F.lit(1)), "hi": P.maxaggregator("v")}, F.col("e"), ["n"], by)
        step(frame)
        want, held = [], {}
        for n, k, v, e in some:
            own = held.setdefault(k if by else 0, [])
            if e:
                values = [x for x in own if x is not None]
                want.append((n, sum(values), len(own), max(values, default=None)))
                own.clear()
            else:
                own.append(v)
        assert sorted((x["n"], x["s"], x["c"], x["hi"]) for x in step.result().collect()) == want


def test_flows(spark):
    seen = []

    @W.splitpoint(instances=3, output=seen)
    def double(df):
        return df.select((F.col("id") * 2).alias("id"))

    assert double(spark.range(4)).agg(F.sum("id")).first()[0] == 12 and seen[0].rdd.getNumPartitions() == 3
    W.endsplits()
    flow = W.createflow(double, [lambda d: d.where("id > 2")])
    flow(spark.range(4))
    flow(spark.range(2))
    flow.close()
    assert not flow.finished and flow.get().count() == 2 and flow.getall().count() == 0 and flow.finished
    with pytest.raises(ValueError):
        flow(spark.range(1))
    assert W.shareconnectionwrapper(flow) is flow


def test_a_batch_that_comes_again_is_loaded_once(spark, house, tmp_path):
    """A failure after the commit and before the stream's own record: facts are not inserted twice."""
    house.write("fact", spark.createDataFrame([], "n bigint"))
    house.commit()
    fact = FactTable("fact", ["n"])
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    spark.range(3).toDF("n").write.parquet(str(source))
    run = lambda load: stream_load(spark.readStream.schema("n bigint").parquet(str(source)), load, house, str(checkpoint)).awaitTermination()

    def fails(batch):
        fact.insert(batch)
        raise RuntimeError("broken")

    with pytest.raises(Exception, match="broken"):
        run(fails)
    assert fact.table.count() == 0
    run(fact.insert)
    assert house.read("fact").count() == 3 and house.loaded(str(checkpoint)) == 0
    for f in (checkpoint / "commits").iterdir():  # as if the stream had not come to write that it was done
        f.unlink()
    run(fact.insert)
    assert house.read("fact").count() == 3
    spark.range(3, 5).toDF("n").write.mode("append").parquet(str(source))
    run(fact.insert)
    assert house.read("fact").count() == 5


def test_stream(spark, house, tmp_path):
    house.write("user", spark.createDataFrame([], "id bigint, name string"))
    house.commit()
    user = Dimension("user", "id", ["name"])
    source = tmp_path / "in"
    for k, names in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(n,) for n in names], "name string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("name string").parquet(str(source))
        stream_load(stream, user.ensure, house, str(tmp_path / "checkpoint")).awaitTermination()
        assert house.read("user").count() == 2 + k
    assert sorted(r["id"] for r in house.read("user").collect()) == [1, 2, 3]
