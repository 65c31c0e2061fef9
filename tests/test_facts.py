import random

import pytest
from loomhouse.operators.facts import AccumulatingSnapshotFactTable, BatchFactTable, BulkFactTable, DecoupledFactTable, FactTable, SubprocessFactTable
from loomhouse.operators.partitioning import BasePartitioner, DimensionPartitioner, FactTablePartitioner
from loomhouse.operators.dimension import CachedBulkDimension, Dimension
from pyspark.sql import functions as F

SALES = [(2, 2, 60, 20, 1000), (1, 2, 60, 5, 2000), (1, 1, 72, 2, 3000), (2, 1, 72, 11, 4000), (2, 1, 60, 18, 5000)]
SHAPE = "bib int, cid int, did int, count int, profit int"


def sales(spark, kind=FactTable, rows=SALES, **named):
    return kind("sales", ["bib", "cid", "did"], ["count", "profit"], table=spark.createDataFrame(rows, SHAPE), **named)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("kind", [FactTable, BatchFactTable, BulkFactTable])
def test_insert_lookup_ensure(spark, kind):
    facts = sales(spark, kind, order_by=["n"])
    names = {"bib": "b"}
    asked = spark.createDataFrame([(1, 1, 2, 60), (2, 9, 9, 9), (3, None, 2, 60)], "n int, b int, cid int, did int")
    assert rows(facts.lookup(asked, names)) == sorted([SALES[1], (None,) * 5, (None,) * 5], key=repr)
    batch = spark.createDataFrame([(1, 7, 7, 7, 1, 1), (2, 7, 7, 7, 2, 2), (3, 1, 2, 60, 9, 9)], "n int, b int, cid int, did int, count int, profit int")
    assert [r["existed"] for r in facts.ensure(batch, namemapping=names).orderBy("n").collect()] == [False, False, True]
    assert facts.table.count() == 6 and rows(facts.table.where("bib = 7")) == [(7, 7, 7, 1, 1)]
    facts.insert(batch.where("n = 3"), names)
    assert facts.table.where("bib = 1 and cid = 2").count() == 2


def test_ensure_compares(spark):
    facts = sales(spark)
    facts.ensure(spark.createDataFrame(SALES, SHAPE), compare=True)
    with pytest.raises(ValueError):
        facts.ensure(spark.createDataFrame([(2, 2, 60, 21, 1000)], SHAPE), compare=True)
    with pytest.raises(ValueError):  # two new rows of one fact that differ
        facts.ensure(spark.createDataFrame([(5, 5, 5, 1, 1), (5, 5, 5, 2, 1)], SHAPE), compare=True)
    assert facts.table.count() == 5
    with pytest.raises(KeyError):
        facts.ensure(spark.createDataFrame([(1,)], "bib int"))


SNAP = [(1, 1, 1, 1, 1, 1.0, 0), (2, 2, 2, None, None, 2.0, None), (3, 3, None, None, None, None, None)]
SNAPSHAPE = "id1 int, id2 int, ref1 int, ref2 int, ref3 int, meas double, lag21 int"


def snapshot(spark, **named):
    return AccumulatingSnapshotFactTable("facts", ["id1", "id2"], ["ref1", "ref2", "ref3"], ["meas", "lag21"], table=spark.createDataFrame(SNAP, SNAPSHAPE), order_by=["n"], **named)


LAG = {"lag21": lambda changed: F.when(changed("ref2"), F.col("ref2") - F.col("ref1"))}


def test_snapshot(spark):
    facts = snapshot(spark, factexpander=LAG)
    batch = spark.createDataFrame([(1, 2, 2, None, 3, None), (2, 2, 2, None, None, 9.0), (3, 4, 4, 5, None, None), (4, 4, 4, None, 8, None), (5, 1, 1, None, None, None)], "n int, id1 int, id2 int, ref1 int, ref2 int, meas double")
    facts.ensure(batch)
    assert rows(facts.table) == [(1, 1, 1, 1, 1, 1.0, 0), (2, 2, 2, 3, None, 9.0, 1), (3, 3, None, None, None, None, None), (4, 4, 5, 8, None, None, 3)]
    facts.update(spark.createDataFrame([(1, 3, 3, 7)], "n int, id1 int, id2 int, ref3 int"))
    assert rows(facts.table)[2] == (3, 3, None, None, 7, None, None)
    with pytest.raises(KeyError):
        facts.update(spark.createDataFrame([(1, 99, 3, 7)], "n int, id1 int, id2 int, ref3 int"))


def test_a_new_fact_is_not_expanded(spark):
    """Both references on the row that inserts the fact: nothing has changed yet; a later row expands."""
    facts = snapshot(spark, factexpander=LAG)
    facts.ensure(spark.createDataFrame([(1, 8, 8, 1, 4), (2, 9, 9, 1, 4), (3, 9, 9, None, 6), (4, 7, 7, 2, None), (5, 7, 7, None, None)], "n int, id1 int, id2 int, ref1 int, ref2 int"))
    assert [r[-1] for r in rows(facts.table) if r[0] > 6] == [None, None, 5]


def test_snapshot_without_expander_against_a_loop(spark):
    r = random.Random(6)
    for refs, measures in ((True, True), (False, True), (True, False)):
        facts = snapshot(spark, ignorenonerefs=refs, ignorenonemeasures=measures)
        state = {s[:2]: list(s[2:]) for s in SNAP}
        some = [(n, r.choice([1, 1, 1, 5]), r.choice([1, 2]), r.choice([None, n]), r.choice([None, float(n)])) for n in range(60)]
        for _, a, b, ref, meas in some:
            fact = state.setdefault((a, b), [None] * 5)
            if ref is not None or not refs:
                fact[0] = ref
            if meas is not None or not measures:
                fact[3] = meas
        facts.ensure(spark.createDataFrame(some, "n int, id1 int, id2 int, ref1 int, meas double").repartition(3))
        assert rows(facts.table) == sorted([(*k, *v) for k, v in state.items()], key=repr)


def test_snapshot_with_nulls_that_count(spark):
    facts = snapshot(spark, ignorenonerefs=False)
    facts.ensure(spark.createDataFrame([(1, 1, 1, None, None)], "n int, id1 int, id2 int, ref1 int, meas double"))
    assert (1, 1, None, 1, 1, 1.0, 0) in rows(facts.table)


def test_bulk_files(spark):
    seen = []
    facts = BulkFactTable("f", ["a"], ["b", "c"], bulkloader=lambda *x: seen.append((x[:5], sorted(r[0] for r in spark.read.text(x[5]).collect()))), nullsubst="-", fieldsep=";", table=spark.createDataFrame([], "a int, b string, c boolean"))
    facts.insert(spark.createDataFrame([(1, None, True), (2, "x", False)], "a int, b string, c boolean"))
    facts.endload()
    assert seen == [(("f", ["a", "b", "c"], ";", "\n", "-"), ["1;-;1", "2;x;0"])]
    plain = BulkFactTable("f", ["a"], ["b"], bulkloader=lambda *x: None, table=spark.createDataFrame([], "a int, b string"))
    plain.insert(spark.createDataFrame([(1, None)], "a int, b string"))
    with pytest.raises(TypeError):
        plain.endload()
    book = CachedBulkDimension("b", "id", ["t"], bulkloader=lambda *x: seen.append(x[5]), table=spark.createDataFrame([], "id int, t string"))
    book.ensure(spark.createDataFrame([("x",), ("y",)], "t string"))
    book.endload()
    assert spark.read.text(seen[-1]).count() == 2


def test_subprocess(spark, tmp_path):
    out = tmp_path / "out.txt"
    table = SubprocessFactTable(["a"], ["b"], f"cat > {out}", initcommand="begin", endcommand="end", nullsubst="?", parallel=False)
    table.insert(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    assert out.read_text().splitlines() == ["begin", "1\tx", "2\t?", "end"]
    with pytest.raises(Exception, match="ended with"):
        SubprocessFactTable(["a"], [], "exit 3", parallel=False).insert(spark.range(1).selectExpr("id a"))


def test_partitions(spark):
    parts = FactTablePartitioner([sales(spark, rows=[]) for _ in range(3)])
    parts.insert(spark.createDataFrame(SALES, SHAPE))
    assert [sorted(sum(r[:3]) % 3 for r in p.table.collect()) for p in parts.parts] == [[k] * n for k, n in zip(range(3), [sum(sum(s[:3]) % 3 == k for s in SALES) for k in range(3)])]
    assert rows(parts.lookup(spark.createDataFrame(SALES, SHAPE))) == rows(spark.createDataFrame(SALES, SHAPE))
    assert parts.ensure(spark.createDataFrame(SALES, SHAPE)).where("existed").count() == 5
    dims = DimensionPartitioner([Dimension("d", "id", ["t"], table=spark.createDataFrame([], "id int, t string")) for _ in range(2)])
    batch = spark.createDataFrame([(c,) for c in "abcdefgh"], "t string")
    assert dims.ensure(batch).count() == 8 and dims.table.count() == 8 and dims.ensure(batch).count() == 8 and dims.table.count() == 8
    assert dims.lookup(batch).where("id is not null").count() == 8 and dims.getbyvals({"t": "a"}).count() == 1
    turn = BasePartitioner([1, 2])
    turn.addpart(3)
    turn.droppart()
    assert turn.parts == [2, 3]
    assert DecoupledFactTable(sales(spark)).table.count() == 5


def test_loads_of_a_snapshot_do_not_pile_up(spark):
    """A load reads the table that the load before wrote: its plan, and a task's memory with it, does not grow with the loads."""
    facts = AccumulatingSnapshotFactTable("span", ["k"], ["a"], table=spark.createDataFrame([], "k bigint, a bigint"), order_by=["n"])
    for n in range(3):
        facts.ensure(spark.createDataFrame([(10, n, n), (n, n, 5)], "k bigint, n bigint, a bigint"))
    assert "Join" not in facts.table._jdf.queryExecution().optimizedPlan().toString()
    assert rows(facts.table) == [(0, 5), (1, 5), (10, 2), (2, 5)]
