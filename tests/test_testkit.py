import datetime

import pytest
from loomhouse.plans.store import Warehouse
from loomhouse.testkit import Table, clearvariables
from loomhouse.testkit.drawn import align
from loomhouse.testkit.runner import main

BOOK = """
| id:int (pk) | title:text            | genre:text |
| ----------- | --------------------- | ---------- |
| 1           | Unknown               | Unknown    |
| 2           | Nineteen Eighty-Four  | Novel      |
| 3           | Calvin and Hobbes One | NULL       |
"""


@pytest.fixture
def house(spark, tmp_path):
    clearvariables()
    house = Warehouse(spark, str(tmp_path / "house"))
    house.setasdefault()
    yield house
    house.close()


def test_a_drawing_is_read(house):
    t = Table("book", BOOK)
    assert len(t) == 3 and t[2] == {"id": 3, "title": "Calvin and Hobbes One", "genre": None} and t.key() == "id"
    more = t + "| 4 | New | Comic |" + "| 5 | Newer | Comic |"
    assert more.additions() == [{"title": "New", "genre": "Comic"}, {"title": "Newer", "genre": "Comic"}]
    assert more.additions(withKey=True)[0]["id"] == 4 and len(t) == 3
    assert t.update(0, "| | Known | |")[0] == {"id": 1, "title": "Known", "genre": "Unknown"}
    assert [x["id"] for x in t] == [1, 2, 3]
    assert Table("book", str(t)).rows == t.rows
    kinds = Table("k", "| a:bigint (pk) | b:decimal(6,2) (not null, unique) | c:date | d:timestamp | e:boolean | f:double precision |\n| - | - | - | - | - | - |\n| 1 | 1.5 | 2020-01-31 | 2020-01-31 01:02:03 | true | 2 |")
    assert kinds[0]["c"] == datetime.date(2020, 1, 31) and kinds[0]["e"] is True and str(kinds[0]["b"]) == "1.50"
    assert "NOT NULL" in kinds.getSQLToCreate() and "DATE'2020-01-31'" in kinds.getSQLToInsert()


@pytest.mark.parametrize("bad", ["", "no pipes", "| a |", "| a:thing |", "| a:int (odd) |", "| a:int | b:int (pk) |", "| a:int |\n| 1 |", "| a:int |\n| - |\n| 1 | 2 |"])
def test_bad_drawings(house, bad):
    with pytest.raises(ValueError):
        Table("t", bad)


def test_ensure_and_asserts(house):
    t = Table("book", BOOK)
    t.ensure()
    t.ensure()
    t.assertEqual()
    (t + "| 4 | New | Comic |").update(0, "| 9 | | |")
    Table("book", "\n".join(BOOK.strip().splitlines()[:3])).assertSubset()
    other = Table("book", BOOK.replace("Novel", "Drama"))
    with pytest.raises(AssertionError) as e:
        other.assertEqual()
    assert "E | 2" in str(e.value) and "D | 2" in str(e.value)
    with pytest.raises(AssertionError):
        other.assertSubset()
    with pytest.raises(AssertionError):
        t.assertDisjoint()
    with pytest.raises(AssertionError):
        other.ensure()
    other.reset()
    other.assertEqual()
    other.clear()
    t.assertDisjoint()
    other.drop()
    assert "book" not in house.tables()


def test_constraints(house):
    Table("genre", "| gid:int (pk) | name:text |\n| - | - |\n| 1 | Novel |").ensure()
    Table("b1", "| id:int (pk) | gid:int (fk genre(gid)) |\n| - | - |\n| 1 | 1 |\n| 2 | NULL |").ensure()
    for k, rows in enumerate(["| 1 | 7 |", "| 1 | 1 |\n| 1 | 1 |", "| NULL | 1 |"]):
        with pytest.raises(ValueError):
            Table(f"bad{k}", "| id:int (pk) | gid:int (fk genre(gid)) |\n| - | - |\n" + rows).ensure()


def test_variables(house):
    Table("genre", "| gid:int (pk) | name:text |\n| - | - |\n| 5 | Novel |\n| 6 | Comic |").ensure()
    Table("book2", "| id:int (pk) | gid:int | seen:date |\n| - | - | - |\n| 1 | 5 | NULL |").ensure()
    Table("genre", "| gid:int (pk) | name:text |\n| - | - |\n| $g | Novel |\n| $_ | Comic |").assertEqual()
    Table("book2", "| id:int (pk) | gid:int | seen:date |\n| - | - | - |\n| 1 | $g | $_ |").assertEqual()
    with pytest.raises(AssertionError, match="null"):
        Table("book2", "| id:int (pk) | gid:int | seen:date |\n| - | - | - |\n| 1 | 5 | $_! |").assertEqual()
    with pytest.raises(AssertionError, match="is 5"):
        Table("genre", "| gid:int (pk) | name:text |\n| - | - |\n| $g | Comic |\n| 5 | Novel |").assertEqual()
    with pytest.raises(ValueError):
        Table("genre", "| gid:int (pk) | name:text |\n| - | - |\n| 1 | $_ |").assertEqual()


def test_runner(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "rows.csv").write_text("1,Unknown,Unknown\n2,Nineteen Eighty-Four,Novel\n")
    (tmp_path / "a.dtt").write_text("book\n| bid:int (pk) | title:text | genre:text |\n| - | - | - |\ncsv rows.csv ,\n\nbook, subset\n| bid:int (pk) | title:text | genre:text |\n| - | - | - |\n| 1 | Unknown | Unknown |\n")
    assert main([], spark=spark) == 0
    (tmp_path / "b.dtt").write_text("book, equal\n| bid:int (pk) | title:text | genre:text |\n| - | - | - |\n| 1 | Unknown | Other |\n")
    assert main(["-r"], spark=spark) == 1
    assert "b.dtt, lines 1-4 (after)" in capsys.readouterr().out


def test_align():
    assert align("x\n| a:int | b |\n|-|-|\n| 1 | long cell |\ny", 2).splitlines()[1:4] == ["| a:int | b         |", "| ----- | --------- |", "| 1     | long cell |"]
