from loomhouse import api
from loomhouse.plans.store import definequote, quoted
from loomhouse.testkit.align import main


def test_names_are_there():
    assert {"Dimension", "SlowlyChangingDimension", "SnowflakedDimension", "CSVSource", "UnionSource", "ConnectionWrapper", "splitpoint", "FIFODict", "Sum"} <= set(api.__all__)


def test_fifo():
    gone = []
    held = api.FIFODict(2, lambda k, v: gone.append((k, v)))
    held["a"], held["b"], held["a"], held["c"] = 1, 2, 3, 4
    assert gone == [("a", 3)] and list(held) == ["b", "c"] and "a" not in held and held.get("a", 0) == 0 and held["c"] == 4 and len(held) == 2
    del held["b"]
    held.clear()
    assert str(held) == "{}"


def test_quotes():
    assert quoted("a") == "`a`"
    definequote('"')
    assert quoted("a") == '"a"'
    definequote(("[", "]"))
    assert quoted("a") == "[a]"
    definequote("`")


def test_align_in_place(tmp_path):
    path = tmp_path / "x.dtt"
    path.write_text("t\n| a:int | b:text |\n| - | - |\n| 1 | long text |\n")
    assert main([str(path), "2"]) == 0 and main([]) == 1
    assert path.read_text().splitlines()[3] == "| 1     | long text |"
