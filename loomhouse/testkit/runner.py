"""python -m loomhouse.testkit.runner: run the conditions in .dtt files around an ETL command.

A .dtt file holds drawn tables, one blank line apart.  The line above a drawing names the table,
`name` or `name@warehouse`; with `, equal`, `, disjoint` or `, subset` it is a postcondition.  The
last line may name a reader in place of rows: `csv PATH DELIMITER`, `sql WAREHOUSE QUERY`, or a
function of config.py, called with the column names and the arguments.  config.py, if there,
gives warehouses by name (`connection` by default).
"""

from __future__ import annotations

import argparse
import csv
import importlib.util
import shlex
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from types import ModuleType
from typing import Any

from loomhouse.plans.store import Warehouse

from .drawn import Table

ASSERTS = {"equal": Table.assertEqual, "disjoint": Table.assertDisjoint, "subset": Table.assertSubset}


@dataclass
class Condition:
    path: Path
    lines: tuple[int, int]
    table: Table
    check: str | None


@dataclass
class Source:
    """What a line such as `csv rows.csv ;` below a drawing's head may draw on."""

    columns: list[str]
    folder: Path
    config: ModuleType

    def rows(self, line: str) -> list[dict[str, Any]]:
        word, *args = shlex.split(line)
        if word in READERS:
            return [dict(zip(self.columns, r)) for r in READERS[word](self, *args)]
        return getattr(self.config, word)(self.columns, *args)  # a function of the configuration


def _file(source: Source, path: str, delimiter: str = ",") -> Iterable[Sequence[Any]]:
    with open(source.folder / path, newline="") as lines:
        yield from csv.reader(lines, delimiter=delimiter)


def _query(source: Source, name: str, *words: str) -> Iterable[Sequence[Any]]:
    warehouse: Warehouse = getattr(source.config, name)
    return warehouse.fetchalltuples(warehouse.execute(" ".join(words)))


READERS: dict[str, Callable[..., Iterable[Sequence[Any]]]] = {"csv": _file, "sql": _query}


def paragraphs(text: str):
    """(first line, last line, lines) of each run of lines with content."""
    own: list[str] = []
    for number, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip():
            own.append(line.strip())
        elif own:
            yield number - len(own), number - 1, own
            own = []


def read(path: Path, config: ModuleType, nullsubst: str, prefix: str, failed: list[str]) -> list[Condition]:
    out = []
    for first, last, lines in paragraphs(path.read_text()):
        try:
            name, _, check = (x.strip() for x in lines[0].partition(","))
            name, _, where = name.partition("@")
            if check and check.lower() not in ASSERTS:
                raise ValueError(f"no assert {check}")
            drawn = [x for x in lines[1:] if x.startswith("|")]
            told = [x for x in lines[1:] if not x.startswith("|")]
            if len(told) > 1 or told and lines[-1] != told[0]:
                raise ValueError("one line, the last, may name where rows come from")
            head = [cell.split(":")[0].strip() for cell in drawn[0].strip("|").split("|")]
            rows = Source(head, path.parent, config).rows(told[0]) if told else None
            table = Table(name, "\n".join(drawn), nullsubst, prefix, rows, getattr(config, where or "connection"))
            out.append(Condition(path, (first, last), table, check.lower() or None))
        except Exception as e:  # a bad drawing does not stop the others
            failed.append(f"{path}, lines {first}-{last}: {e}")
    return out


def configuration(folder: Path, make) -> ModuleType:
    if (folder / "config.py").exists():
        spec = importlib.util.spec_from_file_location("config", folder / "config.py")
        config = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(config)
    else:
        config = ModuleType("config")
    if not hasattr(config, "connection"):
        config.connection = make()
    return config


def main(args: list[str] | None = None, spark: Any = None) -> int:
    parser = argparse.ArgumentParser(prog="runner", description="Run tests specified in .dtt files.")
    parser.add_argument("-e", "--etl", nargs="+", metavar="ETL", help="run this command between pre- and postconditions")
    parser.add_argument("-f", "--files", nargs="+", help="use only the conditions in these files")
    parser.add_argument("-n", "--null", default="NULL", help="text of null (default: NULL)")
    parser.add_argument("-p", "--pre", nargs="+", help="use only the preconditions in these files")
    parser.add_argument("-P", "--post", nargs="+", help="use only the postconditions in these files")
    parser.add_argument("-r", "--recursion-off", action="store_true", help="this folder only, no folders below")
    parser.add_argument("-v", "--varprefix", default="$", help="prefix of variables (default: $)")
    got = parser.parse_args(args)

    def warehouse() -> Warehouse:
        from pyspark.sql import SparkSession

        return Warehouse(spark or SparkSession.builder.getOrCreate(), tempfile.mkdtemp(prefix="loomhouse-"))

    here = Path.cwd()
    paths = [Path(f) for f in got.files] if got.files else sorted(here.glob("*.dtt") if got.recursion_off else here.rglob("*.dtt"))
    every = {p.resolve() for p in paths} | {Path(f).resolve() for f in (got.pre or []) + (got.post or [])}
    config = configuration(paths[0].parent if paths else here, warehouse)
    failed: list[str] = []
    found = [c for p in sorted(every) for c in read(p, config, got.null, got.varprefix, failed)]
    wanted = lambda c, only: only is None or c.path in {Path(f).resolve() for f in only}
    for c in found:
        if c.check is None and wanted(c, got.pre):
            try:
                c.table.ensure()
            except Exception as e:
                failed.append(f"{c.path}, lines {c.lines[0]}-{c.lines[1]} (before): {e}")
    if got.etl:
        subprocess.run(" ".join(got.etl), shell=True, check=False)
    for c in found:
        if c.check is not None and wanted(c, got.post):
            try:
                ASSERTS[c.check](c.table)
            except Exception as e:
                failed.append(f"{c.path}, lines {c.lines[0]}-{c.lines[1]} (after): {e}")
    for text in failed:
        print(text)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
