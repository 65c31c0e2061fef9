"""Splitpoints and flows: functions of DataFrames that Spark pipelines and runs in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

_splits: list[DataFrame] = []


def splitpoint(*own: Callable, instances: int = 0, output: list | None = None, queuesize: int = 0) -> Callable:
    """A decorator for f(df, ...) -> df: `instances` is the number of partitions that its rows are dealt to first.

    The results go to `output`, if given, and count as open until endsplits.
    """

    def wrap(f: Callable) -> Callable:
        def call(df: DataFrame, *args: Any, **named: Any) -> DataFrame:
            out = f(df.repartition(instances) if instances > 1 else df, *args, **named)
            if isinstance(out, DataFrame):
                _splits.append(out)
                if output is not None:
                    output.append(out)
            return out

        return call

    return wrap(own[0]) if own else wrap


def endsplits() -> None:
    """Run everything that splitpoints have made and nobody has used."""
    while _splits:
        _splits.pop(0).write.format("noop").mode("overwrite").save()


class Flow:
    """A chain of functions of DataFrames; several in a list are one step of it."""

    def __init__(self, functions: Iterable[Any]):
        self.functions = [f for g in functions for f in (g if isinstance(g, (list, tuple)) else [g])]
        self.done: list[DataFrame] = []
        self.closed = False

    def process(self, df: DataFrame) -> None:
        if self.closed:
            raise ValueError("the flow is closed")
        self.done.append(reduce(lambda d, f: (lambda out: d if out is None else out)(f(d)), self.functions, df))

    __call__ = process

    def get(self) -> DataFrame:
        return self.done.pop(0)

    def getall(self) -> DataFrame:
        out = reduce(lambda a, b: a.unionByName(b), self.done)
        self.done = []
        return out

    def __iter__(self):
        while self.done:
            yield self.get()

    def close(self) -> None:
        self.closed = True

    def join(self) -> None:
        for df in self.done:
            df.write.format("noop").mode("overwrite").save()

    @property
    def finished(self) -> bool:
        return self.closed and not self.done


def createflow(*functions: Any, batchsize: int = 25, queuesize: int = 0) -> Flow:
    return Flow(functions)


def shareconnectionwrapper(targetconnection: Any, maxclients: int = 10, userfuncs: tuple = ()) -> Any:
    """The warehouse itself: the driver is the only one that commits."""
    return targetconnection
