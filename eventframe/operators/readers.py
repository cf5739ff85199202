"""Entry-at-a-time access and processing by selectors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from eventframe.plans import formula
from eventframe.sources.tables import ENTRY


class Reader:
    """Entries in order, a partition at a time on the driver."""

    def __init__(self, df: DataFrame):
        self.df, self.span = df, None
        self.restart()

    def set_range(self, start: int, stop: int) -> Reader:
        self.span = (start, stop)
        return self.restart()

    def restart(self) -> Reader:
        df = self.df if self.span is None else self.df.where((F.col(ENTRY) >= self.span[0]) & (F.col(ENTRY) < self.span[1]))
        self._rows: Iterator[Row] | None = None
        self._plan, self.current = df.orderBy(ENTRY), None
        return self

    def next(self) -> bool:
        if self._rows is None:
            self._rows = self._plan.toLocalIterator()
        self.current = next(self._rows, None)
        return self.current is not None

    def entry(self, n: int) -> Row | None:
        return self.df.where(F.col(ENTRY) == n).first()

    def __getitem__(self, name: str):
        return self.current[name]

    def __iter__(self) -> Iterator[Row]:
        self.restart()
        while self.next():
            yield self.current


def count_entries(df: DataFrame, selection: str = "") -> int:
    """Entries that pass a formula; where it loops, those with any element that does."""
    return (formula.selected(df, selection) if selection else df).count()


def fold_batches(df: DataFrame, start: Callable[[], object], update: Callable[[object, pd.DataFrame], object], merge: Callable[[object, object], object]) -> object:
    """A user's aggregate: one state per partition from its batches, states merged in order on the driver.

    States should be small: each partition sends one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, seen = start(), False
        for b in batches:
            state, seen = update(state, b), True
        if seen:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    parts = df.mapInPandas(run, "state binary").select(F.spark_partition_id().alias("p"), "state").collect()
    out = start()
    for r in sorted(parts, key=lambda r: r["p"]):
        out = merge(out, pickle.loads(r["state"]))
    return out


class Selector:
    """Begin on the driver, process batches on executors, end on the driver."""

    def begin(self) -> None: ...

    def start(self) -> object:
        return None

    def process(self, state: object, batch: pd.DataFrame) -> object:
        raise NotImplementedError

    def merge(self, a: object, b: object) -> object:
        return b

    def terminate(self, state: object) -> object:
        return state


def process(df: DataFrame, selector: Selector) -> object:
    selector.begin()
    return selector.terminate(fold_batches(df, selector.start, selector.process, selector.merge))
