"""Refreshes that arrive page by page: staged in keyed state, promoted whole or not at all.

The key is a collection. Its pages wait in state until a refresh has its terminal page and no hole before it; then its members
become the collection's, and members of the refresh promoted before that are not among them are retired. A
refresh that stays incomplete until its timer expires leaves the state and retires nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.pipelines import changes, drain, kept, landings

OUTCOMES = "collection long, epoch int, pages int, outcome string, added int, kept int, retired int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def keyed_state(spark: SparkSession):
    """While it holds, streams that start keep their state in RocksDB, which composite state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Refreshes(StatefulProcessor):
    """Rows (collection, epoch, page, terminal, member): epoch is the day of a refresh, a page has a row for each member."""

    def __init__(self, patience_days: int):
        self.patience = patience_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.staged = handle.getMapState("staged", "epoch int, page int, member string", "terminal boolean")
        self.promoted = handle.getValueState("promoted", "epoch int, members array<string>")

    def _held(self) -> dict[tuple[int, int, str], bool]:
        """What is staged; only refreshes that are neither promoted nor expired are held."""
        return {tuple(key): terminal for key, (terminal,) in self.staged.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a round trip to the JVM: it is read once, refreshes that come whole never enter it, and only what changed is written
        held = self._held()
        staged, came = dict(held), set()
        for frame in rows:
            for epoch, page, terminal, member in zip(frame["epoch"], frame["page"], frame["terminal"], frame["member"]):
                came.add(int(epoch))
                staged[int(epoch), int(page), str(member)] = bool(terminal)
        refreshes: dict[int, dict[int, tuple[bool, set[str]]]] = {}
        for (epoch, page, member), terminal in staged.items():
            ends, members = refreshes.setdefault(epoch, {}).setdefault(page, (False, set()))
            members.add(member)
            refreshes[epoch][page] = (ends or terminal, members)
        newest, before = self.promoted.get() if self.promoted.exists() else (None, [])
        out, whole, now, changed = [], set(), set(before or []), False
        for epoch, pages in sorted(refreshes.items()):
            last = max(pages)
            ends = [page for page, (terminal, _) in pages.items() if terminal]
            if ends != [last] or len(pages) != last + 1:
                continue
            whole.add(epoch)
            if newest is not None and newest >= epoch:
                out.append((key[0], epoch, len(pages), "stale", 0, 0, 0))
                continue
            members = set().union(*(m for _, m in pages.values()))
            out.append((key[0], epoch, len(pages), "promoted", len(members - now), len(members & now), len(now - members)))
            newest, now, changed = epoch, members, True
        if changed:
            self.promoted.update((newest, sorted(now)))
        for at, terminal in staged.items():
            if at[0] in whole:
                if at in held:
                    self.staged.removeKey(at)
            elif held.get(at) is not terminal:
                self.staged.updateValue(at, (terminal,))
        for epoch in came - whole:
            self.handle.registerTimer((epoch + self.patience) * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        epoch = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - self.patience
        gone = [at for at in self._held() if at[0] == epoch]
        if gone:
            for at in gone:
                self.staged.removeKey(at)
            yield pd.DataFrame([(key[0], epoch, len({page for _, page, _ in gone}), "expired", 0, 0, 0)], columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def refresh(rows: DataFrame, path: str, patience_days: int = 2, late: str = "1 day") -> None:
    """Takes up what has newly landed below path/landed: rows like these (collection, ts, epoch, page, terminal, member)."""
    stream = landings(rows, f"{path}/landed").withWatermark("ts", late)
    with keyed_state(rows.sparkSession):
        out = stream.groupBy("collection").transformWithStateInPandas(Refreshes(patience_days), OUTCOMES, "Append", "EventTime")
        drain(out.writeStream.outputMode("append").foreachBatch(changes(path)), path)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What became of each refresh so far; those still staged are not among them."""
    return kept(spark, path, OUTCOMES).drop("batch")
