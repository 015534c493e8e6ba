"""Keyed state machines on an event-time stream: typed state, late rows, expiry.

Rows wait in the state of their key until the watermark has passed them, so a
key is folded in event time however its rows arrived; rows behind the watermark
are late and dropped.  What is final is folded when rows of the key arrive, or by
a timer at its earliest waiting row; once in a batch, whatever timers are due.
Where a rule surely starts anew after a pause, a second timer clears the state
that long after the last row: keys that fall silent cost nothing.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from operator import attrgetter, itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanloom.streaming.folds import Fold

#: The state store that keeps several typed states and timers per key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys that a task remembers as done in its batch; beyond, a key may be read again.
DONE = 100_000


class ExpiringFold(StatefulProcessor):
    """One fold of ``folds``; ``order[0]`` is the event time in microseconds.

    States: ``saved`` (the fold's own fields and the time of its last row) and
    ``waiting`` (rows that are not final yet).
    """

    def __init__(self, fold: Fold, order: list[str], rows: T.StructType, output: T.StructType):
        self.fold, self.order, self.rows, self.output = fold, order, rows, output
        self.state = T.StructType.fromDDL(f"{fold.state}, last_us long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = self.state.fieldNames()[:-1]
        self.saved = handle.getValueState("saved", self.state)
        self.waiting = handle.getListState("waiting", self.rows)
        self.row, self.out = namedtuple("_Row", self.rows.fieldNames(), rename=True), Row(*self.output.fieldNames())
        self.by = attrgetter(*self.order) if len(self.order) > 1 else lambda r: (getattr(r, self.order[0]),)
        self.done: set[tuple] = set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived, pick = [], None
        for r in rows:
            if pick is None:
                pick = itemgetter(*map(r.__fields__.index, self.rows.fieldNames()), 0)
            arrived.append(self.row(*pick(tuple(r))[:-1]))
        if not arrived:
            return iter([])
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        if any(self.by(r)[0] <= now for r in (*waiting, *arrived)):
            return iter(self._fold(key, waiting + arrived, now))
        self.waiting.appendList([tuple(r) for r in arrived])
        self._at(min(self.by(r)[0] for r in arrived))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if tuple(key) in self.done:
            return iter([])
        return iter(self._fold(key, self._waiting(), timerValues.getCurrentWatermarkInMs() * 1000))

    def _waiting(self) -> list[tuple]:
        return [self.row(*r) for r in self.waiting.get()]

    def _fold(self, key, waiting: list[tuple], now: int) -> list[Row]:
        """Outputs of the rows up to the watermark; the others go on waiting, with one timer for what comes next."""
        by, pause, out = self.by, self.fold.restart_us, []
        final = sorted((r for r in waiting if by(r)[0] <= now), key=by)
        state, last = self.fold.start(), None
        kept = self.saved.get()
        if kept is not None:
            *values, last = kept
            state = dict(zip(self.fields, map(_thawed, values), strict=True))
        for r in final:
            if pause is not None and last is not None and by(r)[0] - last >= pause:
                state = self.fold.start()
            out += [self.out(*key, *o) for o in self.fold.step(state, r)]
            last = by(r)[0]
        rest = [r for r in waiting if by(r)[0] > now] if final else []
        silent = last is not None and pause is not None and now - last >= pause
        if rest:
            self.waiting.put([tuple(r) for r in rest])
            self._at(min(by(r)[0] for r in rest))
        elif final:
            self.waiting.clear()
            if pause is not None and not silent:
                self._at(last + pause)
        if silent:
            self.saved.clear()
        elif final:
            self.saved.update((*(state[f] for f in self.fields), last))
        if len(self.done) >= DONE:
            self.done.clear()
        self.done.add(tuple(key))
        return out

    def _at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def _thawed(value):
    """Nested values of the store as lists and dicts, which the folds change in place."""
    if isinstance(value, T.Row):
        return {k: _thawed(v) for k, v in value.asDict().items()}
    return [_thawed(v) for v in value] if isinstance(value, (list, tuple)) or hasattr(value, "tolist") else value


def follow_expiring(stream: DataFrame, keys: list[str], order: list[str], fold: Fold, time: str, delay: str) -> DataFrame:
    """Outputs of ``fold`` for all rows of ``stream`` that are not late, once they are final.

    ``time`` is the event time (the watermark follows it at ``delay``) and
    ``order[0]`` the same in microseconds.  Runs on the RocksDB state store;
    ``drain`` sets it for its query.
    """
    if not fold.state:
        raise ValueError("the fold has no typed state")
    kept = stream.drop(time).schema
    output = T.StructType([*(kept[k] for k in keys), *T.StructType.fromDDL(fold.out).fields])
    marked = stream.withWatermark(time, delay)
    return marked.groupBy(*keys).transformWithState(ExpiringFold(fold, order, T.StructType([f for f in kept if f.name not in keys]), output), output, "append", "eventTime")
