"""Volumes and commitments that arrive piece by piece, with the states of keys in the state store and timers for what does not come.

Keys are dealt to buckets, whose states are read and written as one: each call of the state store from Python takes longer than a key's work.

Queries need the RocksDB state store (``STATE_STORE``) and a watermark on ``at``; time is the time of the events.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

VOLUME_EVENTS = "volume string, event string, slice int, layer int, received int, total int, fraction double"
COMMITMENT_EVENTS = "transaction string, instance string, status string, reason int"
#: Buckets of keys; a batch reads and writes the states of those that it has rows for. A stream keeps the number that its checkpoint began with.
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> None:
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


class _Held(StatefulProcessor):
    """The states of a bucket's keys in one value, and one timer, at the time when the first of them is forgotten: a bucket is one call of Python
    a batch, and a few of the state store, whatever keys it has. ``add`` and ``expired`` work on a dictionary of the states, of which ``until`` is the first part."""

    kinds = ""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer bigint, content binary")

    def close(self) -> None:
        pass

    def add(self, held: dict, frames: list[pd.DataFrame], now_ms: int) -> list[tuple]:
        raise NotImplementedError

    def expired(self, key: str | None, state: tuple) -> list[tuple]:
        raise NotImplementedError

    def _load(self) -> tuple[int | None, dict]:
        if not self.held.exists():
            return None, {}
        timer, content = self.held.get()
        return timer, pickle.loads(bytes(content))

    def _store(self, before: int | None, held: dict) -> None:
        timer = min((state[0] for state in held.values()), default=None)
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is None:
            self.held.clear()
            return
        if before != timer:
            self.handle.registerTimer(timer)
        self.held.update((timer, pickle.dumps(held, pickle.HIGHEST_PROTOCOL)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._load()
        out = self.add(held, list(rows), timerValues.getCurrentWatermarkInMs())
        self._store(timer, held)
        yield _frame(out, self.kinds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, held = self._load()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        out = []
        for k in [k for k, state in held.items() if state[0] <= fired or state[0] < now]:
            out += self.expired(k, held.pop(k))
        # Spark takes the timer that fired away itself.
        self._store(None if timer == fired else timer, held)
        yield _frame(out, self.kinds)


def _times(frame: pd.DataFrame) -> list[int]:
    """``at`` in nanoseconds."""
    return pd.to_datetime(frame["at"]).to_numpy("datetime64[ns]").astype("int64").tolist()


class _Volumes(_Held):
    """A volume's state is (until, received, total, the highest layer of each slice); what is no higher than what is there tells nothing new."""

    kinds = VOLUME_EVENTS

    def add(self, held: dict, frames: list[pd.DataFrame], now_ms: int) -> list[tuple]:
        events = []
        for frame in frames:
            events += zip(frame["volume"].tolist(), _times(frame), frame["layer"].tolist(), frame["slice"].tolist(), frame["total"].tolist(), strict=True)
        out = []
        for key, at, layer, place, told in sorted(events, key=lambda e: e[1:]):
            layer, place, told = int(layer), int(place), int(told)
            _, received, total, layers = held.get(key) or (0, 0, 0, {})
            total = max(total, told)
            before = layers.get(place)
            if before is None or before < layer:
                layers[place] = layer
                received += before is None
                out.append((key, "slice" if before is None else "refined", place, layer, received, total, received / total))
                if before is None and received == total:
                    out.append((key, "complete", None, None, received, total, 1.0))
            held[key] = (max(at // 1_000_000, now_ms) + self.patience_ms, received, total, layers)
        return out

    def expired(self, key: str | None, state: tuple) -> list[tuple]:
        _, received, total, _ = state
        return [(key, "expired", None, None, received, total, received / total)] if received < total else []


class _Commitments(_Held):
    """A transaction's state is (until, the request's instances, the report's reasons), each of these null before it comes and empty when both came;
    what a report leaves out is missing. A report may come first."""

    kinds = COMMITMENT_EVENTS

    def add(self, held: dict, frames: list[pd.DataFrame], now_ms: int) -> list[tuple]:
        messages = []
        for frame in frames:
            messages += zip(frame["transaction"].tolist(), _times(frame), *(frame[c].tolist() for c in ("kind", "instances", "failed", "reasons")), strict=True)
        out = []
        for key, at, kind, instances, failed, reasons in sorted(messages, key=lambda m: m[1]):
            _, wanted, told = held.get(key) or (0, None, None)
            new = False
            if kind == "request" and wanted is None:
                wanted, new = tuple(dict.fromkeys(instances)), True
            elif kind == "report" and told is None:
                told, new = dict.fromkeys(instances, 0) | {i: int(r) for i, r in zip(failed, reasons, strict=True)}, True
            if new and wanted is not None and told is not None:
                for i in wanted:
                    reason = told.get(i)
                    out.append((key, i, "missing" if reason is None else "failed" if reason else "committed", reason or None))
                # The key stays until its time is over, so that what is sent again is known.
                wanted, told = (), {}
            held[key] = (max(at // 1_000_000, now_ms) + self.patience_ms, wanted, told)
        return out

    def expired(self, key: str | None, state: tuple) -> list[tuple]:
        _, wanted, told = state
        return [(key, i, "expired", None) for i in wanted or ()] if told is None else []


def _frame(rows: list[tuple], kinds: str) -> pd.DataFrame:
    names = [part.split() for part in kinds.split(", ")]
    types = {"string": "object", "int": "Int32", "double": "float64"}
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=types[kind]) for i, (name, kind) in enumerate(names)})


def _bucketed(rows: DataFrame, key: str, buckets: int) -> GroupedData:
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("__bucket")


def volume_progress(arrivals: DataFrame, patience: float = 600.0, buckets: int = BUCKETS) -> DataFrame:
    """Arrivals (volume, slice, layer, total, at), with a watermark on ``at``, to the events of each volume: ``VOLUME_EVENTS``.

    A slice's first layer is ``slice``, a higher one ``refined``; layers that come again, or after a higher one, say nothing. When all
    ``total`` slices are there the volume is ``complete``, whatever layers follow; ``patience`` seconds after its last arrival it is
    forgotten, and ``expired`` if slices lacked.
    """
    return _bucketed(arrivals, "volume", buckets).transformWithStateInPandas(_Volumes(int(patience * 1000)), VOLUME_EVENTS, "append", "eventTime")


def commitments(messages: DataFrame, patience: float = 86_400.0, buckets: int = BUCKETS) -> DataFrame:
    """Messages (transaction, kind, instances, failed, reasons, at) to what becomes of each requested instance: ``COMMITMENT_EVENTS``.

    ``kind`` is ``request`` or ``report``; a report lists committed ``instances``, and ``failed`` ones with their ``reasons``. Either may come first, and
    messages of a kind after the first count nothing. What a report does not name is ``missing``; without one for ``patience`` seconds the
    request's instances are ``expired``.
    """
    return _bucketed(messages, "transaction", buckets).transformWithStateInPandas(_Commitments(int(patience * 1000)), COMMITMENT_EVENTS, "append", "eventTime")


class Progress(StreamingQueryListener):
    """Keeps, for each query, how many rows its batches have read, in their order."""

    def __init__(self) -> None:
        self.batches: dict[str, list[tuple[int, int]]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:
        self.batches.setdefault(str(event.progress.id), []).append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
