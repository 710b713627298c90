"""Keyed state by transformWithState: source health, retry counts and leases.

Each result is a function of the events seen so far, whatever batches they came in and in whatever
order, so a stream's last row of a key is what the batch twin computes. State is kept in RocksDB (``run``
sets the provider for the start of a query).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _time(t) -> dt.datetime | None:
    return None if t is None or t is pd.NaT else pd.Timestamp(t).to_pydatetime()


HEALTH = "source_id long, last_success timestamp, last_error timestamp, last_error_message string, consecutive_failures long"


class Health(StatefulProcessor):
    """Value state: last success and last error. List state: the failures after the last success, which a success that is later prunes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "good timestamp, good_seq long, bad timestamp, bad_seq long, message string")
        self.open = handle.getListState("open", "ts timestamp, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        good, bad, message = None, None, None
        if self.last.exists():
            a, b, c, d, message = self.last.get()
            good, bad = (None if a is None else (_time(a), b)), (None if c is None else (_time(c), d))
        failed = [(_time(t), s) for t, s in self.open.get()] if self.open.exists() else []
        for part in rows:
            for ts, seq, ok, error in zip(part["ts"], part["seq"], part["ok"], part["error"]):
                at = (_time(ts), int(seq))
                if ok:
                    good = at if good is None else max(good, at)
                else:
                    failed.append(at)
                    if bad is None or at > bad:
                        bad, message = at, error if isinstance(error, str) else "unknown error"
        failed = [x for x in failed if good is None or x > good]
        self.last.update((*(good or (None, None)), *(bad or (None, None)), message))
        if failed:
            self.open.put(failed)
        elif self.open.exists():
            self.open.clear()
        yield pd.DataFrame({"source_id": [key[0]], "last_success": [good and good[0]], "last_error": [bad and bad[0]], "last_error_message": [message], "consecutive_failures": [len(failed)]})

    def close(self) -> None:
        pass


def source_health(events: DataFrame) -> DataFrame:
    """Events (source_id, ts, seq, ok, error) -> health of each source that a batch touched (update mode)."""
    rows = events.select("source_id", "ts", "seq", "ok", "error")
    return rows.groupBy("source_id").transformWithStateInPandas(Health(), HEALTH, "Update", "None")


RETRY = "raw_item_id long, attempts long, dead boolean, reason string, reasons string"


class Retries(StatefulProcessor):
    """Value state: attempts so far and the last one. Map state: attempts by reason. A table of earlier counts can start it."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, ts timestamp, seq long, permanent boolean, reason string")
        self.by_reason = handle.getMapState("by_reason", "reason string", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for n, reason in zip(initialState["attempts"], initialState["reason"]):
            self.last.update((int(n), dt.datetime(1970, 1, 1), -1, False, reason))
            self.by_reason.updateValue((reason or "",), (int(n),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, ts, seq, permanent, reason = self.last.get() if self.last.exists() else (0, None, None, False, None)
        at = None if ts is None else (_time(ts), seq)
        new: dict[str, int] = {}
        for part in rows:
            for t, s, p, r in zip(part["ts"], part["seq"], part["permanent"], part["reason"]):
                n += 1
                new[r or ""] = new.get(r or "", 0) + 1
                if at is None or (_time(t), int(s)) > at:
                    at, permanent, reason = (_time(t), int(s)), bool(p), r
        for r, k in new.items():
            had = self.by_reason.getValue((r,))[0] if self.by_reason.containsKey((r,)) else 0
            self.by_reason.updateValue((r,), (had + k,))
        self.last.update((n, *at, permanent, reason))
        counts = ",".join(f"{k[0]}:{v[0]}" for k, v in sorted(self.by_reason.iterator()))
        yield pd.DataFrame({"raw_item_id": [key[0]], "attempts": [n], "dead": [permanent or n >= self.max_attempts], "reason": [reason], "reasons": [counts]})

    def close(self) -> None:
        pass


def retry_counts(attempts: DataFrame, *, max_attempts: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Attempts (raw_item_id, ts, seq, permanent, reason) of each item after each batch; dead at the ceiling or by a final reason.

    ``known`` (raw_item_id, attempts, reason): counts to start from.
    """
    rows = attempts.select("raw_item_id", "ts", "seq", "permanent", "reason")
    start = known.select("raw_item_id", "attempts", "reason").groupBy("raw_item_id") if known is not None else None
    return rows.groupBy("raw_item_id").transformWithStateInPandas(Retries(max_attempts), RETRY, "Update", "None", start)


LEASE = "dispatch_id long, event string, at timestamp"


class Leases(StatefulProcessor):
    """Value state: when the open claim was made. An event-time timer ends a claim that nothing has answered."""

    def __init__(self, seconds: float):
        self.span = dt.timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claimed = handle.getValueState("claimed", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        claimed = _time(self.claimed.get()[0]) if self.claimed.exists() else None
        before = claimed
        out: list[tuple] = []
        events = sorted((_time(t), e) for part in rows for t, e in zip(part["ts"], part["event"]))
        for ts, event in events:
            if claimed is not None and ts > claimed + self.span:
                out.append(("expired", claimed + self.span))
                claimed = None
            out.append((event, ts))
            claimed = ts if event == "claimed" else None
        if claimed != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if claimed is None:
                self.claimed.clear()
            else:
                self.claimed.update((claimed,))
                self.handle.registerTimer(int((claimed + self.span).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
        yield pd.DataFrame({"dispatch_id": [key[0]] * len(out), "event": [e for e, _ in out], "at": [t for _, t in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        claimed = _time(self.claimed.get()[0])
        self.claimed.clear()
        yield pd.DataFrame({"dispatch_id": [key[0]], "event": ["expired"], "at": [claimed + self.span]})

    def close(self) -> None:
        pass


def lease_expiry(events: DataFrame, *, minutes: float = 15, late: str = "1 minute") -> DataFrame:
    """Events (dispatch_id, ts, event: claimed, sent or failed) -> the same and ``expired`` for each claim that has no answer in its time (append mode).

    Time is that of the events: a claim without any later event ends when the watermark, ``late`` behind the newest event, passes its end.
    The session's time zone must be UTC.
    """
    rows = events.select("dispatch_id", "ts", "event").withWatermark("ts", late)
    return rows.groupBy("dispatch_id").transformWithStateInPandas(Leases(minutes * 60), LEASE, "Append", "EventTime")
