"""The health and the last events of crawls as streams, with state per crawl. Their batch twins are crawling.crawl_health and telemetry.last_events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Sessions that run these streams need this state store (its provider keeps lists and timers).
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

HEALTH = "state string, last_error string, last_error_url string, pages long, skips long, last_page string"
_START = ("running", None, None, 0, 0, None)


def fold_health(now: tuple, events: Iterator[tuple]) -> tuple:
    """now: a value of HEALTH; events: (kind, url, detail) in order."""
    state, error, error_url, pages, skips, last_page = now
    for kind, url, detail in events:
        if kind == "start":
            state, error, error_url, pages, skips, last_page = _START
        elif kind == "page":
            state, error, error_url, pages, last_page = "healthy", None, None, pages + 1, url
        elif kind == "skip":
            skips += 1
        elif kind == "error":
            state, error, error_url = "degraded", detail, url
        elif kind == "failed":
            state = "degraded"
        elif kind == "finished" and state != "degraded":
            state = "healthy"
    return state, error, error_url, pages, skips, last_page


def _in_order(rows: Iterator[pd.DataFrame], after: int | None) -> pd.DataFrame:
    """A key's rows of a batch, in order; those at or before what was folded already (a source that sent them again) go."""
    every = pd.concat(list(rows))
    every = every[every["place"] > (-(1 << 62) if after is None else after)]
    return every.sort_values(["place", "kind", "url", "detail"], na_position="first")


class HealthProcessor(StatefulProcessor):
    """Health in a value state. With keep_ms, a finish sets a timer; if nothing follows until it rings, the state goes, and a later event finds the crawl
    idle."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("health", f"{HEALTH}, place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.now.get() if self.now.exists() else None
        events = _in_order(rows, None if held is None else held[6])
        if not len(events):
            return
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        clean = events[["kind", "url", "detail"]].astype(object).where(events[["kind", "url", "detail"]].notna(), None)
        state = fold_health(tuple(held[:6]) if held is not None else ("idle", None, None, 0, 0, None), clean.itertuples(index=False, name=None))
        self.now.update((*state, int(events["place"].iloc[-1])))
        if self.keep_ms is not None and events["kind"].iloc[-1] in ("finished", "failed"):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        names = [c.split()[0] for c in HEALTH.split(", ")]
        yield pd.DataFrame([(key[0], int(events["place"].iloc[-1]), *state)], columns=["crawl", "place", *names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def crawl_health(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(crawl, place, HEALTH) of each crawl that had events in a batch, after the last of them, for update mode. events: crawl, place, kind, url, detail as
    crawling.crawl_health takes them; events of one crawl come in ascending place over the batches.

    With keep_ms the state of a crawl goes that long after its finish. Such a stream goes on looking for timers, so it does not end by itself under an
    availableNow trigger.
    """
    rows = events.select("crawl", "place", "kind", "url", "detail")
    return rows.groupBy("crawl").transformWithStateInPandas(HealthProcessor(keep_ms), f"crawl string, place long, {HEALTH}", "Update", "None" if keep_ms is None else "ProcessingTime")


class TailProcessor(StatefulProcessor):
    """The last events of a crawl in a list state that never holds more than size of them."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getListState("events", "place long, kind string, url string, detail string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = list(self.list.get()) if self.list.exists() else []
        events = _in_order(rows, held[-1][0] if held else None)[["place", "kind", "url", "detail"]].tail(self.size)
        if not len(events):
            return
        clean = events.astype(object).where(events.notna(), None)
        now = [*held, *clean.itertuples(index=False, name=None)][-self.size :]
        now = [(int(p), k, u, d) for p, k, u, d in now]
        self.list.put(now)
        yield pd.DataFrame([(key[0], *x) for x in now], columns=["crawl", "place", "kind", "url", "detail"])

    def close(self) -> None:
        pass


def last_events(events: DataFrame, size: int = 200) -> DataFrame:
    """The last size events of each crawl that had new ones in a batch, whole, for update mode. Columns and order as in crawl_health."""
    rows = events.select("crawl", "place", "kind", "url", "detail")
    return rows.groupBy("crawl").transformWithStateInPandas(TailProcessor(size), "crawl string, place long, kind string, url string, detail string", "Update", "None")
