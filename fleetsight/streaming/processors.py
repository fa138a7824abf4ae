"""Keyed state for streams: live windows and first sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.operators.window_fold import LiveWindow, WindowSpec


class WindowProcessor(StatefulProcessor):
    """State of one (rule, scope, group): its live events and the latest event time seen.

    Rows of a micro-batch are taken in event order. With event-time mode a group that stays
    idle for its window after the watermark is forgotten.
    """

    def __init__(self, specs: list[WindowSpec], forget_idle: bool):
        self.specs = specs
        self.forget_idle = forget_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "ts_ns bigint, seq bigint, value string")
        self.clock = handle.getValueState("clock", "ns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        rule, scope, group = key
        spec = self.specs[rule]
        clock = self.clock.get()
        window = LiveWindow(
            spec,
            [(e[0], e[1], e[2]) for e in self.live.get()] if self.live.exists() else [],
            None if clock is None else clock[0],
        )
        arrived = []
        for batch in rows:
            arrived += zip(
                batch["ts_ns"].tolist(), batch["seq"].tolist(), batch["value"].tolist(), batch["payload"].tolist()
            )
        arrived.sort(key=lambda r: (r[0], r[1]))
        fired = []
        for ns, seq, value, payload in arrived:
            live = window.push(ns, seq, value)
            if live:
                values = list(dict.fromkeys(v for _, _, v in live if v)) if spec.distinct else None
                fired.append(
                    (rule, scope, group, ns, seq, spec.threshold, live[0][0], live[0][1], values, payload)
                )
        self.live.clear()
        if window.events:
            self.live.put(list(window.events))
        self.clock.update((window.clock,))
        if self.forget_idle and spec.window_ns > 0:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((window.clock + spec.window_ns) // 1_000_000 + 1)
        if fired:
            yield pd.DataFrame(fired, columns=FIRE_COLUMNS)

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        self.live.clear()
        self.clock.clear()
        yield from ()

    def close(self) -> None:
        pass


FIRE_COLUMNS = [
    "rule_idx", "scope", "group_key", "ts_ns", "seq", "event_count", "first_ns", "first_seq", "distinct_values",
    "payload",
]


class FirstSeenProcessor(StatefulProcessor):
    """State of one key: first and last time and the number of sightings. Emits the first row."""

    def __init__(self, order: tuple[str, str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first_ns bigint, last_ns bigint, sightings bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.seen.get()
        first_ns, last_ns, sightings = known if known is not None else (None, None, 0)
        earliest = None
        clock = self.order[0]
        for batch in rows:
            sightings += len(batch)
            low, high = int(batch[clock].min()), int(batch[clock].max())
            first_ns = low if first_ns is None else min(first_ns, low)
            last_ns = high if last_ns is None else max(last_ns, high)
            if known is None:
                best = batch.nsmallest(1, self.order)
                both = best if earliest is None else pd.concat([earliest, best])
                earliest = both.nsmallest(1, self.order)
        self.seen.update((first_ns, last_ns, sightings))
        if earliest is not None:
            yield earliest

    def close(self) -> None:
        pass
