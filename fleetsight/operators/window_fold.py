"""The per-slice fold behind window correlations.

A rule fires on an event when the live events of its group reach the threshold, and the group
is then emptied. For an event ``i`` let ``s(i)`` be the latest event such that ``[s(i), i]``
alone reaches the threshold. Whether ``i`` fires depends on earlier history only through the
last fire ``r``: it fires when ``r < s(i)``. A slice can therefore be folded without knowing
``r``, by following every distinguishable entry value of ``r`` at once. Entry values that make
the same event fire have the same future and are merged, so one pass is enough and the number
of histories followed only shrinks.

Positions are (nanoseconds, sequence, ordinal among equal pairs).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple


@dataclass(frozen=True)
class WindowSpec:
    window_ns: int
    threshold: int
    max_events: int
    distinct: bool

    @property
    def reach(self) -> int:
        """Most events an interval ``[s(i), i]`` can span; 0 means no bound."""
        return self.max_events if self.distinct else self.threshold


class History(NamedTuple):
    """Entry values ``first..last`` (cyclic) that share the last fire at index ``fired``."""

    fired: int
    first: int
    last: int


class Fire(NamedTuple):
    position: tuple
    live_from: tuple
    values: list | None
    entry_from: tuple | None
    entry_to: tuple | None
    wraps: bool


class SliceFold:
    """Feed rows of one (key, slice) in order, carried rows first."""

    def __init__(self, spec: WindowSpec):
        self.spec = spec
        self.rows: deque = deque()
        self.base = 0
        self.next_index = 0
        self.recent: dict = {}
        self.bounds: list = []
        self.histories: deque | None = None
        self.first_own = 0
        self.previous = None
        self.fired = False

    def push(self, ns: int, seq: int, value, carried: bool) -> list[Fire]:
        ordinal = 0
        if self.previous is not None and self.previous[0] == ns and self.previous[1] == seq:
            ordinal = self.previous[2] + 1
        position = self.previous = (ns, seq, ordinal)
        if not carried and self.histories is None:
            self._open()
        index = self.next_index
        self.next_index += 1
        self.rows.append((position, value))
        self._expire(index, ns)
        if self.spec.distinct and value:
            self.recent.pop(value, None)
            self.recent[value] = index
            if len(self.recent) > self.spec.threshold:
                del self.recent[next(iter(self.recent))]
        if carried:
            return []
        start = self._interval_start(index)
        if start is None or start < self.base:
            return []
        return self._fire(index, position, start)

    def exits(self) -> list[Fire]:
        """Last fires at the end of the slice with the entry values that lead to them."""
        if not self.fired:
            return []
        out = []
        for h in self.histories:
            if h.fired >= self.first_own:
                out.append(self._conditional(self.last_fire[h.fired], None, None, h))
        return out

    def _open(self):
        """Entry values: no relevant fire, or a fire at one of the carried rows in reach."""
        self.first_own = self.next_index
        in_reach = list(self.rows)
        if self.spec.reach > 0:
            in_reach = in_reach[-(self.spec.reach - 1):] if self.spec.reach > 1 else []
        self.bounds = [position for position, _ in in_reach]
        start = self.first_own - len(in_reach)
        self.histories = deque([History(-1, 0, 0)])
        for n in range(len(in_reach)):
            self.histories.append(History(start + n, n + 1, n + 1))
        self.last_fire: dict = {}

    def _expire(self, index: int, now: int):
        spec = self.spec
        while self.rows:
            too_old = spec.window_ns > 0 and now - self.rows[0][0][0] > spec.window_ns
            beyond_cap = spec.max_events > 0 and index - self.base >= spec.max_events
            if not (too_old or beyond_cap):
                break
            self.rows.popleft()
            self.base += 1

    def _interval_start(self, index: int):
        threshold = self.spec.threshold
        if not self.spec.distinct:
            return index - threshold + 1
        if len(self.recent) < threshold:
            return None
        return next(islice(reversed(self.recent.values()), threshold - 1, None))

    def _fire(self, index: int, position: tuple, start: int) -> list[Fire]:
        out = []
        first = last = None
        while self.histories and self.histories[0].fired < start:
            history = self.histories.popleft()
            live_from = max(history.fired + 1, self.base)
            values = self._values_from(live_from) if self.spec.distinct else None
            if not self.spec.distinct:
                live_from = start
            live = self.rows[live_from - self.base][0]
            out.append(self._conditional(position, live, values, history))
            first = history.first if first is None else first
            last = history.last
        if out:
            self.fired = True
            self.histories.append(History(index, first, last))
            self.last_fire[index] = position
            if len(self.last_fire) > 2 * len(self.histories) + 16:
                kept = {h.fired for h in self.histories}
                self.last_fire = {i: p for i, p in self.last_fire.items() if i in kept}
        return out

    def _values_from(self, live_from: int) -> list:
        """Distinct non-empty values of the live rows in order of first appearance."""
        seen: dict = {}
        for _, value in islice(self.rows, live_from - self.base, None):
            if value:
                seen.setdefault(value)
                if len(seen) == self.spec.threshold:
                    break
        return list(seen)

    def _conditional(self, position, live_from, values, history: History) -> Fire:
        entries = len(self.bounds) + 1
        every = (history.last - history.first) % entries == entries - 1
        if every:
            return Fire(position, live_from, values, None, None, False)
        lower = self.bounds[history.first - 1] if history.first > 0 else None
        upper = self.bounds[history.last] if history.last < len(self.bounds) else None
        return Fire(position, live_from, values, lower, upper, history.first > history.last)


def entry_applies(entry: tuple | None, lower: tuple | None, upper: tuple | None, wraps: bool) -> bool:
    """Whether the last fire before a slice lies in the entry range of a conditional fire."""
    at_least = lower is None or (entry is not None and entry >= lower)
    below = upper is None or entry is None or entry < upper
    return (at_least or below) if wraps else (at_least and below)


class LiveWindow:
    """The same window with known history, for keyed state in streams."""

    def __init__(self, spec: WindowSpec, events=(), clock: int | None = None):
        self.spec = spec
        self.events = deque(events)
        self.clock = clock

    def push(self, ns: int, seq: int, value) -> tuple | None:
        """(live events) when the rule fires on this event, else None."""
        spec = self.spec
        self.clock = ns if self.clock is None else max(self.clock, ns)
        if spec.window_ns > 0 and self.clock - ns > spec.window_ns:
            self._prune()
            return None
        self.events.append((ns, seq, value))
        self._prune()
        if spec.distinct:
            count = len({v for _, _, v in self.events if v})
        else:
            count = len(self.events)
        if count < spec.threshold:
            return None
        live = tuple(self.events)
        self.events.clear()
        return live

    def _prune(self):
        spec = self.spec
        if spec.window_ns > 0:
            self.events = deque(e for e in self.events if self.clock - e[0] <= spec.window_ns)
        while spec.max_events > 0 and len(self.events) > spec.max_events:
            self.events.popleft()
