"""Durations written as text, such as ``5m``, ``1h30m`` or ``100ms``."""

from __future__ import annotations

import re

# Unit suffixes in nanoseconds.
UNITS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)")


def duration_ns(text: str | int | None) -> int:
    """Nanoseconds of a duration text; integers are taken as nanoseconds already."""
    if text is None or text == "":
        return 0
    if isinstance(text, int):
        return text
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body == "0":
        return 0
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for number, unit in parts:
        whole, _, fraction = number.partition(".")
        total += int(whole) * UNITS[unit]
        if fraction:
            total += int(fraction) * UNITS[unit] // 10 ** len(fraction)
    return sign * total
