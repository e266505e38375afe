"""Report date tokens, resolved once against a stated day."""

from __future__ import annotations

import re
from datetime import date, timedelta

#: The relative tokens, as a pattern and what its number takes off the day.
#: "7d" names the first day of a window of seven days, so today is one of them.
_OFFSETS = (
    (r"(today)", lambda n: 0),
    (r"(yesterday)", lambda n: 1),
    (r"([0-9]+)d", lambda n: max(n - 1, 0)),
    (r"([0-9]+)d(?:ays)?ago", lambda n: n),
)


def resolve_day(token: str, as_of: date) -> date:
    """The day that an ISO date or a relative token means on the day ``as_of``."""
    text = str(token).strip().lower()
    for pattern, days_back in _OFFSETS:
        if found := re.fullmatch(pattern, text):
            number = int(found[1]) if found[1].isdigit() else 0
            return as_of - timedelta(days=days_back(number))
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{token!r} is no report day") from None


def resolve_window(start: str, end: str, as_of: date) -> tuple[date, date]:
    """Both ends of a window, in order."""
    window = resolve_day(start, as_of), resolve_day(end, as_of)
    if window != tuple(sorted(window)):
        raise ValueError(f"{start!r} is after {end!r}")
    return window
