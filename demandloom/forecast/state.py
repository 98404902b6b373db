"""Window features of one series, advanced a period at a time.

A recursive forecast needs the features of the next period after every step. The state keeps what they look at: a ring
of the last values, as long as the widest window; an accumulator for each exponential mean; sums before and from the
event day. A step costs the same whatever the length of the history. On known history the features equal those of
``create_features`` and ``exploratory_features`` with differences as known before the period.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_NAME = re.compile(r"^(Lag|Roll_Mean|Roll_Std|Roll_Q95|EWMA|Diff)_(\d+)$")
ACCELERATION, TREND = "Accel_2", "Recent_vs_Old_Trend"
# Surge columns and the cap of each.
SURGES = {"Post_Rebrand_Surge_Ratio": math.inf, "Rebrand_Surge": 2.0}
NAMED_SURGE = "Item_Surge"


def is_window(name: str) -> bool:
    return bool(_NAME.match(name)) or name in (ACCELERATION, TREND, NAMED_SURGE, *SURGES)


@dataclass(frozen=True)
class StatePlan:
    """Which window features a model wants, and what they depend on."""

    names: tuple[str, ...]
    event_date: str
    # Lengths of the recent and the older window of the trend, and its cap.
    trend: tuple[int, int, float] = (4, 12, 10.0)
    surge_item: str | None = None
    surge_cap: float = 3.0
    surge_days: int = 140
    surge_floor: float = 0.3

    @staticmethod
    def of(columns: Sequence[str], event_date: str, **more) -> StatePlan:
        return StatePlan(tuple(c for c in columns if is_window(c)), event_date, **more)

    @property
    def reach(self) -> int:
        """How many past values the widest window sees."""
        found = [3, *([self.trend[0] + self.trend[1]] if TREND in self.names else [])]
        for name in self.names:
            kind = _NAME.match(name)
            if kind:
                found.append(int(kind[2]) + (kind[1] == "Diff"))
        return max(found)


class SeriesState:
    """What is known of a series before its next period."""

    def __init__(self, plan: StatePlan, item: str, days: Sequence[dt.date] = (), values: Sequence[float] = (),
                 event_sums: tuple[float, int, float, int] | None = None):
        """``event_sums`` (sum and count before the event and from it on) stand for those of the given values, if given."""
        self.plan, self.item = plan, item
        self.event = dt.date.fromisoformat(plan.event_date)
        self.ring, self.count = np.zeros(plan.reach), 0
        self.means = {name: 0.0 for name in plan.names if name.startswith("EWMA_")}
        self.decay = {name: 1 - 2.0 / (int(name[5:]) + 1) for name in self.means}
        self.fixed = event_sums is not None
        self.sums = list(event_sums or (0.0, 0, 0.0, 0))
        self.steps = [self._step(name) for name in plan.names]
        for day, value in zip(days, values):
            self.push(day, value)

    def push(self, day: dt.date, value: float) -> None:
        """The period's value is known now."""
        for name, d in self.decay.items():
            self.means[name] = d * self.means[name] + (1 - d) * value if self.count else value
        self.ring[self.count % len(self.ring)] = value
        self.count += 1
        if not self.fixed:
            side = 0 if day < self.event else 2
            self.sums[side] += value
            self.sums[side + 1] += 1

    def features(self, day: dt.date) -> np.ndarray:
        """The plan's features of ``day``, in its order; what isn't defined yet is 0."""
        held = min(self.count, len(self.ring))
        last = np.take(self.ring, range(self.count - held, self.count), mode="wrap")
        return np.array([step(last, day) for step in self.steps])

    def surge(self) -> float | None:
        """Mean since the event over the mean before it plus one; 1 without the former, None without the latter."""
        before, n_before, since, n_since = self.sums
        if not n_since:
            return 1.0
        return since / n_since / (before / n_before + 1) if n_before else None

    def _step(self, name: str):
        kind = _NAME.match(name)
        n = int(kind[2]) if kind else 0
        recent, older, cap = self.plan.trend

        def acceleration(x, _):
            return x[-1] - 2 * x[-2] + x[-3] if len(x) > 2 else 0.0

        def trend(x, _):
            if len(x) < recent + older:
                return 0.0
            ratio = x[-recent:].mean() / (x[-recent - older:-recent].mean() + 1)
            return min(max(ratio, 0.0), cap)

        def surge(_, day):
            found = self.surge()
            return 0.0 if found is None else min(found, SURGES[name])

        def named_surge(_, day):
            active = self.item == self.plan.surge_item and day >= self.event and self.sums[1] and self.sums[3]
            fade = max(self.plan.surge_floor, 1 - (day - self.event).days / self.plan.surge_days)
            return min(self.surge(), self.plan.surge_cap) * fade if active else 1.0

        def quantile(x, _):
            return float(np.quantile(x[-n:], 0.95)) if len(x) else 0.0

        return {
            "Lag": lambda x, _: x[-n] if len(x) >= n else 0.0,
            "Roll_Mean": lambda x, _: x[-n:].mean() if len(x) else 0.0,
            "Roll_Std": lambda x, _: x[-n:].std(ddof=1) if min(n, len(x)) > 1 else 0.0,
            "Roll_Q95": quantile,
            "EWMA": lambda x, _: self.means[name],
            "Diff": lambda x, _: x[-1] - x[-1 - n] if len(x) > n else 0.0,
            ACCELERATION: acceleration, TREND: trend, NAMED_SURGE: named_surge,
        }.get(kind[1] if kind else name, surge)
