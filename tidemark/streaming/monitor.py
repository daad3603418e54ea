"""The alarm as a stream: a trailing mean and a hysteresis latch per unit, which only look back.

An addition of this library; in batch the same is `windows.trailing` and `windows.latch`. Rows of a unit
must come in the order of time; state per unit is the values inside the window and one flag. With
`idle_ms` it is dropped after so long without rows; such a query keeps triggering to look for idle units,
so it never ends on its own.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "times array<bigint>, scores array<double>, armed boolean"
OUT = "unit bigint, t bigint, mean double, armed boolean"


def monitor(rows: DataFrame, window: int, on: float, off: float, idle_ms: int | None = None) -> DataFrame:
    """rows (unit bigint, t bigint, score double) with the mean of the scores in [t - window, t] and whether the
    alarm is on. A null mean keeps the alarm's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_t, old_s, armed = state.get if state.exists else ([], [], False)
        kept = deque(zip(old_t, old_s, strict=True))
        new = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        n, total = sum(s is not None for _, s in kept), math.fsum(s for _, s in kept if s is not None)
        for t, s in zip(new["t"].tolist(), new["score"].tolist(), strict=True):
            s = None if pd.isna(s) else s
            kept.append((t, s))
            n, total = n + (s is not None), total + (s or 0.0)
            while kept[0][0] < t - window:
                _, gone = kept.popleft()
                n, total = n - (gone is not None), total - (gone or 0.0)
            mean = total / n if n else None
            if mean is not None:
                armed = True if mean >= on else False if mean < off else armed
            out.append((key[0], t, mean, armed))
        state.update(([t for t, _ in kept], [s for _, s in kept], armed))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["unit", "t", "mean", "armed"])

    return rows.groupBy("unit").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def windowed_counts(rows: DataFrame, ts: str, delay: str, length: str, by: list[str]) -> DataFrame:
    """Rows per tumbling window and key, final once the watermark has passed."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, length), *by).agg(F.count("*").alias("n"))
