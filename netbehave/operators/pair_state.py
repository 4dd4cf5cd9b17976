"""Beaconing features of a stream whose state outlives windows.

Fixed windows split a pair's connections and lose the intervals across their edges. Here each
pair has a state of its own: count, last time, mean and squared deviation of its intervals,
and the times that are newer than the watermark. Times up to the watermark are final, for what
arrives later and is older is dropped by Spark as late; they are put in order and folded into
the moments. So the result does not depend on how rows fall into batches.

A pair's run ends with a silence of ``expiry``: an interval of that length or more is no
interval of the run, and once the watermark is that far past the last time, the run is handed
on and its state is removed. State is 40 bytes for each pair that is not silent, and 8 for each
of its times newer than the watermark, which the rate of a pair and the allowed lateness bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.constants import MIN_BEACON_CONNECTIONS
from netbehave.functions.columns import round_places
from netbehave.operators import schemas
from netbehave.operators.beaconing import PAIR, timed_pairs
from netbehave.operators.connections import empty
from netbehave.operators.windowed import WATERMARK, can_window, seconds, with_event_time

if TYPE_CHECKING:
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

EXPIRY = "1 day"
RUNS = "src_ip string, dst_ip string, first double, last double, n_conns long, mean double, squares double"
STATE = "first double, last double, n long, mean double, squares double, newer binary"


def beaconing_runs(conn: DataFrame, expiry: str = EXPIRY, watermark: str = WATERMARK) -> DataFrame:
    """Runs of the pairs of a streaming log: (src_ip, dst_ip, first, last, n_conns, mean, squares).

    ``mean`` and ``squares`` are those of the intervals, the latter around the mean. Rows
    without source, destination or time are left out; rows later than the watermark too.
    """
    silence = float(seconds(expiry))
    rows = timed_pairs(with_event_time(conn, watermark), "event_time")

    def update(
        key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        first, last, n, mean, squares, newer = state.get if state.exists else (0.0, 0.0, 0, 0.0, 0.0, b"")
        runs = []

        def end() -> None:
            runs.append((*key, first, last, n, mean, squares))

        given = [] if state.hasTimedOut else [frame["ts"].to_numpy() for frame in frames]
        times = np.concatenate([np.frombuffer(newer), *given])
        times.sort()
        clock = state.getCurrentWatermarkMs()
        final = int(np.searchsorted(times, clock / 1000, "right"))
        settled, newer = times[:final], times[final:].tobytes()
        # Cut where the silence is long enough, before the first of these times too.
        steps = np.diff(settled, prepend=last if n else settled[:1])
        cuts = [0, *np.flatnonzero(steps >= silence).tolist(), len(settled)]
        for a, b in zip(cuts, cuts[1:]):
            part = settled[a:b]
            if a in cuts[1:-1] and n:
                end()
                n, mean, squares = 0, 0.0, 0.0
            if not len(part):
                continue
            gaps = np.diff(part, prepend=last) if n else np.diff(part)
            if not n:
                first = float(part[0])
            known, more = max(0, n - 1), len(gaps)
            if more:
                # Moments of two sets of intervals, put together around the common mean.
                own = float(gaps.mean())
                apart = own - mean
                mean += apart * more / (known + more)
                squares += float(((gaps - own) ** 2).sum()) + apart * apart * known * more / (known + more)
            n += len(part)
            last = float(part[-1])
        if n and clock / 1000 >= last + silence:
            end()
            n, mean, squares = 0, 0.0, 0.0
        if n or newer:
            state.update((first, last, n, mean, squares, newer))
            since = last if n else float(times[final])
            state.setTimeoutTimestamp(max(int((since + silence) * 1000), clock + 1))
        elif state.exists:
            state.remove()
        if runs:
            yield pd.DataFrame(runs, columns=[one.split()[0] for one in RUNS.split(", ")])

    return rows.groupBy(*PAIR).applyInPandasWithState(update, RUNS, STATE, "append", "EventTimeTimeout")


def beaconing_stateful(conn: DataFrame, expiry: str = EXPIRY, watermark: str = WATERMARK) -> DataFrame:
    """Beaconing features of each run of a streaming log, as ``beaconing_features`` has them for
    all rows of a batch, once the pair has been silent for ``expiry``."""
    if not can_window(conn, "src", "dst", "time"):
        return empty(conn, schemas.BEACONING)
    runs = beaconing_runs(conn, expiry, watermark)
    deviation = F.sqrt(F.col("squares") / (F.col("n_conns") - 1))
    kept = runs.where((F.col("n_conns") >= MIN_BEACON_CONNECTIONS) & (F.col("mean") > 0))
    return kept.select(
        *PAIR,
        "n_conns",
        round_places(F.col("mean"), 2).alias("mean_interval"),
        round_places(deviation / F.col("mean"), 4).alias("jitter"),
    )
