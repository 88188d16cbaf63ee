"""Sign-out gaps as a stream (G6): the open sign-out of every worker is kept as state.

Events may come out of order.  A worker's events wait in the state until the watermark has passed them, then they are taken
in time order, as the batch operator would: a sign-in right after a sign-out closes a gap, a repeated sign-out replaces the
open one.  Workers are dealt by hash to ``buckets`` groups, whose state holds the events of their workers, as a call of
Python for every worker would cost more than its events.  A timer wakes a group when its first waiting event is due, and again
when an open sign-out has become too old to be closed, so the state holds only what can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crewlake.functions.scalars import local_ts, norm_id, text
from crewlake.operators.reconcile import IN, MAX_CROSS_DAY_HOURS, OUT

_HOUR = 3_600_000_000
_DAY = 24 * _HOUR
#: Groups of workers; a group's state is one row, so very many workers want more of them.
BUCKETS = 1024
#: Workers of a group, and per event the number of its worker, its code (see ``step``) and whether it is an open sign-out.
STATE = "names array<string>, worker array<int>, code array<long>, is_open array<boolean>"
PAIRS = "opms string, started timestamp, ended timestamp, hours double"


def sign_events(forms: DataFrame) -> DataFrame:
    """(opms, at, is_in) of usable forms; ``at`` is wall time kept in a UTC timestamp, which a watermark needs."""
    return forms.select(norm_id("OPMS").alias("opms"), F.lower(text("Status")).alias("status"), local_ts("Date").cast("timestamp").alias("at")).filter(
        F.col("opms").isNotNull() & F.col("at").isNotNull() & F.col("status").isin(OUT, IN)).select("opms", "at", (F.col("status") == IN).alias("is_in"))


def last_close(open_at: np.ndarray) -> np.ndarray:
    """The latest times at which sign-outs can still be closed."""
    return np.maximum((open_at // _DAY + 1) * _DAY, open_at + MAX_CROSS_DAY_HOURS * _HOUR)


def step(worker: np.ndarray, code: np.ndarray, is_open: np.ndarray, until: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Take the waiting events up to ``until`` in order: events that still matter (worker, code, is_open), closed gaps (worker, start, end).

    A code is an event's time in microseconds doubled, plus one for a sign-in, so that a sign-out comes first at equal times.
    A worker's open sign-out comes before all waiting events.
    """
    order = np.lexsort((code, ~is_open, worker))
    worker, code, is_open = worker[order], code[order], is_open[order]
    at, is_in = code >> 1, code & 1 == 1
    taken = is_open | (at <= until)  # the first events of each worker
    final = np.concatenate((worker[1:] != worker[:-1], [True]))
    latest = taken & (final | ~np.concatenate((taken[1:], [True])))
    again = np.flatnonzero(~taken | (latest & ~is_in & (~final | (last_close(at) > until))))
    end = np.flatnonzero(taken[1:] & is_in[1:] & ~is_in[:-1] & (worker[1:] == worker[:-1])) + 1
    start, close = at[end - 1], at[end]
    fits = (close > start) & ((close // _DAY == start // _DAY) | (close - start <= MAX_CROSS_DAY_HOURS * _HOUR))
    return (worker[again], code[again], taken[again]), (worker[end][fits], start[fits], close[fits])


def gap_pairs_stream(forms: DataFrame, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """(opms, started, ended, hours) of a stream of sign forms; events later than ``delay`` are left out.

    A gap comes out once the watermark has passed its end.  ``buckets`` cannot change while a checkpoint is in use.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, *held = state.get if state.exists else ([], [], [], [])
        names = [np.array(names, object)]
        worker, code, is_open = ([np.array(x, kind)] for x, kind in zip(held, (np.int64, np.int64, bool)))
        for part in parts:
            if len(part):
                names.append(part["opms"].to_numpy(object))
                code.append(2 * part["at"].to_numpy("datetime64[us]").astype(np.int64) + part["is_in"].to_numpy(np.int64))
                is_open.append(np.zeros(len(part), bool))
        base = len(names[0])
        number, names = pd.factorize(np.concatenate(names))
        worker = np.concatenate((number[worker[0]], number[base:]))
        mark = state.getCurrentWatermarkMs()
        (worker, code, is_open), (who, start, end) = step(worker, np.concatenate(code), np.concatenate(is_open), mark * 1000)
        if len(worker):
            left, worker = np.unique(worker, return_inverse=True)
            state.update((names[left].tolist(), worker.tolist(), code.tolist(), is_open.tolist()))
            # an open sign-out waits for its worker's next event, or until it can no longer be closed
            lone = is_open & np.concatenate((worker[1:] != worker[:-1], [True]))
            due = np.where(lone, last_close(code >> 1), code >> 1)[lone | ~is_open].min()
            state.setTimeoutTimestamp(int(max(mark, -(-due // 1000)) + 1))
        elif state.exists:
            state.remove()
        if len(who):
            yield pd.DataFrame({"opms": names[who], "started": start.astype("datetime64[us]"), "ended": end.astype("datetime64[us]"), "hours": (end - start) / _HOUR})

    events = sign_events(forms).withWatermark("at", delay).withColumn("bucket", F.pmod(F.xxhash64("opms"), F.lit(buckets)))
    return events.groupBy("bucket").applyInPandasWithState(run, PAIRS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
