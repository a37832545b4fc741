"""A fuse as a stateful stream: it trips on the sums of its last ticks and stays open for some ticks after."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "grp string, tick long, open boolean"
STATE = "killed array<long>, passed array<long>, until long"


def step(killed: list[int], passed: list[int], until: int, tick: int, k: int, p: int, n: int, rate: int, hold: int) -> tuple[list[int], list[int], int, bool]:
    """One tick: the last ``n`` counts, until which tick the fuse is open, and whether it is open now."""
    killed, passed = [*killed, k][-n:], [*passed, p][-n:]
    if tick >= until and len(killed) == n and sum(killed) > 0 and sum(passed) > 0 and sum(passed) // sum(killed) <= rate:
        until = tick + hold
    return killed, passed, until, tick < until


def fuse_stream(ticks: DataFrame, n: int = 5, rate: int = 3, hold: int = 10) -> DataFrame:
    """grp, tick, open of a stream of grp, tick, killed, passed (ticks of a group in order within a trigger).

    A group's state is two short lists and a number; groups are spread over tasks by Spark.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        killed, passed, until = state.get if state.exists else ([], [], -1)
        killed, passed = list(killed), list(passed)
        rows = pd.concat(list(batches)).sort_values("tick")  # one trigger's ticks of one group
        out = []
        for tick, k, p in zip(rows.tick, rows.killed, rows.passed, strict=True):
            killed, passed, until, is_open = step(killed, passed, until, int(tick), int(k), int(p), n, rate, hold)
            out.append(is_open)
        state.update((killed, passed, until))
        yield pd.DataFrame({"grp": key[0], "tick": rows.tick, "open": out})

    return ticks.groupBy("grp").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
