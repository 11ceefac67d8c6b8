"""Keyed state machines on a stream that see their rows in time order.

Rows wait in state until the watermark has passed them, so a row that arrives batches later but
within the watermark's delay takes its place as if it had been on time, and the result is that of
the batch operator.  State of a key is what one step needs, and the rows of one delay.  A key
that has been silent for ``idle_s`` is forgotten.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

IDLE_S = 600.0


class InOrder(StatefulProcessor):
    """``step(state, row)`` takes the state (a dict that JSON can hold, empty at first) and a row as
    a dict, changes the state and returns the output values behind the key, or None.  Everything of a
    group is one value: it is read and written once a call, and one timer is pending at most."""

    def __init__(self, step: Callable[[dict, dict], tuple | None], inner: Sequence[str], fields: Sequence[str], order: Sequence[str], names: Sequence[str], idle_ms: int):
        self.step, self.inner, self.fields, self.order, self.names, self.idle_ms = step, inner, fields, order, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def advance(self, key, fresh: list[list], watermark: int, fired: int | None) -> pd.DataFrame:
        value = self.state.get()
        saved = json.loads(value[0]) if value else {"own": {}, "held": [], "timer": None}
        if fired is not None and fired == saved["timer"]:
            saved["timer"] = None
        rows = sorted((dict(zip(self.fields, r)) for r in saved["held"] + fresh), key=lambda r: tuple(r[c] for c in self.order))
        later = [r for r in rows if r["at_ms"] > watermark]
        own, out = saved["own"], []
        for r in rows:
            if r["at_ms"] <= watermark:
                inner = [r[c] for c in self.inner]
                mine = own.setdefault(json.dumps(inner), {"own": {}})
                made = self.step(mine["own"], r)
                mine["last"] = r["at_ms"]
                if made is not None:
                    out.append((*key, *inner, *made))
        busy = {json.dumps([r[c] for c in self.inner]) for r in later}
        saved["own"] = {k: v for k, v in own.items() if k in busy or v["last"] + self.idle_ms > watermark}
        saved["held"] = [[r[c] for c in self.fields] for r in later]
        wake = [r["at_ms"] for r in later[:1]] + [v["last"] + self.idle_ms for k, v in saved["own"].items() if k not in busy]
        if wake:
            if saved["timer"] is None or min(wake) < saved["timer"]:
                if saved["timer"] is not None:
                    self.handle.deleteTimer(saved["timer"])
                saved["timer"] = min(wake)
                self.handle.registerTimer(saved["timer"])
            self.state.update((json.dumps(saved),))
        elif value:
            self.state.clear()
        return pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [list(r) for pdf in rows for r in pdf[self.fields].astype(object).where(pdf[self.fields].notna(), None).itertuples(index=False, name=None)]
        yield self.advance(key, fresh, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[dict, dict], tuple | None], out: str, *, within: int = 0, time: str = "ts", idle_s: float = IDLE_S) -> DataFrame:
    """Applies ``step`` to the rows of every key in ``order`` (which follows ``time``, a column
    with a watermark).  ``out`` is the schema of keys and step results.  Keys that differ only in the
    last ``within`` columns are kept together (few and bounded: the bins of a recording); columns
    are numbers, texts and booleans."""
    outer, inner = list(keys)[:len(keys) - within], list(keys)[len(keys) - within:]
    rest = [c for c in stream.columns if c not in outer and c != time]
    rows = stream.select(*outer, *rest, F.unix_millis(F.col(time)).alias("at_ms"), time)
    names = [x.split()[0] for x in out.split(", ")]
    machine = InOrder(step, inner, [*rest, "at_ms"], [*order, "at_ms"], names, int(idle_s * 1000))
    return rows.groupBy(*outer).transformWithStateInPandas(statefulProcessor=machine, outputStructType=out, outputMode="Append", timeMode="EventTime")


def persisted(tau: float = 2.0, gap_s: float = 5.0) -> Callable[[dict, dict], tuple]:
    """max(p, decayed previous) per bin; a backward step or a long gap restarts it.  Rows: p."""
    def step(state: dict, row: dict) -> tuple:
        dt = (row["at_ms"] - state["t"]) / 1000 if "t" in state else None
        decay = math.exp(-dt / tau) if dt is not None and 0 < dt <= gap_s else 0.0
        state["t"], state["p"] = row["at_ms"], max(row["p"], decay * state.get("p", 0.0))
        return (state["p"],)

    return step


def confirmed(min_hits: int = 3, max_age: int = 5) -> Callable[[dict, dict], tuple]:
    """Confirmation from the ``min_hits``-th hit until ``max_age`` misses.  Rows: hit."""
    def step(state: dict, row: dict) -> tuple:
        if row["hit"]:
            state["hits"], state["missed"] = state.get("hits", 0) + 1, 0
        else:
            state["missed"] = state.get("missed", 0) + 1
            if state["missed"] >= max_age:
                state["hits"] = 0
        return (state.get("hits", 0) >= min_hits,)

    return step


def smoothed_heading(window: int = 9, min_samples: int = 3) -> Callable[[dict, dict], tuple]:
    """Mean of the last ``window`` known headings once ``min_samples`` were seen, kept through
    frames without one.  Rows: frame_index, heading_deg."""
    def step(state: dict, row: dict) -> tuple:
        if row["heading_deg"] is not None:
            seen = state["seen"] = [*state.get("seen", []), row["heading_deg"]][-window:]
            state["n"] = state.get("n", 0) + 1
            if state["n"] >= min_samples:
                state["mean"] = math.fsum(seen) / len(seen)
        return row["frame_index"], row["heading_deg"], state.get("mean")

    return step


def both(*steps: Callable[[dict, dict], tuple], carry: Sequence[str] = ()) -> Callable[[dict, dict], tuple]:
    """Several machines over the same rows, behind the carried columns."""
    def step(state: dict, row: dict) -> tuple:
        made = tuple(row[c] for c in carry)
        for k, s in enumerate(steps):
            made += s(state.setdefault(str(k), {}), row)
        return made

    return step
