"""Decisions over a log whose rows arrive in any order.

What a run does with an attempt depends on all attempts before it, so each attempt waits until the stream's clock says that nothing earlier is to come. A run's waiting rows lie packed
beside its other state while they are few, and above that in map state, in chunks of neighbouring times that are cut as they grow; one timer per run stands at its earliest waiting row. So
the calls to the state store follow the runs and the chunks and not the rows. When the watermark has passed, chunks are read in order and their rows decided in (time, experiment)
order, one chunk in memory at a time. A run may be as long as it likes: its state is a few numbers, a line per chunk, and what came in within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runsight.functions.values import check_direction
from runsight.operators.runlog import MAX_RETRIES, STAGNATION_THRESHOLD
from runsight.streaming.loop import FIELDS, Loop, Rules, advance, out_of_memory, ran

#: Map state and timers need this state store, set in the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "run_id {run}, experiment_id long, action string, gated boolean, best_before double, consecutive_reverts long, family string, late boolean"
COLUMNS = ["run_id", "experiment_id", "action", "gated", "best_before", "consecutive_reverts", "family", "late"]
ROW = np.dtype([("at", "<i8"), ("experiment_id", "<i8"), ("finished", "?"), ("memory", "?"), ("metric", "<f8")])
#: A chunk: the first slot of time it covers, the time of its first row, its key in the map.
CHUNK = np.dtype([("slot", "<i8"), ("first", "<i8"), ("name", "<i8")])
SLOT_MS = 60_000
#: Rows of a chunk, unless one slot has more.
CHUNK_ROWS = 1024
#: Rows handed on at once.
HANDED = 10_000


class _InOrder(StatefulProcessor):
    def __init__(self, rules: Rules, slot_ms: int, chunk_rows: int) -> None:
        self.rules, self.slot_ms, self.chunk_rows = rules, slot_ms, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", f"{FIELDS}, last_at long, last_id long, timer long, held binary, chunks binary")
        self.waiting = handle.getMapState("waiting", "name long", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self._state()
        for batch in rows:
            found = np.empty(len(batch), ROW)
            for name in ROW.names:
                found[name] = batch[name].to_numpy()
            found = found[batch["placed"].to_numpy(bool)]
            if state["last"] is not None:
                at, number = state["last"]
                late = (found["at"] < at) | ((found["at"] == at) & (found["experiment_id"] <= number))
                if late.any():
                    yield pd.DataFrame([(key[0], n, None, None, None, None, None, True) for n in found["experiment_id"][late].tolist()], columns=COLUMNS)
                    found = found[~late]
            if len(found):
                self._hold(state, found)
        yield from self._release(key, state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._state()
        state["timer"] = None  # a timer that has fired is gone
        yield from self._release(key, state, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _state(self) -> dict:
        saved = self.loop.get()
        if saved is None:
            return {"loop": Loop(), "last": None, "timer": None, "held": np.empty(0, ROW), "chunks": []}
        *loop, at, number, timer, held, chunks = saved
        return {
            "loop": Loop(*loop), "last": None if at is None else (at, number), "timer": timer, "held": np.frombuffer(bytes(held), ROW), "chunks": np.frombuffer(bytes(chunks), CHUNK).tolist(),
        }

    def _chunk(self, name: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((name,))[0]), ROW)

    def _pieces(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows in order, cut between slots into pieces of half a chunk if they are more than a chunk."""
        rows = rows[np.lexsort([rows[name] for name in reversed(ROW.names)])]
        if len(rows) <= self.chunk_rows:
            return [rows]
        slots = rows["at"] // self.slot_ms
        starts = np.flatnonzero(np.diff(slots, prepend=slots[0] - 1))
        wanted = np.arange(0, len(rows), max(1, self.chunk_rows // 2))
        return np.split(rows, np.unique(starts[np.searchsorted(starts, wanted, "right") - 1])[1:])

    def _hold(self, state: dict, found: np.ndarray) -> None:
        """Add rows to those that wait. ``chunks`` stay in the order of their slots; the first also takes what lies before it."""
        chunks = state["chunks"]
        if not chunks:
            pieces = self._pieces(np.concatenate([state["held"], found]))
            if len(pieces) == 1:
                state["held"] = pieces[0]
                return
            state["held"], parts = np.empty(0, ROW), [(None, pieces)]
        else:
            which = np.maximum(np.searchsorted([c[0] for c in chunks], found["at"] // self.slot_ms, "right") - 1, 0)
            parts = [(i, self._pieces(np.concatenate([self._chunk(chunks[i][2]), found[which == i]]))) for i in np.unique(which).tolist()]
        free, kept = max((c[2] for c in chunks), default=-1) + 1, dict(enumerate(chunks))
        made = []
        for i, pieces in parts:
            old = None if i is None else kept.pop(i)
            for k, piece in enumerate(pieces):
                first = int(piece["at"][0])
                slot, name = first // self.slot_ms, free
                if k == 0 and old is not None:
                    slot, name = min(slot, old[0]), old[2]
                else:
                    free += 1
                self.waiting.updateValue((name,), (piece.tobytes(),))
                made.append((slot, first, name))
        state["chunks"] = sorted([*kept.values(), *made])

    def _release(self, key: Any, state: dict, watermark: int) -> Iterator[pd.DataFrame]:
        """Decide what lies at or before the watermark, and set the timer to the first row that stays."""
        out = []
        for ready in self._ready(state, watermark):
            for at, number, finished, memory, metric in ready.tolist():
                state["last"] = (at, number)
                if state["loop"].stopped:
                    continue
                state["loop"], made = advance(state["loop"], finished, memory, None if metric != metric else metric, self.rules)
                out.append((key[0], number, *made, False))
            if len(out) >= HANDED:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        first = state["chunks"][0][1] if state["chunks"] else int(state["held"]["at"][0]) if len(state["held"]) else None
        if state["timer"] is not None and state["timer"] != first:
            self.handle.deleteTimer(state["timer"])
        if first is not None and state["timer"] != first:
            self.handle.registerTimer(first)
        self.loop.update((*state["loop"], *(state["last"] or (None, None)), first, state["held"].tobytes(), np.array(state["chunks"], CHUNK).tobytes()))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _ready(self, state: dict, watermark: int) -> Iterator[np.ndarray]:
        """Rows at or before the watermark in order, taken out of what waits."""
        passed = int(np.searchsorted(state["held"]["at"], watermark, "right"))
        if passed:
            ready, state["held"] = state["held"][:passed], state["held"][passed:]
            yield ready
        read = 0
        for slot, first, name in state["chunks"]:
            if first > watermark:
                break
            rows = self._chunk(name)
            passed = int(np.searchsorted(rows["at"], watermark, "right"))
            yield rows[:passed]
            if passed < len(rows):
                self.waiting.updateValue((name,), (rows[passed:].tobytes(),))
                state["chunks"][read] = (slot, int(rows["at"][passed]), name)
                break
            self.waiting.removeKey((name,))
            read += 1
        state["chunks"] = state["chunks"][read:]


def use_state_store(spark: SparkSession) -> None:
    """Streams of this session that start from now on may hold map state and timers."""
    spark.conf.set(*STATE_STORE)


def ordered_decisions(
    attempts: DataFrame,
    delay: str,
    direction: str = "maximize",
    bar: float | None = None,
    families: Sequence[str] = (),
    threshold: int = STAGNATION_THRESHOLD,
    max_retries: int = MAX_RETRIES,
    slot_ms: int = SLOT_MS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Action per attempt in the order of (timestamp, experiment_id), however rows arrive within ``delay`` of each other; call ``use_state_store`` first.

    Attempts: run_id, experiment_id, status, error, metric_value, timestamp. A row comes out once the stream's clock, the latest timestamp less ``delay``, has passed it. One that arrives after
    its run has gone beyond it comes out at once as ``late``, without an action, and changes nothing. Rows behind a stop come out no more. Of rows with equal time and number those that arrive
    together are all decided. A row without an experiment_id only moves the clock; one without a timestamp is left out, as it has no place in the order. Waiting rows of a slot of
    ``slot_ms`` stay together, in chunks of about ``chunk_rows``.
    """
    rules = Rules(1.0 if check_direction(direction) == "maximize" else -1.0, bar, tuple(families), threshold, max_retries)
    run = attempts.schema["run_id"].dataType.simpleString().replace("bigint", "long")
    narrow = attempts.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay).select(
        "run_id",
        F.coalesce("experiment_id", F.lit(0)).cast("long").alias("experiment_id"),
        F.col("experiment_id").isNotNull().alias("placed"),
        ran().alias("finished"),
        out_of_memory().alias("memory"),
        F.when(ran(), F.col("metric_value").cast("double")).otherwise(F.lit(float("nan"))).alias("metric"),
        F.unix_millis("timestamp").alias("at"),  # without the time column itself, late rows are not dropped before they are seen
    )
    return narrow.groupBy("run_id").transformWithStateInPandas(_InOrder(rules, slot_ms, chunk_rows), OUT.format(run=run), "append", "EventTime")
