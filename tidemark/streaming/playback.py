"""Playback cursors as a stream of commands: a step moves a cursor along the readings of its day and on to the next day.

A cursor is a key with keyed state: its day, its place in it, whether it plays, and how many days it has advanced by itself.
``step`` moves by one; past the last reading it goes to the first of the next day, past the first to the last of the day
before, and at the ends of all days around inside the day. Steps of a playing cursor count the days that they bring; after
``MOST_DAYS`` the cursor pauses until ``confirm``. A cursor without commands for ``idle`` of event time is forgotten: a timer is
moved on by each command.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_DAYS = 20
OUTPUT = "cursor string, seq long, day long, place long, state string"
_STATE = "day long, place long, playing boolean, paused boolean, advanced long"


class Cursor(StatefulProcessor):
    """``days``: readings of each day, in order of days, as (day, readings)."""

    def __init__(self, days: list[tuple[int, int]], idle_ms: int, most_days: int = MOST_DAYS) -> None:
        self.days, self.idle_ms, self.most_days = days, idle_ms, most_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cursor", _STATE)
        self.order = {d: k for k, (d, _) in enumerate(self.days)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = list(self.state.get()) if self.state.exists() else [self.days[0][0], 0, False, False, 0]
        told, latest = [], 0
        each = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for command, seq, ts in zip(each["command"], each["seq"], each["ts"]):
            at = stepped(at, command, self.days, self.order, self.most_days)
            latest = max(latest, int(pd.Timestamp(ts).timestamp() * 1000))
            told.append((key[0], int(seq), at[0], at[1], "paused" if at[3] else "playing" if at[2] else "stopped"))
        self.state.update(tuple(at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame(told, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, place = self.state.get()[:2] if self.state.exists() else (None, None)
        self.state.clear()
        yield pd.DataFrame([(key[0], None, day, place, "forgotten")], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stepped(at: list, command: str, days: list[tuple[int, int]], order: dict[int, int], most_days: int) -> list:
    """The cursor (day, place, playing, paused, advanced) after a command: play, stop, confirm, step or back."""
    day, place, playing, paused, advanced = at
    if command == "play":
        return [day, place, not paused, paused, advanced]
    if command == "stop":
        return [day, place, False, False, 0]
    if command == "confirm":
        return [day, place, paused or playing, False, 0] if paused else at
    if command not in ("step", "back") or paused:
        return at
    k, delta = order[day], 1 if command == "step" else -1
    size = days[k][1]
    if 0 <= place + delta < size:
        return [day, place + delta, playing, paused, advanced]
    if not 0 <= k + delta < len(days):
        return [day, 0 if delta > 0 else size - 1, playing, paused, advanced]
    next_day, readings = days[k + delta]
    if playing and delta > 0:
        advanced += 1
        paused = advanced >= most_days
    return [next_day, 0 if delta > 0 else readings - 1, playing and not paused, paused, advanced]


def cursors(commands: DataFrame, days: list[tuple[int, int]], idle_ms: int, most_days: int = MOST_DAYS) -> DataFrame:
    """OUTPUT of a stream of commands (cursor, seq, command, ts) with a watermark on ts."""
    return commands.groupBy("cursor").transformWithStateInPandas(Cursor(days, idle_ms, most_days), OUTPUT, "Append", "EventTime")
