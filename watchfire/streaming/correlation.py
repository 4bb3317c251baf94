"""Count and sequence correlation over a stream of events."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchfire.functions.rules import Rule
from watchfire.operators import detect

ALERTS = "rule_id string, entity_key string, event_id long, us long, event_ids array<long>"
#: Rows are taken by time slots: so many to a timeframe, none shorter than a second.
SLOTS, LEAST_SLOT_US = 32, 1_000_000
#: The entities of a rule share so many keys of state.
SHARES = 1024
#: Up to so many waiting rows of a key are in its value, so many at most in a lot, but for those of one slot.
NEAR_ROWS, LOT_ROWS = 32, 512
#: The entities of a key that have fired are in so many parts.
SHELVES = 32


@dataclass(slots=True)
class _Kept:
    """The value of a key."""

    timer: int | None = None
    near: str | None = None
    places: str | None = None
    shelves: int = 0


class _Correlator(StatefulProcessor):
    """Per rule and share of its entities, or, for rows without an entity_key, per (rule, entity). Rows wait until the watermark
    has passed the time slot that they fall in, and are then taken, of each entity in order of (us, id), so rows that come
    late, but are allowed, change nothing.

    A call of the state store costs as much as very many rows, so entities share a key and their rows are read and written
    together. State: `kept`, the time of the one timer that a key has, at the end of its first slot, the first waiting rows and
    the number of lots that begin with each slot; `waiting`, a map of (first slot, lot) to later rows; `open`, of each entity the
    time of its last alert and what is open: for a count the last threshold - 1 matches, for a sequence the starts; `fired`, for
    "never", a map of a shelf to its entities that have fired. A timer takes the lots whose first slot is due and looks at no
    others; their rows that are not due are then the first that wait. Timers of a key are a slot apart, and what is open goes
    after a timeframe, so it is read for as many timers as a timeframe has slots. So what is read and written grows with
    the rows, not with rows times batches.
    """

    def __init__(self, plans: dict[str, tuple[str, int, int]], rearm: str):
        #: rule -> (kind, threshold or number of stages, timeframe in microseconds)
        self.plans, self.rearm = plans, rearm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "timer long, near string, places string, shelves long")
        self.waiting = handle.getMapState("waiting", "slot long, lot long", "rows string")
        self.open = handle.getValueState("open", "entities string")
        self.fired = handle.getMapState("fired", "shelf long", "entities string")

    def _width(self, rule: str) -> int:
        return max(LEAST_SLOT_US, self.plans[rule][2] // SLOTS)

    @staticmethod
    def _end(slot: int, width: int) -> int:
        """Milliseconds at which the slot is over."""
        return (slot + 1) * width // 1000 + 1

    def _read(self) -> _Kept:
        return _Kept(*self.kept.get()) if self.kept.exists() else _Kept()

    def _write(self, kept: _Kept) -> None:
        if kept == _Kept():
            self.kept.clear()
        else:
            self.kept.update((kept.timer, kept.near, kept.places, kept.shelves))

    def _set_timer(self, kept: _Kept, at: int | None) -> None:
        if at != kept.timer:
            if kept.timer is not None:
                self.handle.deleteTimer(kept.timer)
            if at is not None:
                self.handle.registerTimer(at)
            kept.timer = at

    def _wait(self, kept: _Kept, rows: list[list], width: int) -> None:
        """Adds the rows to those that wait."""
        rows += _loaded(kept.near)
        if len(rows) > NEAR_ROWS:
            rows.sort()
            lots: list[list[list]] = []
            for _, group in groupby(rows[NEAR_ROWS:], key=lambda r: r[0] // width):
                found = list(group)
                if lots and len(lots[-1]) + len(found) <= LOT_ROWS:
                    lots[-1] += found
                else:
                    lots.append(found)
            places = dict(_loaded(kept.places))
            for lot in lots:
                slot = lot[0][0] // width
                n = places.get(slot, 0)
                self.waiting.updateValue((slot, n), (json.dumps(lot),))
                places[slot] = n + 1
            kept.places = json.dumps([*places.items()])
        kept.near = json.dumps(rows[:NEAR_ROWS])

    def _taken(self, kept: _Kept, since: int, width: int) -> list[list]:
        """The rows of slots that begin before since, no more among those that wait."""
        rows, kept.near = _loaded(kept.near), None
        if kept.places:
            places = dict(_loaded(kept.places))
            for slot in [s for s in places if s * width < since]:
                for lot in range(places.pop(slot)):
                    rows += _loaded(self.waiting.getValue((slot, lot))[0])
                    self.waiting.removeKey((slot, lot))
            kept.places = json.dumps([*places.items()]) if places else None
        due: list[list] = []
        rest: list[list] = []
        for r in rows:
            (due if r[0] < since else rest).append(r)
        if rest:
            self._wait(kept, rest, width)
        return due

    def _shelf(self, kept: _Kept, shelves: dict[int, set[str]], entity: str) -> set[str]:
        """The entities that have fired, of the shelf that has this one. shelves: those that were read."""
        n = zlib.crc32(entity.encode("utf-8", "surrogatepass")) % SHELVES
        if n not in shelves:
            shelves[n] = set(_loaded(self.fired.getValue((n,))[0])) if kept.shelves >> n & 1 else set()
        return shelves[n]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._read()
        shelves: dict[int, set[str]] = {}
        width = self._width(key[0])
        # The timer of a key with waiting rows is at the end of their first slot.
        at = kept.timer if kept.near or kept.places else None
        some = False
        for part in rows:
            entities = part["entity_key"].tolist() if "entity_key" in part else [key[1]] * len(part)
            over = {e for e in set(entities) if e in self._shelf(kept, shelves, e)} if kept.shelves else ()
            new = [[*r] for r in zip(part["us"].tolist(), part["id"].tolist(), part["stages"].tolist(), entities) if r[3] not in over]
            if new:
                end = self._end(min(new)[0] // width, width)
                at, some = end if at is None else min(at, end), True
                self._wait(kept, new, width)
        if some:
            self._set_timer(kept, at)
            self._write(kept)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        kind, n, frame = self.plans[key[0]]
        width = self._width(key[0])
        # The start of the first slot that is not over: rows that are still to be taken are not before it, but may be before now.
        since = (-(-now_us // width) - 1) * width
        kept = self._read()
        if kept.timer == expiredTimerInfo.getExpiryTimeInMs():
            kept.timer = None
        due = self._taken(kept, since, width)
        due.sort(key=lambda r: (r[3], r[0], r[1]))
        entities = json.loads(self.open.get()[0]) if self.open.exists() else {}
        shelves: dict[int, set[str]] = {}
        changed: set[int] = set()
        out = []
        for entity, found in groupby(due, key=lambda r: r[3]):
            last, held = entities.pop(entity, (None, []))
            state = _Counted(held, n, frame) if kind == "count" else _Sequences(held, n, frame)
            for us, event, stages, _ in found:
                if last is not None and (self.rearm == "never" or us <= last + frame):
                    continue
                ids = state.take(us, event, stages)
                if ids:
                    last = us
                    state.clear()
                    if self.rearm == "never":
                        shelf = self._shelf(kept, shelves, entity)
                        if entity in shelf:
                            continue
                        shelf.add(entity)
                        changed.add(id(shelf))
                    out.append((key[0], entity, event, us, ids))
            if last is None or self.rearm != "never":
                entities[entity] = (last, state.rows())
        for k, shelf in shelves.items():
            if id(shelf) in changed:
                self.fired.updateValue((k,), (json.dumps(sorted(shelf)),))
                kept.shelves |= 1 << k
        # What no later row can need goes: what is a timeframe before them.
        left, newest = {}, None
        for entity, (last, held) in entities.items():
            last = None if last is None or last + frame < since else last
            held = [r for r in held if since - r[0] <= frame]
            if held or last is not None:
                left[entity] = (last, held)
                newest = max(x for x in (newest, last, *[r[0] for r in held]) if x is not None)
        if left:
            self.open.update((json.dumps(left),))
        elif self.open.exists():
            self.open.clear()
        firsts = [r[0] // width for r in _loaded(kept.near)] + [slot for slot, _ in _loaded(kept.places)]
        idle = None if newest is None else (newest + frame + width) // 1000 + 1
        self._set_timer(kept, self._end(min(firsts), width) if firsts else idle)
        self._write(kept)
        return iter([pd.DataFrame(out, columns=["rule_id", "entity_key", "event_id", "us", "event_ids"])] if out else [])

    def close(self) -> None:
        pass


def _loaded(text: str | None) -> list:
    return json.loads(text) if text else []


class _Counted:
    """The last threshold - 1 matches, none older than a timeframe."""

    def __init__(self, rows: list[tuple], threshold: int, frame: int):
        self.last, self.threshold, self.frame = [(r[0], r[1]) for r in rows], threshold, frame

    def take(self, us: int, event: int, stages: int) -> list[int]:
        self.last = [*self.last[-(self.threshold - 1) :], (us, event)] if self.threshold > 1 else [(us, event)]
        full = len(self.last) == self.threshold and us - self.last[0][0] <= self.frame
        return [i for _, i in self.last] if full else []

    def clear(self) -> None:
        self.last = []

    def rows(self) -> list[tuple]:
        return [(us, i, 0, "") for us, i in self.last[-(self.threshold - 1) :] if self.threshold > 1]


class _Sequences:
    """Starts that are open, by the stage that they have reached. All starts of a stage go on together, so each moves once a
    stage; in a stage they are in order of time."""

    def __init__(self, rows: list[tuple], n: int, frame: int):
        self.n, self.frame = n, frame
        self.at: list[list[tuple]] = [[] for _ in range(n + 1)]
        for us, event, stage, ids in rows:
            self.at[stage].append((us, event, ids))

    def take(self, us: int, event: int, stages: int) -> list[int]:
        for k in range(self.n - 1, 0, -1):  # the furthest first, so that a row moves a start by one stage
            if stages >> k & 1 and self.at[k]:
                moved = [(s, i, f"{ids},{event}") for s, i, ids in self.at[k] if us - s <= self.frame]
                self.at[k] = []
                if moved and k + 1 == self.n:
                    return [int(x) for x in moved[0][2].split(",")]
                self.at[k + 1] += moved
        if stages & 1:
            self.at[1].append((us, event, str(event)))
        return []

    def clear(self) -> None:
        self.at = [[] for _ in range(self.n + 1)]

    def rows(self) -> list[tuple]:
        return [(us, event, k, ids) for k, found in enumerate(self.at) for us, event, ids in found]


def correlation_stream(events: DataFrame, rules: list[Rule], lateness: str = "1 hour", rearm: str = "never") -> DataFrame:
    """Alerts of the count and sequence rules, as ALERTS. events: at (event time), us, id and the event fields.

    An alert comes once the watermark has passed the time slot of its last event: a 32nd of the timeframe, a second at least.
    rearm "never": one alert for each rule and entity, as the batch job gives on the same rows; what is kept of such a
    pair is its name. "after_timeframe": matches up to a timeframe after an alert are passed over, then the pair
    starts anew. Rows later than the watermark are dropped. Needs the RocksDB state store. A checkpoint of an earlier form
    of the state (a key for each entity) cannot be continued.
    """
    if rearm not in ("never", "after_timeframe"):
        raise ValueError(f"unknown rearm: {rearm}")
    rules = [r for r in rules if r.kind != "single"]
    if not rules:
        raise ValueError("no correlation rule")
    plans = {r.id: (r.kind, len(r.stages) if r.kind == "sequence" else r.threshold, r.frame_us) for r in rules}
    matched = detect.keyed(detect.matched_events(events.withWatermark("at", lateness), rules), rules)
    return (
        matched.select("rule_id", F.pmod(F.xxhash64("entity_key"), F.lit(SHARES)).alias("share"), "entity_key", "at", "us", "id", F.col("mask").alias("stages"))
        .groupBy("rule_id", "share")
        .transformWithStateInPandas(_Correlator(plans, rearm), ALERTS, "Append", "EventTime")
    )
