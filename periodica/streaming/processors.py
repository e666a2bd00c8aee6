"""Keyed state machines for Structured Streaming."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.state import GroupState

ENTRY_SCHEMA = "mmsi string, area string, entered timestamp, before timestamp, confirmed timestamp, source string, observed timestamp, lat double, lon double"
STATE_SCHEMA = "body string"
LATEST_SCHEMA = "mmsi string, observed timestamp, received timestamp, lat double, lon double, sog double, static string"


NOT_A_TIME = np.iinfo(np.int64).min


def _nanos(stamps: pd.Series) -> np.ndarray:
    return stamps.to_numpy().astype("datetime64[ns]").view("int64")


def _missing_last(nanos: np.ndarray) -> np.ndarray:
    return np.where(nanos == NOT_A_TIME, np.iinfo(np.int64).max, nanos)


def _stamps(micros: list) -> np.ndarray:
    """Micros or None as a column; a plain array, as a call with a few rows must cost little."""
    return np.array([NOT_A_TIME if m is None else m for m in micros], dtype="int64").view("datetime64[us]").astype("datetime64[ns]")


class _VesselState:
    """State and timer of one vessel of a bucket, with the calls of ``GroupState``."""

    def __init__(self, held: tuple | None, mark: int, expired: bool = False):
        self._body, self.due = held if held else (None, None)
        self._mark, self.hasTimedOut = mark, expired

    @property
    def exists(self) -> bool:
        return self._body is not None

    @property
    def get(self) -> tuple:
        return (self._body,)

    def update(self, value: tuple) -> None:
        self._body, self.due = value[0], None

    def remove(self) -> None:
        self._body = self.due = None

    def getCurrentWatermarkMs(self) -> int:
        return self._mark

    def setTimeoutTimestamp(self, due: int) -> None:
        self.due = due


#: A call costs some milliseconds whatever it does; a bucket's vessels share one.
BUCKETS = 2048


class Vessels:
    """A function of one vessel, run for all vessels of a bucket; used with ``applyInPandasWithState``.

    States and timers stay those of a vessel: one that reported is called with its
    rows, Arrow batch by Arrow batch, and one whose timer has run out without them.
    ``newest`` keeps only what the last call of a vessel gave.
    """

    def __init__(self, function: Callable, newest: bool):
        self._function, self._newest = function, newest

    def __call__(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {m: (body, due) for m, body, due in json.loads(state.get[0])} if state.exists else {}
        seen, found = set(), {}

        def call(mmsi, rows: Iterator[pd.DataFrame], expired: bool = False) -> None:
            own = _VesselState(held.get(mmsi), mark, expired)
            out = list(self._function((mmsi,), rows, own))
            found[mmsi] = out if self._newest else found.get(mmsi, []) + out
            if own.exists:
                held[mmsi] = (own.get[0], own.due)
            else:
                held.pop(mmsi, None)

        for pdf in () if state.hasTimedOut else batches:
            for mmsi, rows in pdf.groupby("mmsi", sort=False, dropna=False):
                mmsi = mmsi if isinstance(mmsi, str) else None
                seen.add(mmsi)
                call(mmsi, iter((rows,)))
        for mmsi in [m for m, (_body, due) in held.items() if m not in seen and due is not None and due < mark]:
            call(mmsi, iter(()), expired=True)
        if held:
            state.update((json.dumps([[m, *x] for m, x in held.items()]),))
            timers = [due for _body, due in held.values() if due is not None]
            if timers:
                state.setTimeoutTimestamp(max(min(timers), mark + 1))
        elif state.exists:
            state.remove()
        given = [pdf for out in found.values() for pdf in out]
        if given:
            yield pd.concat(given, ignore_index=True) if len(given) > 1 else given[0]


def _nm(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, oa, lb, ob = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 3440.065 * 2 * math.asin(math.sqrt(min(1.0, h)))


def _inside(lat: float, lon: float, ring: list) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def advance(memory: dict, point: tuple, areas: dict) -> tuple[dict, list[tuple]]:
    """One step of the entry rule: new memory and the entries it confirms."""
    stamp, lat, lon, source = point
    last = memory.get("last")
    if last and stamp <= last[0]:
        return memory, []
    valid = bool(last) and stamp - last[0] <= 1800 * 10**6 and _nm((last[1], last[2]), (lat, lon)) / ((stamp - last[0]) / 3.6e9) <= 60.0
    sides, waiting, events = dict(memory.get("sides", {})), dict(memory.get("waiting", {})), []
    for area, (inner, outer) in areas.items():
        side = True if _inside(lat, lon, inner) else (None if _inside(lat, lon, outer) else False)
        pending = waiting.pop(area, None)
        if not valid:
            sides[area] = side
        elif side is None:
            continue
        elif sides.get(area) is None or sides[area] == side:
            sides[area] = side
        elif pending:
            sides[area] = side
            if side:
                events.append((area, pending[0], pending[1], stamp, source))
        else:
            waiting[area] = [stamp, last[0]]
    return {"last": [stamp, lat, lon], "sides": sides, "waiting": waiting}, events


QUIET_MS = 1800 * 1000  # fixed value: the longest pause between two reports of one passage


class EntryDetector:
    """Entries per vessel; reports wait until the watermark passes them, so order does not matter.

    A report from before the watermark comes too late for its place in the order:
    it goes out as a row without an area, for the replay. Rows without ``observed``
    only move the watermark. Used through ``Vessels``: the state of a vessel is one
    small text that travels with its bucket.
    """

    def __init__(self, areas: dict):
        self._areas = areas

    def __call__(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"memory": {}, "waiting": {}}
        mark = state.getCurrentWatermarkMs()
        waiting = {int(k): v for k, v in held["waiting"].items()}
        late = []
        if not state.hasTimedOut:
            for pdf in batches:
                nanos = _nanos(pdf["observed"])
                known = np.flatnonzero((nanos != NOT_A_TIME) & pdf["lat"].notna().to_numpy() & pdf["lon"].notna().to_numpy())
                if not len(known):
                    continue
                columns = (pdf[c].to_numpy()[known].tolist() for c in ("lat", "lon", "source"))
                for micros, lat, lon, source in zip((nanos[known] // 1000).tolist(), *columns):
                    if micros // 1000 >= mark:
                        waiting.setdefault(micros, []).append([source, lat, lon])
                    else:
                        late.append((key[0], None, None, None, None, source, micros, lat, lon))
        memory, out = held["memory"], []
        for micros in sorted(m for m in waiting if m // 1000 < mark):
            variants = sorted(waiting.pop(micros))
            source, lat, lon = variants[0]
            if any(_nm((lat, lon), (b, c)) > 0.1 for _s, b, c in variants):
                continue
            memory, events = advance(memory, (micros, lat, lon, source), self._areas)
            out += [(key[0], *event, None, None, None) for event in events]
        # A report more than half an hour after the last one starts afresh, so a quiet vessel needs no state.
        ends = (memory["last"][0] // 1000 + QUIET_MS) if memory.get("last") else 0
        if not waiting and mark > ends:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps({"memory": memory, "waiting": waiting}),))
            state.setTimeoutTimestamp(max(min(waiting) // 1000 if waiting else ends, mark) + 1)
        if out or late:
            mmsi, area, entered, before, confirmed, source, observed, lat, lon = zip(*out, *late)
            yield pd.DataFrame({
                "mmsi": mmsi, "area": area, "entered": _stamps(entered), "before": _stamps(before), "confirmed": _stamps(confirmed),
                "source": source, "observed": _stamps(observed), "lat": np.array(lat, dtype="float64"), "lon": np.array(lon, dtype="float64")})


STATIC_FIELDS = ("name", "call_sign", "destination", "category")
RETENTION_MS = 2 * 3600 * 1000  # fixed value


def latest_vessel(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Newest position of a vessel with its non-null static fields; forgotten after two quiet hours of event time.

    Each Arrow batch is reduced to its newest rows, so memory does not grow
    with the number of reports. Most vessels have a few rows, so these are picked
    from plain arrays and lists. Missing times rank last, the later of equal rows wins.
    """
    if state.hasTimedOut:
        state.remove()
        return
    held = json.loads(state.get[0]) if state.exists else {"position": None, "static": {}}
    best, static = held["position"], held["static"]
    for pdf in batches:
        kind, seen, received = pdf["kind"].to_numpy(), _nanos(pdf["observed"]), _nanos(pdf["received"])
        pos = np.flatnonzero(kind == "position")
        if len(pos):
            stamp = np.where(seen == NOT_A_TIME, received, seen)
            top = pos[np.lexsort((_missing_last(received[pos]), _missing_last(stamp[pos])))[-1]]
            sog = pdf["sog"].iat[top]
            cand = [int(stamp[top]) // 1000, int(received[top]) // 1000, float(pdf["lat"].iat[top]), float(pdf["lon"].iat[top]), None if pd.isna(sog) else float(sog)]
            if best is None or cand[:2] >= best[:2]:
                best = cand
        told = np.flatnonzero(kind == "static")
        ranks = list(zip(_missing_last(seen[told]).tolist(), _missing_last(received[told]).tolist()))
        for field in STATIC_FIELDS if len(told) else ():
            texts = pdf[field].to_numpy()[told].tolist()
            known = [(*rank, value, row) for rank, value, row in zip(ranks, texts, told) if isinstance(value, str)]
            if known:
                *_, value, row = max(known)
                at = int(seen[row]) // 1000
                if field not in static or at >= static[field][0]:
                    static[field] = [at, value]
    state.update((json.dumps({"position": best, "static": static}),))
    newest = max([best[0] if best else 0, *[v[0] for v in static.values()]]) // 1000
    state.setTimeoutTimestamp(max(newest + RETENTION_MS, state.getCurrentWatermarkMs()) + 1)
    if best is not None:
        fields = json.dumps({k: v[1] for k, v in sorted(static.items())}, ensure_ascii=False)
        yield pd.DataFrame({"mmsi": [key[0]], "observed": _stamps([best[0]]), "received": _stamps([best[1]]), "lat": [best[2]], "lon": [best[3]], "sog": [best[4]], "static": [fields]})
