"""The ban timeline as a stream: rows put back in order, keyed state that empties itself, expiry timers, policies by time.

Rows of an address wait in a list until the watermark has passed their time; then they are taken in the order of time, number and jail,
as the batch fold takes them. So files may land in any order within ``delay``, and the changes equal the batch timeline's.

Each address has one timer, at the next moment something is due: a waiting row, the end of a ban, or the moment when a ring's
newest failure is find_time old. What is then out of reach goes: failures older than any find_time of their jail, rings without
failures, ended bans (reported as unbans), and in the end the address, if it was never banned. Of one that was, the shared ban number stays
(it never falls by the rules); ``keep_counts`` gives up that too after so many seconds.

Policies come as in the batch fold: one mapping, or versions by the time from which they hold. When others become valid, bans
and numbers stay; a ring of a jail that any later version misses goes when its address is next seen. A stream that is started again
from its checkpoint with more versions carries its state over.

Rows that come later than ``delay`` behind the newest are left out by Spark. With a delay of None rows are taken as they arrive,
sorted within a batch only: there is no watermark then, so no timers, no unbans of expired bans, and nothing leaves the state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstile.operators.timeline import LONG_MAX, MANUAL_BAN, Address, Policies, versions_of

OUTPUT = "kind string, ip string, jail string, banned_at long, expires_at long, ban_time long, ban_count int, manual boolean, seq long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
WAITING = ["ts", "seq", "jail", "kind"]


class Tracker(StatefulProcessor):
    """Per address one row of state (rings, bans, the shared number, the timer) and the rows that wait."""

    def __init__(self, policies: Policies, ordered: bool = True, keep_counts: int | None = None):
        self.versions, self.ordered, self.keep_counts = versions_of(policies), ordered, keep_counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.address = handle.getValueState("address", "ring_jails array<string>, rings array<array<long>>, ban_jails array<string>, ends array<long>, n int, last long, timer long")
        self.waiting = handle.getListState("waiting", "ts long, seq long, jail string, kind string")

    # Rows from the state and back.

    def _load(self) -> tuple[Address, int, int | None]:
        """The address, the time of its last row, and its timer."""
        state = Address()
        if not self.address.exists():
            return state, -LONG_MAX, None
        jails, rings, banned, ends, state.count, last, timer = self.address.get()
        state.rings = {j: deque(r) for j, r in zip(jails, rings)}
        state.until = {j: None if end == LONG_MAX else end for j, end in zip(banned, ends)}
        return state, last, timer

    def _save(self, state: Address, last: int, timer: int | None) -> None:
        if not state.rings and not state.until and not state.count and timer is None:
            self.address.clear()
            return
        ends = [LONG_MAX if end is None else end for end in state.until.values()]
        self.address.update((list(state.rings), [list(r) for r in state.rings.values()], list(state.until), ends, state.count, last, timer))

    # The rules.

    def _policies(self, ts: int) -> dict:
        valid: dict = {}
        for since, jails in self.versions:
            if since <= ts:
                valid = jails
        return valid

    def _reach(self, jail: str, now: int) -> int:
        """The longest find_time of a jail in the version that is valid now and in later ones."""
        later = [jails for since, jails in self.versions if since > now]
        return max((v[jail].find_time for v in [self._policies(now), *later] if jail in v), default=0)

    def _settle(self, state: Address, ip: str, last: int, now: int) -> list[tuple]:
        """Lets go of what is out of reach at a time; the unbans of bans that have ended by then."""
        ended = sorted((end, jail) for jail, end in state.until.items() if end is not None and end <= now)
        for _, jail in ended:
            del state.until[jail]
        out = [("unban", ip, jail, end, None, None, state.count, False, None) for end, jail in ended]
        for jail, ring in list(state.rings.items()):
            reach = self._reach(jail, now)
            while ring and ring[0] + reach <= now:
                ring.popleft()
            if not ring:
                del state.rings[jail]
        if self.keep_counts is not None and not state.rings and not state.until and last + self.keep_counts <= now:
            state.count = 0
        return out

    def _take(self, state: Address, ip: str, row: tuple) -> tuple | None:
        ts, seq, jail, kind = row
        for held in list(state.rings):
            newest = state.rings[held][-1]
            if any(newest < since <= ts and held not in jails for since, jails in self.versions):
                del state.rings[held]
        policy = self._policies(ts).get(jail)
        known = policy is not None and policy.enabled
        if kind == "failure":
            ban = state.failure(jail, ts, policy) if known else None
            return None if ban is None else ("ban", ip, jail, ts, ban[1], ban[0], ban[2], False, seq)
        if kind == "ban" and known and not state.banned(jail, ts):
            return ("ban", ip, jail, ts, state.ban(jail, ts, MANUAL_BAN), MANUAL_BAN, state.count, True, seq)
        if kind == "unban" and known and state.banned(jail, ts):
            del state.until[jail]
            return ("unban", ip, jail, ts, None, None, state.count, True, seq)
        return ("reject", ip, jail, ts, None, None, state.count, True, seq)

    def _next(self, state: Address, last: int, rest: list[tuple]) -> int | None:
        due = [rest[0][0]] if rest else []
        due += [end for end in state.until.values() if end is not None]
        due += [ring[-1] + self._reach(jail, ring[-1]) for jail, ring in state.rings.items()]
        if not due and not state.until and self.keep_counts is not None:
            due.append(last + self.keep_counts)
        return min(due, default=None)

    def _advance(self, ip: str, rows: list[tuple], now: int, fired: bool = False) -> pd.DataFrame:
        """Takes rows up to the watermark, lets go of what is out of reach, and sets the timer."""
        state, last, timer = self._load()
        if fired:
            timer = None
        out, rows = [], sorted(rows)
        due = sum(r[0] <= now for r in rows) if self.ordered else len(rows)
        for row in rows[:due]:
            if self.ordered:
                out += self._settle(state, ip, last, row[0])
            change = self._take(state, ip, row)
            if change is not None:
                out.append(change)
            last = max(last, row[0])
        rest = rows[due:]
        if self.ordered:
            out += self._settle(state, ip, last, now)
            wanted = self._next(state, last, rest)
            if wanted != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer * 1000)
                if wanted is not None:
                    self.handle.registerTimer(wanted * 1000)
            timer = wanted
        self._save(state, last, timer)
        if due and rest:
            self.waiting.put(rest)
        elif due and self.ordered:
            self.waiting.clear()
        return self._frame(out)

    # What Spark calls.

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Bans of an earlier run: jail, expires_at (null: for ever), ban_count."""
        state = Address()
        for r in initialState.itertuples():
            state.until[r.jail] = None if pd.isna(r.expires_at) else int(r.expires_at)
            state.count = max(state.count, int(r.ban_count))
        timer = self._next(state, -LONG_MAX, []) if self.ordered else None
        if timer is not None:
            self.handle.registerTimer(timer * 1000)
        self._save(state, -LONG_MAX, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*[pdf[c].tolist() for c in WAITING])]
        if not self.ordered:
            yield self._advance(key[0], new, LONG_MAX)
            return
        # All rows are newer than the watermark: they wait, and the earliest of them sets the timer.
        self.waiting.appendList(new)
        state, last, timer = self._load()
        first = min(new)[0]
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer * 1000)
            self.handle.registerTimer(first * 1000)
            self._save(state, last, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        yield self._advance(key[0], list(self.waiting.get()) if self.waiting.exists() else [], now, True)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=NAMES).astype({"expires_at": "Int64", "ban_time": "Int64", "ban_count": "Int32", "seq": "Int64", "manual": "boolean"})

    def close(self) -> None:
        pass


def track(events: DataFrame, policies: Policies, initial: DataFrame | None = None, delay: str | None = "1 day", keep_counts: int | None = None) -> DataFrame:
    """Streaming events (ip, jail, ts, seq, kind) to bans, unbans and rejected commands."""
    rows = events.select("ip", *WAITING)
    if delay is not None:
        rows = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    start = None if initial is None else initial.groupBy("ip")
    tracker = Tracker(policies, delay is not None, keep_counts)
    return rows.groupBy("ip").transformWithStateInPandas(statefulProcessor=tracker, outputStructType=OUTPUT, outputMode="append", timeMode="None" if delay is None else "EventTime", initialState=start)
