"""The ban timeline: an ordered fold over each address's failures and manual commands.

A failure of a banned address is counted but not remembered. A ring of the last max_retry failures of each jail decides;
it is kept after a ban. An address's ban number is shared by its jails and never falls. Events are taken in the order
of time, then number, then jail. Rows are dealt by address and sorted, so the fold streams: what it holds of an address
is its rings and its bans, never its history.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from turnstile.operators import rules
from turnstile.sources.tables import written

LONG_MAX = (1 << 63) - 1
MANUAL_BAN = 3600


@dataclass(frozen=True)
class Policy:
    """A jail's rule; a negative ban_time is for ever."""

    max_retry: int = 5
    find_time: int = 600
    ban_time: int = 3600
    increment: bool = False
    multipliers: tuple[int, ...] = ()
    factor: float = 1.0
    maxtime: int = 604800
    enabled: bool = True
    restore: bool = True

    def length(self, count: int) -> int:
        """The length of an address's next ban, after count earlier ones."""
        if not self.increment or self.ban_time < 0:
            return self.ban_time
        times = self.multipliers[min(count, len(self.multipliers) - 1)] if self.multipliers else 2 ** min(count, 20)
        grown = min(int(min(self.ban_time * float(times) * self.factor, 9.3e18)), LONG_MAX)
        return min(grown, self.maxtime) if self.maxtime > 0 else grown


class Address:
    """What is remembered of one address."""

    def __init__(self) -> None:
        self.rings: dict[str, deque[int]] = {}
        self.until: dict[str, int | None] = {}
        self.count = 0

    def banned(self, jail: str, now: int) -> bool:
        if jail not in self.until:
            return False
        end = self.until[jail]
        if end is None or end > now:
            return True
        del self.until[jail]
        return False

    def ban(self, jail: str, now: int, length: int) -> int | None:
        self.until[jail] = None if length < 0 else min(now + length, LONG_MAX)
        return self.until[jail]

    def failure(self, jail: str, now: int, policy: Policy) -> tuple[int, int | None, int] | None:
        """(length, end, number) of a ban that the failure leads to."""
        if self.banned(jail, now):
            return None
        ring = self.rings.get(jail)
        if ring is None or ring.maxlen != policy.max_retry:
            ring = self.rings[jail] = deque(ring or (), maxlen=policy.max_retry)
        ring.append(now)
        if len(ring) < policy.max_retry or now - ring[0] >= policy.find_time:
            return None
        length = policy.length(self.count)
        self.count += 1
        return length, self.ban(jail, now, length), self.count


Policies = dict[str, Policy] | list[tuple[int, dict[str, Policy]]]


def versions_of(policies: Policies) -> list[tuple[int, dict[str, Policy]]]:
    """Policies as (valid from, by jail), in order of time; one mapping is valid from the beginning."""
    return [(-LONG_MAX, policies)] if isinstance(policies, dict) else sorted(policies, key=lambda v: v[0])


EVENTS = ["ip", "jail", "ts", "seq", "kind"]
SCHEMA = "kind string, ip string, jail string, banned_at long, expires_at long, ban_time long, ban_count int, manual boolean, seq long"


def fold(policies: Policies):
    """Sorted events to rows of kind ban, unban (by hand) or reject.

    An event is judged by the policies that are valid at its time. When others become valid, bans and counts stay, and so do rings
    but those of jails that are then missing.
    """
    versions = versions_of(policies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, state, v = None, Address(), 0
        for pdf in batches:
            out = []
            for who, jail, ts, seq, kind in zip(*[pdf[c] for c in EVENTS]):
                if who != ip:
                    ip, state, v = who, Address(), 0
                while v + 1 < len(versions) and versions[v + 1][0] <= ts:
                    v += 1
                    state.rings = {j: r for j, r in state.rings.items() if j in versions[v][1]}
                policy = versions[v][1].get(jail) if versions[v][0] <= ts else None
                known = policy is not None and policy.enabled
                if kind == "failure":
                    if known and (b := state.failure(jail, ts, policy)) is not None:
                        out.append(("ban", ip, jail, ts, b[1], b[0], b[2], False, seq))
                elif kind == "ban":
                    if known and not state.banned(jail, ts):
                        out.append(("ban", ip, jail, ts, state.ban(jail, ts, MANUAL_BAN), MANUAL_BAN, state.count, True, seq))
                    else:
                        out.append(("reject", ip, jail, ts, None, None, state.count, True, seq))
                elif known and state.banned(jail, ts):
                    del state.until[jail]
                    out.append(("unban", ip, jail, ts, None, None, state.count, True, seq))
                else:
                    out.append(("reject", ip, jail, ts, None, None, state.count, True, seq))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"expires_at": "Int64", "ban_time": "Int64", "ban_count": "Int32"})

    return run


def events(failures: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Failures and manual commands (ts, seq, cmd, ip, jail) as one ordered input."""
    rows = failures.select("ip", "jail", "ts", "seq", F.lit("failure").alias("kind"))
    if commands is not None:
        rows = rows.unionByName(commands.select("ip", "jail", "ts", "seq", F.col("cmd").alias("kind")))
    return rows


def all_rows(failures: DataFrame, policies: Policies, commands: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """Bans, manual unbans and rejected commands. Addresses that never reach a raw threshold are left out before the fold.

    Failures are written out first, so that lines are matched once, and so is the timeline, which is folded once however often it is read.
    """
    failures = written(failures, "failures")
    rows = events(failures, commands)
    if prune:
        hits = rules.reached(failures, [(j, p.max_retry, p.find_time) for _, jails in versions_of(policies) for j, p in jails.items()]).select("ip")
        if commands is not None:
            hits = hits.union(commands.select("ip"))
        rows = rows.join(hits.distinct(), "ip", "left_semi")
    # By a hash of its own: an exchange by the join's very key is taken for the join's and left out, and an adaptive plan that then
    # broadcasts the hits reads that one by mapper, which spreads an address over several folds.
    rows = rows.repartition(F.xxhash64("ip")).sortWithinPartitions("ip", "ts", "seq", "jail", "kind")
    return written(rows.mapInPandas(fold(policies), SCHEMA), "timeline")


def bans(failures: DataFrame, policies: Policies, commands: DataFrame | None = None) -> DataFrame:
    """The timeline, with each ban's real end (a manual unban may come before it expires)."""
    rows = all_rows(failures, policies, commands)
    if commands is None:
        return rows.filter("kind = 'ban'").drop("kind").withColumn("ended_at", F.col("expires_at"))
    out = rows.filter("kind = 'ban'").drop("kind")
    lifted = rows.filter("kind = 'unban'").select(F.col("ip").alias("_ip"), F.col("jail").alias("_jail"), F.col("banned_at").alias("_at"), F.col("seq").alias("_seq"))
    on = (F.col("ip") == F.col("_ip")) & (F.col("jail") == F.col("_jail")) & (F.col("_at") >= F.col("banned_at")) & (F.col("expires_at").isNull() | (F.col("_at") < F.col("expires_at")))
    joined = out.join(lifted, on, "left").groupBy(*out.columns).agg(F.min("_at").alias("_at"))
    return joined.withColumn("ended_at", F.coalesce("_at", "expires_at")).drop("_at")


def active_at(bans_: DataFrame, t: int) -> DataFrame:
    return bans_.filter((F.col("banned_at") <= t) & (F.col("ended_at").isNull() | (F.col("ended_at") > t)))


#: Width of the finest buckets of time, in seconds, and how many times coarser each further level is.
BUCKET, COARSER = 3600, 16
#: Levels of buckets; the last one takes what is longer, and bans without an end. Its buckets are dealt in SIDE x SIDE parts.
LEVELS, SIDE = 5, 8


def active_at_each(bans_: DataFrame, instants: DataFrame, column: str = "t") -> DataFrame:
    """instants joined with the bans that are open at each (ip, jail, banned_at, expires_at, ended_at): one row for each such pair.

    An interval join by buckets of time. A ban lies in two buckets at most of the finest level whose buckets are as long as it is,
    and an instant looks into one bucket a level, so neither side grows with the length of a ban. A bucket's pairs share a
    level's width of time, so a fixed part of them at least are rows of the result. Bans of the last level, of years or without an end, lie
    in each of its buckets up to the newest instant; one bucket holds most of them, so bans are dealt in SIDE parts there and instants in
    SIDE others, and each part of the ones meets each of the others. Instants bring all their columns along: pairs leave the join as rows of
    the result, and nothing as large as the result is shuffled.
    """
    width = [BUCKET * COARSER**k for k in range(LEVELS)]
    b = bans_.select("ip", "jail", "banned_at", "expires_at", "ended_at").filter("ended_at IS NULL OR ended_at > banned_at")
    last = F.coalesce(F.col("ended_at") - 1, F.lit(None).cast("long"))
    lasts = last - F.col("banned_at")
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(lasts < width[k], k).otherwise(level)
    of = lambda ts, k: F.floor(ts / F.element_at(F.array(*map(F.lit, width)), k + 1)).cast("long")
    times = instants.withColumn("_t", F.col(column).cast("long")).filter("_t IS NOT NULL")
    newest = times.agg(F.max("_t").alias("_newest"))
    dealt = b.withColumn("_level", level).crossJoin(F.broadcast(newest))  # one row
    end = F.least(F.coalesce(last, F.col("_newest")), F.col("_newest"))
    ban_part = F.pmod(F.xxhash64("ip"), F.lit(SIDE)).cast("int")
    parts = F.when(F.col("_level") == LEVELS - 1, F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda j: ban_part * SIDE + j)).otherwise(F.array(F.lit(0)))
    dealt = dealt.filter(F.col("banned_at") <= F.col("_newest")).withColumn("_bucket", F.explode(F.sequence(of(F.col("banned_at"), F.col("_level")), F.greatest(of(end, F.col("_level")), of(F.col("banned_at"), F.col("_level")))))).withColumn("_part", F.explode(parts))
    # By all columns that can be hashed, so instants of one time are dealt as well.
    own_part = F.pmod(F.xxhash64(*[f.name for f in times.schema if isinstance(f.dataType, AtomicType)]), F.lit(SIDE)).cast("int")
    looks = [(k, F.lit(0)) for k in range(LEVELS - 1)] + [(LEVELS - 1, F.lit(i * SIDE) + own_part) for i in range(SIDE)]
    asked = times.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("_level"), part.alias("_part")) for k, part in looks]))).withColumn("_bucket", of(F.col("_t"), F.col("_level")))
    open_ = (F.col("banned_at") <= F.col("_t")) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.col("_t")))
    return asked.join(dealt, ["_level", "_part", "_bucket"]).filter(open_).select(*instants.columns, "ip", "jail", "banned_at", "expires_at", "ended_at")


def changes(bans_: DataFrame) -> DataFrame:
    """The change feed: a row where a ban begins, and one where it ends."""
    starts = bans_.select(F.col("banned_at").alias("ts"), F.lit("ban").alias("kind"), "ip", "jail", "ban_time")
    ends = bans_.filter("ended_at IS NOT NULL").select(F.col("ended_at").alias("ts"), F.lit("unban").alias("kind"), "ip", "jail", F.lit(None).cast("long").alias("ban_time"))
    return starts.unionByName(ends)
