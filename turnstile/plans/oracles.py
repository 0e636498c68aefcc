"""DuckDB SQL that the queries are held against: common parts."""

from __future__ import annotations

from turnstile.operators.timeline import LONG_MAX, Policy
from turnstile.plans import views

FAIL = f"""SELECT {views.IP} AS ip, 'sshd' AS jail, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS pattern_idx FROM events WHERE event_type IN ('error', 'view', 'click')"""


def multi_fail(jails: dict[str, Policy]) -> str:
    return f"SELECT f.ip, j.jail, f.ts, f.seq, f.pattern_idx FROM ({FAIL}) f, (VALUES {', '.join(f'({chr(39)}{j}{chr(39)})' for j in jails)}) j(jail)"


def _length(p: Policy) -> str:
    if not p.increment or p.ban_time < 0:
        return str(p.ban_time)
    times = f"CAST({list(p.multipliers)} AS DOUBLE[])[CAST(least(cnt + 1, {len(p.multipliers)}) AS BIGINT)]" if p.multipliers else "pow(2.0, least(cnt, 20))"
    grown = f"CAST(trunc({p.ban_time} * {times} * {p.factor}) AS BIGINT)"
    return f"least({grown}, {p.maxtime})" if p.maxtime > 0 else grown


def timeline(jails: dict[str, Policy], failures: str, commands: str | None = None, later: dict[str, Policy] | None = None, at: int = 0) -> str:
    """CTEs ev and st and bans: the fold over an address's events, one event a step of the recursion; from ``at`` on, policies are ``later``."""
    n = list(enumerate(jails.items()))
    pick = lambda col, other="NULL": "CASE jail " + " ".join(f"WHEN '{j}' THEN {col(i, p)}" for i, (j, p) in n) + f" ELSE {other} END"
    rule = pick
    if later is not None:
        after = lambda col: "CASE jail " + " ".join(f"WHEN '{j}' THEN {col(0, p)}" for j, p in later.items()) + " ELSE NULL END"
        rule = lambda col: f"CASE WHEN ts < {at} THEN {pick(col)} ELSE {after(col)} END"
    more = f" UNION ALL SELECT ip, jail, ts, seq, cmd FROM ({commands}) c" if commands else ""
    start = ", ".join(f"CAST([] AS BIGINT[]) AS r{i}, CAST(NULL AS BIGINT) AS u{i}" for i, _ in n)
    step = ", ".join(f"CASE WHEN jail = '{j}' THEN ring ELSE r{i} END AS r{i}, CASE WHEN jail <> '{j}' THEN u{i} WHEN bt IS NOT NULL THEN coalesce(expires, {LONG_MAX}) WHEN kind = 'unban' AND active THEN NULL ELSE u{i} END AS u{i}" for i, (j, _) in n)
    return f"""
ev AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, seq, jail, kind) AS rn FROM (SELECT ip, jail, ts, seq, 'failure' AS kind FROM ({failures}) f{more})),
st AS (
  SELECT ip, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cnt, {start}, CAST(NULL AS VARCHAR) AS jail, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS kind, false AS active, CAST(NULL AS BIGINT) AS bt, CAST(NULL AS BIGINT) AS expires
  FROM (SELECT DISTINCT ip FROM ev)
  UNION ALL
  SELECT ip, rn, CASE WHEN hit THEN cnt + 1 ELSE cnt END, {step}, jail, ts, seq, kind, active, bt, expires
  FROM (SELECT *, CASE WHEN bt < 0 THEN NULL ELSE ts + bt END AS expires
    FROM (SELECT *, CAST(CASE WHEN hit THEN {rule(lambda i, p: _length(p))} WHEN kind = 'ban' AND known AND NOT active THEN 3600 END AS BIGINT) AS bt
      FROM (SELECT *, kind = 'failure' AND known AND NOT active AND len(ring) = maxr AND ts - ring[1] < ft AS hit
        FROM (SELECT *, CASE WHEN kind = 'failure' AND known AND NOT active THEN list_slice(list_append(old, ts), greatest(1, len(old) + 2 - maxr), len(old) + 1) ELSE old END AS ring
          FROM (SELECT *, maxr IS NOT NULL AS known, coalesce(until > ts, false) AS active
            FROM (SELECT st.ip, e.rn, st.cnt, {', '.join(f'st.r{i}, st.u{i}' for i, _ in n)}, e.jail, e.ts, e.seq, e.kind,
                {pick(lambda i, p: f'st.r{i}').replace('CASE jail', 'CASE e.jail')} AS old, {pick(lambda i, p: f'st.u{i}').replace('CASE jail', 'CASE e.jail')} AS until,
                {rule(lambda i, p: p.max_retry).replace('CASE jail', 'CASE e.jail').replace('WHEN ts <', 'WHEN e.ts <')} AS maxr, {rule(lambda i, p: p.find_time).replace('CASE jail', 'CASE e.jail').replace('WHEN ts <', 'WHEN e.ts <')} AS ft
              FROM st JOIN ev e ON e.ip = st.ip AND e.rn = st.rn + 1)))))) x),
bans AS (SELECT ip, jail, ts AS banned_at, expires AS expires_at, bt AS ban_time, CAST(cnt AS INT) AS ban_count, kind = 'ban' AS manual, seq, expires AS ended_at FROM st WHERE bt IS NOT NULL)"""


STANDARD = "WITH RECURSIVE " + timeline(views.STANDARD, FAIL)
MULTI = "WITH RECURSIVE " + timeline(views.JAILS, multi_fail(views.JAILS))
MANUAL = "WITH RECURSIVE " + timeline(views.STANDARD, FAIL, views.DUCK["COMMANDS"])
CHANGED = "WITH RECURSIVE " + timeline(views.JAILS, multi_fail(views.JAILS), later=views.LATER, at=views.T1)
