"""The queries, each beside the SQL it is held against (None: no form in SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.functions import addr, eventtime, labels
from turnstile.operators import enrich, extract, reports, rules, timeline
from turnstile.plans import oracles as O
from turnstile.plans import views as V
from turnstile.plans.catalogue import HOST, catalogue, expand, gate, patterns_of
from turnstile.sources import ledger
from turnstile.sources import lines as L
from turnstile.sources import policy as P
from turnstile.sources.tables import folder, written
from turnstile.streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SSHD = patterns_of("sshd")
FAILING = [("sshd", SSHD)]
T1, T2 = V.T1, V.T2


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fails(spark: SparkSession, sf: str) -> DataFrame:
    return extract.failures(V.auth_log(spark, sf), FAILING)


def multi_fails(spark: SparkSession, sf: str) -> DataFrame:
    return extract.failures(V.auth_log(spark, sf), [(j, SSHD) for j in V.JAILS])


def bans(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.bans(fails(spark, sf), V.STANDARD)


def multi_bans(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.bans(multi_fails(spark, sf), V.JAILS)


def with_bans(spark: SparkSession, sf: str, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """Failures and bans of the standard jail, or of all; lines are matched once for both."""
    f = written(multi_fails(spark, sf) if many else fails(spark, sf), "failures")
    return f, timeline.bans(f, V.JAILS if many else V.STANDARD)


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(j, p.enabled, p.max_retry, p.find_time, p.ban_time, p.restore, ["22"] if j == "sshd" else ["22", "2222"], "tcp") for j, p in V.JAILS.items()]
    rows.append(("disabled", False, 3, 600, 60, True, [], "tcp"))
    return spark.createDataFrame(rows, "jail string, enabled boolean, max_retry int, find_time long, ban_time long, reban_on_restart boolean, port array<string>, protocol string")


def matched(jail: str, patterns) -> str:
    """A CASE that yields the token of the first pattern that matches, for DuckDB."""
    parts = []
    for p in patterns:
        g = f"contains(line, {sql_text(gate(p))}) AND " if gate(p) else ""
        parts.append(f"WHEN {g}regexp_matches(line, {sql_text(expand(p))}) THEN regexp_extract(line, {sql_text(expand(p))}, 1)")
    return f"CASE {' '.join(parts)} END"


def matched_idx(patterns) -> str:
    parts = [f"WHEN {f'contains(line, {sql_text(gate(p))}) AND ' if gate(p) else ''}regexp_matches(line, {sql_text(expand(p))}) THEN {i}" for i, p in enumerate(patterns)]
    return f"CASE {' '.join(parts)} END"


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"SELECT CAST(length(line) AS INT) + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS n, concat(upper(line), CASE WHEN seq % 5 = 0 THEN chr(13) ELSE '' END) AS loud FROM ({V.AUTH}) a")
def scan_log(spark, sf):
    """A log in files, some of whose lines end in a carriage return, which stays: only line feeds split."""
    path = folder(spark, "scan")
    L.write_log(V.auth_log(spark, sf).withColumn("line", F.concat("line", F.when(F.col("seq") % 5 == 0, "\r").otherwise(""))), path)
    return L.read_log(spark, path).select(F.length("line").alias("n"), F.upper("line").alias("loud"))


@query(f"SELECT seq, line FROM ({V.AUTH}) a WHERE (contains(line, 'Failed') OR contains(line, 'Invalid')) AND seq % 3 <> 1")
def journal_filter(spark, sf):
    unit = F.when(F.col("line").contains("Failed"), "ssh.service").when(F.col("line").contains("Invalid"), "sshd.service").otherwise("cron.service")
    entries = V.auth_log(spark, sf).select("seq", F.col("line").alias("MESSAGE"), unit.alias("_SYSTEMD_UNIT"), F.when(F.col("seq") % 3 == 1, "stdout").otherwise("syslog").alias("_TRANSPORT"))
    return L.journal_lines(entries, {"_SYSTEMD_UNIT": ["ssh.service", "sshd.service"], "_TRANSPORT": ["syslog"]}).select("seq", "line")


@query(f"SELECT doc_id AS seq, rtrim(text, {sql_text(extract.BLANKS)}) AS line FROM documents WHERE strlen(text) <= 65536")
def line_hygiene(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("text").alias("line"))
    return extract.clean_lines(docs)


_LONG = "SELECT doc_id AS seq, repeat(text, CASE WHEN doc_id % 10 = 0 THEN 30 ELSE 1 END) AS line FROM documents"


@query(f"SELECT seq, rtrim(line, {sql_text(extract.BLANKS)}) AS line FROM ({_LONG}) d WHERE strlen(line) <= 65536")
def clean_long_lines(spark, sf):
    """Lines on both sides of the bound."""
    return extract.clean_lines(V.read(spark, sf, _LONG, "documents"))


#: Runs of blanks of several kinds inside lines and at their ends.
_BLANK = "SELECT doc_id AS seq, concat(text, repeat(' ', CAST(doc_id % 500 AS INT)), '\u00a0', CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END, '\u3000\t\u2028', CASE WHEN doc_id % 5 = 0 THEN '\u200b' ELSE '\u0085' END, '  ') AS line FROM documents"


@query(f"SELECT seq, rtrim(line, {sql_text(extract.BLANKS)}) AS line FROM ({_BLANK}) d WHERE strlen(line) <= 65536")
def clean_blank_ends(spark, sf):
    """White space of all alphabets goes from the ends of lines, and none from within."""
    return extract.clean_lines(V.read(spark, sf, _BLANK, "documents"))


@query(f"SELECT line FROM ({V.AUTH}) a")
def log_files(spark, sf):
    """The log as text files, read back."""
    path = folder(spark, "log")
    L.write_log(V.auth_log(spark, sf), path)
    return L.read_log(spark, path).select("line")


@query(f"SELECT line FROM ({V.AUTH}) a")
def chunks_once(spark, sf):
    """Chunks of a log that land cut short, then grown under other names, then some of them again: every line once."""
    base, log = folder(spark, "chunks"), V.auth_log(spark, sf)
    ends = log.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    width = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // 6 + 1)
    at = F.col("seq") - (ends["a"] or 0)
    chunk = F.floor(at / width)
    for name, some in (("a", at % width < 0.6 * width), ("b", F.lit(True)), ("c", (at % width < 0.6 * width) & (chunk % 2 == 0))):
        part = log.filter(some).select(chunk.alias("chunk"), "seq", "line").repartition("chunk").sortWithinPartitions("chunk", "seq")
        part.select("chunk", "line").write.partitionBy("chunk").option("lineSep", "\n").text(f"{base}/in/{name}")
        lines = ledger.follow_chunks(spark, f"{base}/in/*/*/*.txt", base)
    return lines.select("line")


@query(f"SELECT CAST(seq AS VARCHAR) AS at, line FROM ({V.AUTH}) a WHERE contains(line, 'Failed') OR contains(line, 'Invalid')")
def journal_files(spark, sf):
    """A journal's JSON export as files, read back with field matches; entries without a message drop out."""
    path = folder(spark, "journal")
    unit = F.when(F.col("line").contains("Failed"), "ssh.service").when(F.col("line").contains("Invalid"), "sshd.service").otherwise("cron.service")
    entries = V.auth_log(spark, sf).select(F.col("line").alias("MESSAGE"), F.col("seq").alias("__REALTIME_TIMESTAMP"), unit.alias("_SYSTEMD_UNIT"))
    L.write_journal(entries.unionByName(entries.withColumn("MESSAGE", F.lit("  "))), path)
    found = L.read_journal(spark, path, {"_SYSTEMD_UNIT": ["ssh.service", "sshd.service"]})
    return found.select(F.col("__REALTIME_TIMESTAMP").alias("at"), "line")


@query(O.MULTI + f" SELECT ip, jail, banned_at, coalesce(expires_at <= {T1}, false) AS expired FROM bans")
def ban_table(spark, sf):
    """Bans as a table, read back as live and expired ones."""
    path = folder(spark, "bans")
    multi_bans(spark, sf).write.parquet(path)
    live, expired = L.read_bans(spark, path, T1)
    return live.withColumn("expired", F.lit(False)).unionByName(expired.withColumn("expired", F.lit(True))).select("ip", "jail", "banned_at", "expired")


_SPARSE = "SELECT CAST(s_suppkey AS VARCHAR) AS jail, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 9 END AS max_retry, CASE WHEN s_suppkey % 3 = 0 THEN 60 * s_suppkey END AS find_time, CASE WHEN s_suppkey % 5 = 0 THEN 'udp' END AS protocol, CASE WHEN s_suppkey % 7 = 0 THEN false END AS enabled FROM supplier"


@query(f"SELECT jail, coalesce(max_retry, 5) AS max_retry, coalesce(find_time, 600) AS find_time, coalesce(protocol, 'tcp') AS protocol, coalesce(enabled, true) AS enabled FROM ({_SPARSE}) p")
def policy_defaults(spark, sf):
    return P.with_defaults(V.read(spark, sf, _SPARSE, "supplier"))


_LAYERS = "SELECT concat('j', CAST(l_suppkey % 50 AS VARCHAR)) AS jail, l_orderkey * 8 + l_linenumber AS layer, CASE WHEN l_linenumber <> 2 THEN l_partkey END AS max_retry, CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS find_time FROM lineitem"


@query(f"SELECT jail, arg_max(max_retry, layer) FILTER (WHERE max_retry IS NOT NULL) AS max_retry, arg_max(find_time, layer) FILTER (WHERE find_time IS NOT NULL) AS find_time FROM ({_LAYERS}) l GROUP BY jail")
def policy_overlay(spark, sf):
    return P.overlay(V.read(spark, sf, _LAYERS, "lineitem"), ["max_retry", "find_time"])


_CHECKED = """SELECT concat(CASE WHEN s_suppkey % 11 = 0 THEN 'bad name ' ELSE 'j-' END, CAST(s_suppkey AS VARCHAR)) AS jail, s_suppkey % 7 <> 0 AS enabled,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '/var/log/x' END AS log_path, CASE WHEN s_suppkey % 4 = 0 THEN 'journal' ELSE 'file' END AS log_backend,
  CASE WHEN s_suppkey % 6 = 0 THEN 'no place' ELSE 'from <HOST>' END AS pattern, s_suppkey % 3 AS max_retry, 60 * (s_suppkey % 4) AS find_time, s_suppkey % 8 - 1 AS ban_time,
  CASE WHEN s_suppkey % 9 = 0 THEN '70000' ELSE '22' END AS port, CASE WHEN s_suppkey % 10 = 0 THEN 'icmp' ELSE 'tcp' END AS protocol, (s_suppkey % 13) / 2.0 - 1 AS bantime_factor FROM supplier"""


@query(f"""WITH p AS ({_CHECKED}) SELECT jail, 'name' AS violation FROM p WHERE NOT regexp_full_match(jail, '[A-Za-z0-9_-]{{1,64}}')
UNION ALL SELECT jail, 'log_path' FROM p WHERE enabled AND log_backend = 'file' AND log_path = ''
UNION ALL SELECT jail, 'pattern' FROM p WHERE enabled AND NOT contains(pattern, '<HOST>')
UNION ALL SELECT jail, 'max_retry' FROM p WHERE enabled AND max_retry <= 0 UNION ALL SELECT jail, 'find_time' FROM p WHERE enabled AND find_time <= 0
UNION ALL SELECT jail, 'ban_time' FROM p WHERE enabled AND ban_time = 0 UNION ALL SELECT jail, 'port' FROM p WHERE enabled AND CAST(port AS BIGINT) > 65535
UNION ALL SELECT jail, 'protocol' FROM p WHERE enabled AND protocol NOT IN ('tcp', 'udp', 'sctp', 'dccp')
UNION ALL SELECT jail, 'bantime_factor' FROM p WHERE enabled AND bantime_factor <= 0""")
def policy_violations(spark, sf):
    rows = V.read(spark, sf, _CHECKED, "supplier").withColumn("filter", F.array("pattern")).withColumn("port", F.array("port"))
    return P.violations(rows.withColumn("bantime_factor", F.col("bantime_factor").cast("double")))


_DURATIONS = "SELECT s_suppkey AS k, concat(CAST(s_suppkey * s_suppkey AS VARCHAR), CASE s_suppkey % 8 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' WHEN 3 THEN 'd' WHEN 4 THEN 'w' WHEN 5 THEN 'y' WHEN 6 THEN ' ' ELSE '99999999999999999999' END) AS txt FROM supplier"


@query(f"""SELECT k, txt, CASE WHEN regexp_matches(trim(txt), '^[0-9]+[smhdw]?$') THEN TRY_CAST(regexp_extract(trim(txt), '^([0-9]+)', 1) AS BIGINT) * CASE regexp_extract(trim(txt), '([smhdw]?)$', 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 ELSE 1 END END AS seconds FROM ({_DURATIONS}) d""")
def policy_durations(spark, sf):
    return V.read(spark, sf, _DURATIONS, "supplier").withColumn("seconds", labels.duration(F.col("txt")))


_CIDRS = "SELECT user_id AS k, concat('10.', CAST(user_id % 7 AS VARCHAR), '.', CAST(user_id % 300 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR), '/', CAST(event_id % 35 AS VARCHAR)) AS cidr FROM events"
_QUAD = "regexp_matches(split_part({c}, '/', 1), '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"


def _number(c: str) -> str:
    return " + ".join(f"CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))


@query(f"""WITH c AS (SELECT k, cidr, CAST(split_part(cidr, '/', 2) AS INT) AS bits, split_part(cidr, '/', 1) AS a FROM ({_CIDRS}) x),
n AS (SELECT *, CASE WHEN {_QUAD.format(c='cidr')} AND bits <= 32 THEN {_number('a')} END AS v FROM c)
SELECT k, cidr, CASE WHEN v IS NOT NULL THEN 4 END AS family, lower(printf('%08x', v - v % CAST(pow(2, 32 - bits) AS BIGINT))) AS lo, lower(printf('%08x', v - v % CAST(pow(2, 32 - bits) AS BIGINT) + CAST(pow(2, 32 - bits) AS BIGINT) - 1)) AS hi FROM n""")
def cidr_bounds(spark, sf):
    nets = addr.with_range(V.read(spark, sf, _CIDRS, "events"), "cidr")
    return nets.select("k", "cidr", "family", F.lower(F.hex("lo")).alias("lo"), F.lower(F.hex("hi")).alias("hi"))


@query(f"""SELECT ip, seq FROM ({O.FAIL}) f WHERE CAST(split_part(ip, '.', 4) AS BIGINT) % 16 <> 5 AND NOT (ip LIKE '127.%')""")
def own_addresses(spark, sf):
    """Addresses of an inventory of hosts are allow-listed as networks of one address, beside loopback."""
    f = fails(spark, sf)
    inventory = f.select("ip").distinct().filter("CAST(split_part(ip, '.', 4) AS BIGINT) % 16 = 5").select(F.lit(None).cast("string").alias("jail"), F.concat("ip", F.lit("/32")).alias("cidr"))
    return extract.drop_allowed(f, inventory).select("ip", "seq")


@query(O.STANDARD + f" SELECT ip, jail, banned_at, coalesce(expires_at <= {T1}, false) AS expired FROM bans")
def restore_split(spark, sf):
    live, expired = L.split_bans(bans(spark, sf), T1)
    return live.withColumn("expired", F.lit(False)).unionByName(expired.withColumn("expired", F.lit(True))).select("ip", "jail", "banned_at", "expired")


# --- matching --------------------------------------------------------------------------------------------------------


@query(f"SELECT seq, ip FROM (SELECT seq, {matched('sshd', SSHD)} AS ip FROM ({V.AUTH}) a) m WHERE ip IS NOT NULL")
def match_failures(spark, sf):
    return extract.match(V.auth_log(spark, sf), [("sshd", SSHD)]).select("seq", "ip")


@query(f"SELECT seq, CAST(i AS INT) AS pattern_idx FROM (SELECT seq, {matched_idx(SSHD)} AS i FROM ({V.AUTH}) a) m WHERE i IS NOT NULL")
def match_pattern_idx(spark, sf):
    return extract.match(V.auth_log(spark, sf), [("sshd", SSHD)]).select("seq", "pattern_idx")


@query(f"SELECT seq, contains(line, ' from ') AS from_, contains(line, ': Connection closed by authenticating user ') AS closed, contains(line, ': Disconnected from authenticating user ') AS gone FROM ({V.AUTH}) a")
def gate_filter(spark, sf):
    gates = list(dict.fromkeys(gate(p) for p in SSHD))
    return V.auth_log(spark, sf).select("seq", *[F.contains("line", F.lit(g)).alias(n) for g, n in zip(gates, ("from_", "closed", "gone"))])


_WEB = V.DUCK["ACCESS"]


@query(f"SELECT seq, split_part(line, ' ', 1) AS ip FROM ({_WEB}) a WHERE regexp_matches(line, '\" 401 ')")
def extract_at_start(spark, sf):
    return extract.match(V.access_log(spark, sf), [("traefik", patterns_of("traefik"))]).select("seq", "ip")


#: A line that names a second address, which a client could have put into its user name.
_SPOOF = f"SELECT seq, replace(line, ' from ', ' from ad from 999.1.1.1 from 1.1.1.1:22 port 1 from ') AS line FROM ({V.AUTH}) a"


@query(f"SELECT seq, '1.1.1.1' AS first_ip, regexp_extract(line, '.* from ([0-9.]+) port', 1) AS ip FROM ({_SPOOF}) s WHERE contains(line, 'Invalid user ') OR contains(line, 'Failed password ')")
def extract_after_literal(spark, sf):
    """The address at the place of <HOST>, and the first valid one behind the literal, which would be a spoofed one."""
    df = extract.match(V.read(spark, sf, _SPOOF, "events"), [("sshd", SSHD[:2])])
    return df.select("seq", extract.address_behind(F.col("line"), " from ").alias("first_ip"), "ip")


@query(f"SELECT seq, regexp_extract(line, 'user .* ([0-9.]+) port', 1) AS ip FROM ({V.AUTH}) a WHERE contains(line, 'Connection closed by authenticating')")
def extract_before_literal(spark, sf):
    df = V.auth_log(spark, sf).filter(F.contains("line", F.lit("Connection closed by authenticating")))
    return df.select("seq", extract.address_ahead(F.col("line"), " port ").alias("ip"))


_SERVICE = V.service_lines(False)


@query(f"SELECT seq, {matched('oracleims', patterns_of('oracleims'))} AS ip FROM ({_SERVICE}) s WHERE service = 'oracleims'")
def extract_capture(spark, sf):
    rows = V.service_log(spark, sf).filter("service = 'oracleims'")
    return rows.select("seq", extract.token(F.col("line"), patterns_of("oracleims")[0]).alias("ip"))


_TOKENS = "SELECT event_id AS seq, concat(CAST(user_id % 260 AS VARCHAR), '.', CASE WHEN event_id % 7 = 0 THEN '0' ELSE '' END, CAST(event_id % 300 AS VARCHAR), '.3.', CAST(user_id % 10 AS VARCHAR), CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ':8080' WHEN 2 THEN ':1:2' WHEN 3 THEN '.' ELSE ':' END) AS token FROM events"


@query(f"SELECT seq, token, CASE WHEN {_QUAD.format(c='token')} THEN token END AS ip FROM ({_TOKENS}) t")
def valid_ip(spark, sf):
    return addr.with_ip(V.read(spark, sf, _TOKENS, "events"), "token", "ip")


@query(f"SELECT seq, token, CASE WHEN {_QUAD.format(c="split_part(token, ':', 1)")} THEN split_part(token, ':', 1) END AS ip FROM ({_TOKENS}) t")
def strip_port(spark, sf):
    rows = V.read(spark, sf, _TOKENS, "events").withColumn("_bare", addr.without_port(F.col("token")))
    return addr.with_ip(rows, "_bare", "ip").drop("_bare")


_MAPPED = f"SELECT event_id AS seq, concat(CASE event_id % 3 WHEN 0 THEN '::ffff:' WHEN 1 THEN '::FFFF:' ELSE '' END, {V.IP}) AS token FROM events"


@query(f"SELECT seq, token, regexp_replace(token, '^::[fF]{{4}}:', '') AS ip FROM ({_MAPPED}) t")
def normalize_mapped(spark, sf):
    return addr.with_ip(V.read(spark, sf, _MAPPED, "events"), "token", "ip")


@query(f"SELECT seq, ip FROM ({O.FAIL}) f WHERE NOT regexp_matches(ip, '\\.1[0-9]$') AND NOT (pattern_idx = 1 AND ip = '10.20.0.7')")
def ignore_regex(spark, sf):
    return extract.drop_ignored(extract.match(V.auth_log(spark, sf), FAILING), [r"10\.20\.\d+\.1\d port", r"Invalid user u7 "]).select("seq", "ip")


@query(f"SELECT seq, ip, jail FROM ({O.multi_fail(V.JAILS)}) f WHERE NOT ({_number('ip')} BETWEEN 169082880 AND 169082887) AND NOT (jail = 'sshd-list' AND {_number('ip')} BETWEEN 169083008 AND 169083135)")
def allowlist_anti_join(spark, sf):
    return extract.drop_allowed(multi_fails(spark, sf), spark.createDataFrame(V.ALLOWED, "jail string, cidr string")).select("seq", "ip", "jail")


@query(f"SELECT ip, jail, ts, seq, CAST(pattern_idx AS INT) AS pattern_idx, false AS ts_inferred FROM ({O.FAIL}) f")
def failures(spark, sf):
    return fails(spark, sf)


@query(f"SELECT seq, jail, ip FROM ({O.multi_fail(V.JAILS)}) f UNION ALL SELECT seq, 'closed' AS jail, {matched('x', SSHD[2:])} AS ip FROM ({V.AUTH}) a WHERE contains(line, 'Connection closed')")
def multi_jail_match(spark, sf):
    jails = [(j, SSHD) for j in V.JAILS] + [("closed", SSHD[2:])]
    return extract.match(V.auth_log(spark, sf), jails).select("seq", "jail", "ip")


_ALL = catalogue()


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT seq, '{s}' AS jail, {matched(s, p)} AS ip, CAST({matched_idx(p)} AS INT) AS pattern_idx FROM l" for s, _, p in _ALL).join((f"WITH l AS ({_SERVICE}) ", ") u WHERE ip IS NOT NULL")))
def catalogue_match(spark, sf):
    """Every line against all 127 patterns of the 88 services."""
    return extract.match(V.service_log(spark, sf).select("seq", "line"), [(s, p) for s, _, p in _ALL]).select("seq", "jail", "ip", "pattern_idx")


_ROWS = ", ".join(f"({sql_text(s)}, {sql_text(f)}, {len(p)})" for s, f, p in _ALL)


@query(f"SELECT c.service, c.date_format, CAST(c.n AS INT) AS n_patterns, count(s.seq) AS lines FROM (VALUES {_ROWS}) c(service, date_format, n) LEFT JOIN ({_SERVICE}) s ON s.service = c.service GROUP BY ALL")
def catalogue_list(spark, sf):
    """The catalogue, with the lines that each service has in the log."""
    rows = spark.createDataFrame([(s, f, len(p)) for s, f, p in _ALL], "service string, date_format string, n_patterns int")
    seen = V.service_log(spark, sf).groupBy("service").agg(F.count(F.lit(1)).alias("lines"))
    return rows.join(seen, "service", "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))


# --- thresholds and the timeline -------------------------------------------------------------------------------------

_HITS = f"SELECT ip, jail, ts, seq, span FROM (SELECT *, ts - lag(ts, 2) OVER (PARTITION BY ip, jail ORDER BY ts, seq) AS span FROM ({O.FAIL}) f) w WHERE span < 86400"


@query(_HITS)
def threshold_window(spark, sf):
    return rules.threshold(fails(spark, sf), 3, 86400).select("ip", "jail", "ts", "seq", "span")


_POLICY = ", ".join(f"('{j}', {p.max_retry}, {p.find_time})" for j, p in V.JAILS.items())


@query(f"""WITH f AS (SELECT f.*, p.m, p.t, row_number() OVER (PARTITION BY ip, f.jail ORDER BY ts, seq) AS n FROM ({O.multi_fail(V.JAILS)}) f JOIN (VALUES {_POLICY}) p(jail, m, t) ON f.jail = p.jail)
SELECT a.ip, a.jail, a.ts, a.seq, a.ts - b.ts AS span FROM f a JOIN f b ON a.ip = b.ip AND a.jail = b.jail AND b.n = a.n - a.m + 1 WHERE a.ts - b.ts < a.t""")
def threshold_by_policy(spark, sf):
    return rules.threshold_by_policy(multi_fails(spark, sf), policy_table(spark)).select("ip", "jail", "ts", "seq", "span")


@query(f"SELECT ip, jail, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY ip, jail ORDER BY ts, seq) AS n FROM ({_HITS}) h) x WHERE n = 1")
def first_ban(spark, sf):
    return rules.first_hits(fails(spark, sf), 3, 86400)


_BAN = "ip, jail, banned_at, expires_at, ban_time, ban_count, seq"


@query(O.STANDARD + f" SELECT {_BAN} FROM bans")
def ban_timeline(spark, sf):
    return bans(spark, sf).select(*_BAN.split(", "))


@query(O.MULTI + f" SELECT {_BAN} FROM bans")
def two_jails(spark, sf):
    """Three jails over the same lines: rings and bans of their own, one shared count."""
    return multi_bans(spark, sf).select(*_BAN.split(", "))


_ESC = "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS base, l_suppkey % 25 AS n, l_returnflag <> 'N' AS inc, l_linenumber % 2 = 0 AS listed, CASE WHEN l_linenumber = 3 THEN 0 ELSE 604800 END AS maxtime FROM lineitem"


@query(f"""SELECT k, CAST(CASE WHEN NOT inc OR base < 0 THEN base ELSE CASE WHEN maxtime > 0 THEN least(g, maxtime) ELSE g END END AS BIGINT) AS length
FROM (SELECT *, CAST(trunc(base * CASE WHEN listed THEN [1.0, 2.0, 4.0, 8.0][CAST(least(n + 1, 4) AS BIGINT)] ELSE pow(2.0, least(n, 20)) END * 1.5) AS BIGINT) AS g FROM ({_ESC}) e) x""")
def escalation(spark, sf):
    rows = V.read(spark, sf, _ESC, "lineitem")
    multipliers = F.when(F.col("listed"), F.array(*[F.lit(x) for x in (1, 2, 4, 8)])).otherwise(F.array().cast("array<int>"))
    return rows.select("k", labels.ban_length(F.col("base"), F.col("n"), F.col("inc"), multipliers, F.lit(1.5), F.col("maxtime").cast("long")).alias("length"))


@query(O.MULTI + " SELECT ip, jail, banned_at, seq, CAST(row_number() OVER (PARTITION BY ip ORDER BY banned_at, seq, jail) AS INT) AS nth, ban_count FROM bans")
def ban_count(spark, sf):
    return reports.gaps(multi_bans(spark, sf)).select("ip", "jail", "banned_at", "seq", "nth", "ban_count")


@query(O.MULTI + " SELECT ip, jail, banned_at, CASE WHEN ban_time < 0 THEN NULL ELSE banned_at + ban_time END AS expires_at, ban_time < 0 AS permanent FROM bans")
def ban_expiry(spark, sf):
    return multi_bans(spark, sf).select("ip", "jail", "banned_at", "expires_at", F.col("expires_at").isNull().alias("permanent"))


@query(O.STANDARD + f" SELECT f.ip, f.jail, f.ts, f.seq FROM ({O.FAIL}) f WHERE EXISTS (SELECT 1 FROM bans b WHERE b.ip = f.ip AND b.jail = f.jail AND (f.ts, f.seq) > (b.banned_at, b.seq) AND f.ts < b.expires_at)")
def suppressed_failures(spark, sf):
    """Failures of banned addresses, which are counted but not remembered."""
    f, b = with_bans(spark, sf)
    b = b.select(F.col("ip").alias("_ip"), F.col("jail").alias("_jail"), "banned_at", "expires_at", F.col("seq").alias("_seq"))
    later = (F.col("ts") > F.col("banned_at")) | ((F.col("ts") == F.col("banned_at")) & (F.col("seq") > F.col("_seq")))
    open_ = F.col("expires_at").isNull() | (F.col("ts") < F.col("expires_at"))
    return f.join(b, (F.col("ip") == F.col("_ip")) & (F.col("jail") == F.col("_jail")) & later & open_, "left_semi").select("ip", "jail", "ts", "seq")


@query(O.STANDARD + " SELECT expires_at AS ts, ip, jail FROM bans WHERE expires_at IS NOT NULL")
def unban_events(spark, sf):
    return timeline.changes(bans(spark, sf)).filter("kind = 'unban'").select("ts", "ip", "jail")


@query(O.MANUAL + " SELECT ip, jail, banned_at, expires_at, ban_time, manual, ban_count, seq FROM bans UNION ALL SELECT ip, jail, ts, NULL, NULL, NULL, CAST(cnt AS INT), seq FROM st WHERE kind = 'ban' AND bt IS NULL")
def manual_ban(spark, sf):
    """All bans, and the commands to ban that were rejected (no ban_time)."""
    rows = timeline.all_rows(fails(spark, sf), V.STANDARD, V.commands(spark, sf))
    asked = V.commands(spark, sf).filter("cmd = 'ban'").select(F.col("seq").alias("_seq"))
    rejected = rows.filter("kind = 'reject'").join(asked, F.col("seq") == F.col("_seq"), "left_semi")
    out = rows.filter("kind = 'ban'").unionByName(rejected.withColumn("manual", F.lit(None).cast("boolean")))
    return out.select("ip", "jail", "banned_at", "expires_at", "ban_time", "manual", "ban_count", "seq")


@query(O.MANUAL + " SELECT ip, jail, ts, seq, CASE WHEN active THEN 'unban' ELSE 'reject' END AS outcome FROM st WHERE kind = 'unban'")
def manual_unban(spark, sf):
    rows = timeline.all_rows(fails(spark, sf), V.STANDARD, V.commands(spark, sf))
    asked = V.commands(spark, sf).filter("cmd = 'unban'").select(F.col("seq").alias("_seq"))
    out = rows.filter("kind IN ('unban', 'reject')").join(asked, F.col("seq") == F.col("_seq"), "left_semi")
    return out.select("ip", "jail", F.col("banned_at").alias("ts"), "seq", F.col("kind").alias("outcome"))


_SOON = V.T1 + 3600


@query(O.CHANGED + f" SELECT ip, jail, banned_at, ban_count FROM bans WHERE banned_at <= {_SOON} AND (ended_at IS NULL OR ended_at > {_SOON})")
def policy_change(spark, sf):
    """Who is banned soon after a change of policies: bans of the jail that is then missing stay as well."""
    both = timeline.bans(multi_fails(spark, sf), [(0, V.JAILS), (T1, V.LATER)])
    return timeline.active_at(both, _SOON).select("ip", "jail", "banned_at", "ban_count")


@query(O.CHANGED + f" SELECT {_BAN} FROM bans")
def policy_versions(spark, sf):
    """The timeline across a change of policies: one jail gets stricter, one has longer bans, one is taken out. Bans stay."""
    return timeline.bans(multi_fails(spark, sf), [(0, V.JAILS), (T1, V.LATER)]).select(*_BAN.split(", "))


@query(O.MULTI + f" SELECT ip, jail, banned_at, expires_at FROM bans WHERE banned_at <= {T1} AND (expires_at IS NULL OR expires_at > {T1}) AND jail <> 'sshd-strict'")
def restore_bans(spark, sf):
    live, _ = L.split_bans(multi_bans(spark, sf).filter(F.col("banned_at") <= T1), T1)
    back = policy_table(spark).filter("enabled AND reban_on_restart").select("jail")
    return live.join(back, "jail", "left_semi").select("ip", "jail", "banned_at", "expires_at")


@query(O.MULTI + f" SELECT ip, jail, banned_at, expires_at FROM bans WHERE banned_at <= {T1} AND (expires_at IS NULL OR expires_at > {T1})")
def reapply_bans(spark, sf):
    live = timeline.active_at(multi_bans(spark, sf), T1)
    return live.join(policy_table(spark).filter("enabled").select("jail"), "jail", "left_semi").select("ip", "jail", "banned_at", "expires_at")


_DRY = f"SELECT f.jail, ip, count(*) AS failures, count(*) >= p.m AS would_ban, CAST(greatest(p.m - count(*), 0) AS BIGINT) AS remaining FROM ({O.multi_fail(V.JAILS)}) f JOIN (VALUES {_POLICY}) p(jail, m, t) ON f.jail = p.jail GROUP BY f.jail, ip, p.m"


@query(_DRY)
def dry_run_detail(spark, sf):
    return reports.dry_run(multi_fails(spark, sf), policy_table(spark))


@query(f"SELECT jail, CAST(sum(failures) AS BIGINT) AS matches, count(*) AS addresses, count(*) FILTER (WHERE would_ban) AS would_ban FROM ({_DRY}) d GROUP BY jail")
def dry_run_summary(spark, sf):
    return reports.dry_run_summary(reports.dry_run(multi_fails(spark, sf), policy_table(spark)))


_WHAT = [("strict", 2, 43200), ("usual", 3, 86400), ("lax", 5, 172800)]


@query(" UNION ALL ".join(f"SELECT jail, '{n}' AS policy, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, count(DISTINCT ip) FILTER (WHERE hit) AS would_ban FROM (SELECT *, coalesce(ts - lag(ts, {m - 1}) OVER (PARTITION BY ip, jail ORDER BY ts, seq) < {t}, false) AS hit FROM ({O.FAIL}) f) w GROUP BY jail" for n, m, t in _WHAT))
def what_if(spark, sf):
    return rules.what_if(fails(spark, sf), _WHAT)


# --- event time ------------------------------------------------------------------------------------------------------

_WHEN = "SELECT event_id AS seq, {text} AS line FROM events"
_SYS = _WHEN.format(text="concat('x ', CASE WHEN event_id % 9 = 0 THEN 'Foo' ELSE substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (event_id % 12) AS INT), 3) END, ' ', CAST(1 + event_id % 31 AS VARCHAR), ' 10:', lpad(CAST(event_id % 70 AS VARCHAR), 2, '0'), ':12 srv')")
_DUCK_SYS = "CASE WHEN event_id % 9 <> 0 AND event_id % 70 < 60 AND 1 + event_id % 31 <= day(last_day(make_date(2024, CAST(1 + event_id % 12 AS BIGINT), 1))) THEN CAST(epoch(make_date(2024, CAST(1 + event_id % 12 AS BIGINT), 1)) AS BIGINT) + (event_id % 31) * 86400 + 36000 + (event_id % 70) * 60 + 12 END"


@query(f"SELECT event_id AS seq, {_DUCK_SYS} AS t FROM events")
def time_syslog(spark, sf):
    return V.read(spark, sf, _SYS, "events").select("seq", eventtime.syslog(F.col("line"), F.lit(2024)).alias("t"))


_ISO = _WHEN.format(text="concat('a 2024-0', CAST(1 + event_id % 9 AS VARCHAR), '-', lpad(CAST(event_id % 34 AS VARCHAR), 2, '0'), CASE WHEN event_id % 2 = 0 THEN 'T' ELSE ' ' END, '07:08:', lpad(CAST(event_id % 61 AS VARCHAR), 2, '0'), '.5+02:00')")


@query("SELECT event_id AS seq, CASE WHEN event_id % 34 BETWEEN 1 AND 31 AND event_id % 61 < 60 THEN CAST(epoch(make_date(2024, CAST(1 + event_id % 9 AS BIGINT), 1)) AS BIGINT) + (event_id % 34 - 1) * 86400 + 25680 + event_id % 61 END AS t FROM events")
def time_iso(spark, sf):
    """A day up to 31 runs over into the next month."""
    return V.read(spark, sf, _ISO, "events").select("seq", eventtime.iso(F.col("line")).alias("t"))


_EPO = _WHEN.format(text="concat('[', CASE WHEN event_id % 3 = 0 THEN '999999999' WHEN event_id % 3 = 1 THEN CAST(1700000000 + event_id AS VARCHAR) ELSE CAST(1700000000000 + event_id AS VARCHAR) END, '] x 12')")


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 1 THEN 1700000000 + event_id WHEN 2 THEN 1700000000000 + event_id END AS t FROM events")
def time_epoch(spark, sf):
    return V.read(spark, sf, _EPO, "events").select("seq", eventtime.epoch(F.col("line")).alias("t"))


@query("SELECT l_orderkey * 8 + l_linenumber AS seq, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem")
def time_common(spark, sf):
    return V.access_log(spark, sf).select("seq", eventtime.common(F.col("line")).alias("t"))


@query(f"SELECT event_id AS seq, 'syslog' AS form, coalesce({_DUCK_SYS}, 7) AS t, ({_DUCK_SYS}) IS NULL AS ts_inferred FROM events UNION ALL SELECT event_id, 'epoch', coalesce(CASE event_id % 3 WHEN 1 THEN 1700000000 + event_id WHEN 2 THEN 1700000000000 + event_id END, 7), event_id % 3 = 0 FROM events")
def event_time(spark, sf):
    """The format goes with the row; a line without a time has that of its arrival."""
    rows = V.read(spark, sf, _SYS, "events").withColumn("form", F.lit("syslog")).unionByName(V.read(spark, sf, _EPO, "events").withColumn("form", F.lit("epoch")))
    return extract.with_time(rows, F.col("form"), 2024, F.lit(7).cast("long")).select("seq", "form", F.col("ts").alias("t"), "ts_inferred")


# --- joins -----------------------------------------------------------------------------------------------------------

_MORE = f"SELECT ip, CASE WHEN seq % 6 = 0 THEN 'nowhere' ELSE jail END AS jail, ts, seq FROM ({O.multi_fail(V.JAILS)}) f"


def _with_unknown(spark, sf):
    return multi_fails(spark, sf).withColumn("jail", F.when(F.col("seq") % 6 == 0, "nowhere").otherwise(F.col("jail")))


@query(f"SELECT f.ip, f.jail, f.seq, CAST(p.m AS INT) AS max_retry FROM ({_MORE}) f JOIN (VALUES {_POLICY}) p(jail, m, t) ON f.jail = p.jail")
def join_policy(spark, sf):
    return _with_unknown(spark, sf).join(policy_table(spark).filter("enabled"), "jail").select("ip", "jail", "seq", "max_retry")


@query(f"SELECT ip, jail, seq FROM ({_MORE}) f WHERE jail = 'nowhere'")
def unknown_jail(spark, sf):
    return _with_unknown(spark, sf).join(policy_table(spark).filter("enabled").select("jail"), "jail", "left_anti").select("ip", "jail", "seq")


@query(O.MULTI + f" SELECT f.ip, f.jail, f.seq FROM ({O.multi_fail(V.JAILS)}) f WHERE NOT EXISTS (SELECT 1 FROM bans b WHERE b.ip = f.ip AND b.jail = f.jail AND b.banned_at <= {T1} AND (b.expires_at IS NULL OR b.expires_at > {T1}))")
def not_banned(spark, sf):
    f, b = with_bans(spark, sf, True)
    return f.join(timeline.active_at(b, T1).select("ip", "jail"), ["ip", "jail"], "left_anti").select("ip", "jail", "seq")


@query(O.MULTI + f", n AS (SELECT ip, count(*) AS n FROM bans GROUP BY ip) SELECT f.ip, count(*) AS failures, coalesce(max(n.n), 0) AS bans FROM ({O.FAIL}) f LEFT JOIN n ON f.ip = n.ip GROUP BY f.ip")
def join_ban_counts(spark, sf):
    f, b = with_bans(spark, sf, True)
    failures_ = f.filter(F.col("jail") == "sshd").groupBy("ip").agg(F.count(F.lit(1)).alias("failures"))
    n = b.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return failures_.join(n, "ip", "left").select("ip", "failures", F.coalesce("n", F.lit(0)).cast("long").alias("bans"))


@query(f"SELECT seq, ip FROM ({O.FAIL}) f WHERE {_number('ip')} BETWEEN 169082880 AND 169082887 OR {_number('ip')} BETWEEN 169083008 AND 169083135")
def cidr_semi_join(spark, sf):
    return extract.in_networks(fails(spark, sf), spark.createDataFrame(V.ALLOWED, "jail string, cidr string")).select("seq", "ip")


_GEO = f"SELECT b.*, g.country, g.asn, g.as_org FROM {{b}} b LEFT JOIN ({V.GEO}) g ON {_number('b.ip')} BETWEEN g.lo_n AND g.hi_n"


@query(f"SELECT ip, seq, country, asn, as_org FROM ({_GEO.format(b=f'({O.FAIL})')}) x")
def geo_range_join(spark, sf):
    return enrich.geo_range(fails(spark, sf), V.geo_net(spark, sf).drop("family")).select("ip", "seq", "country", "asn", "as_org")


@query(f"SELECT ip, seq, country, asn FROM ({_GEO.format(b=f'({O.FAIL})')}) x")
def geo_asof_join(spark, sf):
    return enrich.geo_asof(fails(spark, sf), V.geo_net(spark, sf), ["country", "asn"]).select("ip", "seq", "country", "asn")


@query(f"""SELECT seq, ip, CASE WHEN seq >= 0 THEN coalesce(n.n_name, 'WHOLE') WHEN n.n_nationkey % 2 = 0 AND b.user_id < 256 THEN concat(n.n_name, ' LAB') ELSE n.n_name END AS country
FROM ({V.BOTH}) b LEFT JOIN nation n ON n.n_nationkey = CASE WHEN seq >= 0 THEN CAST(floor(b.user_id / 64) AS BIGINT) ELSE b.user_id % 32 END""")
def geo_longest_prefix(spark, sf):
    """Networks of both families within each other; the narrowest one counts."""
    rows = V.read(spark, sf, V.BOTH, "events").select("seq", "ip")
    return enrich.geo_prefix(rows, V.read(spark, sf, V.NETS, "nation"), ["country"])


@query(f"SELECT seq, ip FROM ({V.BOTH}) b WHERE NOT coalesce(CASE WHEN seq >= 0 THEN b.user_id < 256 ELSE b.user_id % 32 IN (1, 2) END, false)")
def allowlist_both_families(spark, sf):
    rows = V.read(spark, sf, V.BOTH, "events").select("seq", "ip", F.lit("sshd").alias("jail"))
    nets = spark.createDataFrame([(None, "10.20.0.0/24"), ("sshd", "2001:db8:1::/48"), ("other", "2001:db8:3::/48"), ("sshd", "2001:db8:2::/48"), (None, "no net")], "jail string, cidr string")
    return extract.drop_allowed(rows, nets).select("seq", "ip")


_LABEL = "CASE WHEN asn IS NOT NULL AND as_org IS NOT NULL THEN concat('AS', CAST(asn AS VARCHAR), ' (', as_org, ')') WHEN asn IS NOT NULL THEN concat('AS', CAST(asn AS VARCHAR)) ELSE as_org END"


@query(O.MULTI + f" SELECT ip, jail, banned_at, CASE WHEN jail IN ('sshd', 'sshd-list') THEN asn END AS asn, CASE WHEN jail = 'sshd' THEN country END AS country FROM ({_GEO.format(b='bans')}) x")
def geo_fields(spark, sf):
    """Each jail names the fields it wants; the others are null."""
    wanted = spark.createDataFrame([("sshd", ["asn", "country"]), ("sshd-list", ["asn"])], "jail string, maxmind array<string>")
    df = enrich.geo_range(multi_bans(spark, sf), V.geo_net(spark, sf).drop("family")).join(wanted, "jail", "left")
    return df.select("ip", "jail", "banned_at", *[F.when(F.array_contains("maxmind", c), F.col(c)).alias(c) for c in ("asn", "country")])


@query(f"SELECT lo_n, {_LABEL} AS label FROM (SELECT lo_n, CASE WHEN lo_n % 3 = 0 THEN NULL ELSE asn END AS asn, as_org FROM ({V.GEO}) g) x")
def asn_label(spark, sf):
    df = V.geo_net(spark, sf).withColumn("asn", F.when(F.col("lo_n") % 3 == 0, None).otherwise(F.col("asn")))
    return df.select("lo_n", labels.asn_label(F.col("asn"), F.col("as_org")).alias("label"))


@query(O.STANDARD + f" SELECT ip, jail, banned_at, country, {_LABEL} AS network FROM ({_GEO.format(b='bans')}) x")
def enriched_bans(spark, sf):
    df = enrich.geo_range(bans(spark, sf), V.geo_net(spark, sf).drop("family"))
    return df.select("ip", "jail", "banned_at", "country", labels.asn_label(F.col("asn"), F.col("as_org")).alias("network"))


def _active(t: int, b: str = "bans") -> str:
    return f"SELECT * FROM {b} WHERE banned_at <= {t} AND (ended_at IS NULL OR ended_at > {t})"


@query(O.MULTI + f" SELECT ip, jail, banned_at, expires_at FROM ({_active(T1)}) a")
def active_at(spark, sf):
    return timeline.active_at(multi_bans(spark, sf), T1).select("ip", "jail", "banned_at", "expires_at")


#: A moment of interest every time someone buys something.
_MOMENTS = "SELECT event_id AS k, CAST(floor(EPOCH) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'"


@query(O.MULTI + f" SELECT m.k, m.t, b.ip, b.jail, b.banned_at FROM ({_MOMENTS.replace('EPOCH', 'epoch(ts)')}) m JOIN bans b ON b.banned_at <= m.t AND (b.ended_at IS NULL OR b.ended_at > m.t)")
def active_at_each(spark, sf):
    """Who was banned at each of thousands of moments."""
    moments = V.read(spark, sf, _MOMENTS.replace("EPOCH", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"), "events")
    return timeline.active_at_each(multi_bans(spark, sf), moments).select("k", "t", "ip", "jail", "banned_at")


# --- reports ---------------------------------------------------------------------------------------------------------


@query(O.STANDARD + f" SELECT (SELECT count(*) FROM ({O.FAIL}) f) AS failures, (SELECT greatest({T2} - min(ts), 0) FROM ({O.FAIL}) f) AS uptime, count(*) FILTER (WHERE banned_at <= {T2}) AS bans, count(*) FILTER (WHERE ended_at <= {T2}) AS unbans, count(*) FILTER (WHERE banned_at <= {T2} AND (ended_at IS NULL OR ended_at > {T2})) AS active FROM bans")
def stats_total(spark, sf):
    return reports.stats_total(*with_bans(spark, sf), T2)


_BY = f"""SELECT j.jail, coalesce(f.n, 0) AS failures, coalesce(b.n, 0) AS bans, coalesce(b.a, 0) AS active FROM (SELECT unnest({['disabled', *V.JAILS]}) AS jail) j
LEFT JOIN (SELECT jail, count(*) AS n FROM ({O.multi_fail(V.JAILS)}) x GROUP BY jail) f ON f.jail = j.jail
LEFT JOIN (SELECT jail, count(*) FILTER (WHERE banned_at <= {T2}) AS n, count(*) FILTER (WHERE banned_at <= {T2} AND (ended_at IS NULL OR ended_at > {T2})) AS a FROM bans GROUP BY jail) b ON b.jail = j.jail"""


@query(O.MULTI + " " + _BY)
def stats_by_jail(spark, sf):
    return reports.stats_by_jail(policy_table(spark), *with_bans(spark, sf, True), T2)


@query(O.MULTI + f" SELECT jail, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(bans) AS BIGINT) AS bans, CAST(sum(active) AS BIGINT) AS active FROM ({_BY}) s GROUP BY ROLLUP (jail)")
def stats_rollup(spark, sf):
    df = reports.stats_by_jail(policy_table(spark), *with_bans(spark, sf, True), T2)
    return df.rollup("jail").agg(*[F.sum(c).alias(c) for c in ("failures", "bans", "active")])


@query(f"SELECT jail, count(*) AS matches, count(DISTINCT ip) AS addresses FROM ({O.multi_fail(V.JAILS)}) f GROUP BY jail")
def distinct_ips(spark, sf):
    return multi_fails(spark, sf).groupBy("jail").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("ip").alias("addresses"))


@query(f"SELECT jail, count(DISTINCT ip) AS addresses, true AS within FROM ({O.multi_fail(V.JAILS)}) f GROUP BY jail")
def approx_ips(spark, sf):
    """The exact number beside the approximate one, which is within three of its standard errors (5 % each)."""
    df = multi_fails(spark, sf).groupBy("jail").agg(F.countDistinct("ip").alias("addresses"), F.approx_count_distinct("ip").alias("about"))
    return df.select("jail", "addresses", (F.abs(F.col("about") - F.col("addresses")) <= 0.15 * F.col("addresses")).alias("within"))


@query(f"SELECT jail, ts // 86400 AS day, count(*) AS failures, true AS within FROM ({O.multi_fail(V.JAILS)}) f GROUP BY ALL UNION ALL SELECT jail, NULL, count(*), true FROM ({O.multi_fail(V.JAILS)}) f GROUP BY jail")
def sketched_ips(spark, sf):
    """Distinct addresses a day and in all from sketches of hours, merged upward: within the sketch's error of the exact number."""
    f = written(multi_fails(spark, sf), "failures")
    hours = written(reports.sketches(f), "sketches")
    days = reports.merged_sketches(hours, "jail", F.floor(F.col("since") / 86400).alias("day"))
    whole = reports.merged_sketches(days.drop("addresses"), "jail").withColumn("day", F.lit(None).cast("long"))
    exact = f.groupBy("jail", F.floor(F.col("ts") / 86400).alias("day")).agg(F.countDistinct("ip").alias("n"))
    exact = exact.unionByName(f.groupBy("jail").agg(F.countDistinct("ip").alias("n")).withColumn("day", F.lit(None).cast("long"))).withColumnRenamed("jail", "_jail").withColumnRenamed("day", "_day")
    both = days.unionByName(whole).join(exact, (F.col("jail") == F.col("_jail")) & F.col("day").eqNullSafe(F.col("_day")))
    near = F.abs(F.col("addresses") - F.col("n")) <= F.greatest(F.lit(1.0), reports.SKETCH_ERROR * F.col("n"))
    return both.select("jail", "day", "failures", near.alias("within"))


@query(O.STANDARD + f" SELECT country, count(*) AS bans, count(DISTINCT ip) AS addresses FROM ({_GEO.format(b='bans')}) x GROUP BY country")
def bans_by_country(spark, sf):
    df = enrich.geo_range(bans(spark, sf), V.geo_net(spark, sf).drop("family"))
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("bans"), F.countDistinct("ip").alias("addresses"))


@query(f"SELECT jail, CAST(pattern_idx AS INT) AS pattern_idx, count(*) AS hits FROM ({O.multi_fail(V.JAILS)}) f GROUP BY ALL")
def hits_by_pattern(spark, sf):
    return multi_fails(spark, sf).groupBy("jail", "pattern_idx").agg(F.count(F.lit(1)).alias("hits"))


@query(f"SELECT ip, seq, n AS filled, lo AS oldest, n = 3 AND ts - lo < 86400 AS reached FROM (SELECT *, count(*) OVER w AS n, min(ts) OVER w AS lo FROM ({O.FAIL}) f WINDOW w AS (PARTITION BY ip, jail ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) x")
def ring_frame(spark, sf):
    return rules.ring(fails(spark, sf), 3, 86400).select("ip", "seq", "filled", "oldest", "reached")


@query(f"SELECT ip, seq, count(*) OVER (PARTITION BY ip, jail ORDER BY ts RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS within, count(*) OVER (PARTITION BY ip, jail ORDER BY ts RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) >= 3 AS reached FROM ({O.FAIL}) f")
def range_frame(spark, sf):
    return rules.in_range(fails(spark, sf), 3, 86400).select("ip", "seq", "within", "reached")


@query(O.STANDARD + " SELECT ip, seq, CAST(row_number() OVER w AS INT) AS nth, banned_at - lag(banned_at) OVER w AS gap FROM bans WINDOW w AS (PARTITION BY ip ORDER BY banned_at, seq, jail)")
def ban_gaps(spark, sf):
    return reports.gaps(bans(spark, sf)).select("ip", "seq", "nth", "gap")


_LEFT = f"CASE WHEN expires_at IS NULL THEN 'permanent' WHEN expires_at <= {T1} THEN 'expired' WHEN expires_at - {T1} >= 3600 THEN concat(CAST((expires_at - {T1}) // 3600 AS VARCHAR), 'h ', CAST((expires_at - {T1}) % 3600 // 60 AS VARCHAR), 'm remaining') ELSE concat(CAST((expires_at - {T1}) // 60 AS VARCHAR), 'm remaining') END"


@query(O.MULTI + f" SELECT jail, ip, strftime(make_timestamp(banned_at * 1000000), '%d %b %H:%M') AS banned, {_LEFT} AS remaining, expires_at FROM ({_active(T1)}) a ORDER BY expires_at NULLS LAST, ip, jail")
def list_bans(spark, sf):
    return reports.listed(timeline.active_at(multi_bans(spark, sf), T1), T1)


@query(f"SELECT ip, count(*) AS failures FROM ({O.FAIL}) f GROUP BY ip ORDER BY failures DESC, ip LIMIT 20")
def top_offenders(spark, sf):
    return fails(spark, sf).groupBy("ip").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "ip").limit(20)


@query(O.MULTI + f" SELECT jail, min(expires_at) AS next_expiry FROM ({_active(T1)}) a GROUP BY jail")
def next_expiry(spark, sf):
    return timeline.active_at(multi_bans(spark, sf), T1).groupBy("jail").agg(F.min("expires_at").alias("next_expiry"))


@query(f"SELECT ip, jail, ts, seq, 'failure' AS kind FROM ({O.FAIL}) f UNION ALL SELECT ip, jail, ts, seq, cmd FROM ({V.DUCK['COMMANDS']}) c")
def command_union(spark, sf):
    return timeline.events(fails(spark, sf), V.commands(spark, sf))


_CHANGES = "SELECT banned_at AS ts, 'ban' AS kind, ip, jail, ban_time FROM bans UNION ALL SELECT ended_at, 'unban', ip, jail, NULL FROM bans WHERE ended_at IS NOT NULL"


@query(O.MULTI + " " + _CHANGES)
def ban_changes(spark, sf):
    return timeline.changes(multi_bans(spark, sf))


@query(O.MULTI + f" SELECT ip, jail, 'add' AS action FROM (SELECT ip, jail FROM ({_active(T2)}) a EXCEPT ALL SELECT ip, jail FROM ({_active(T1)}) b) x UNION ALL SELECT ip, jail, 'remove' FROM (SELECT ip, jail FROM ({_active(T1)}) a EXCEPT ALL SELECT ip, jail FROM ({_active(T2)}) b) y")
def blocklist_delta(spark, sf):
    b = multi_bans(spark, sf)
    return reports.delta(timeline.active_at(b, T1), timeline.active_at(b, T2))


@query(O.MULTI + " SELECT ip FROM bans WHERE jail = 'sshd' INTERSECT SELECT ip FROM bans WHERE jail = 'sshd-list' INTERSECT SELECT ip FROM bans WHERE jail = 'sshd-strict'")
def cross_jail_bans(spark, sf):
    b = multi_bans(spark, sf)
    sets = [b.filter(F.col("jail") == j).select("ip") for j in V.JAILS]
    return sets[0].intersect(sets[1]).intersect(sets[2])


# --- text forms ------------------------------------------------------------------------------------------------------


@query(O.MULTI + f""" SELECT ts, ip, jail, concat('{{"event":"', kind, '","ip":"', ip, '","jail":"', jail, '"', CASE WHEN ban_time IS NOT NULL THEN concat(',"ban_time":', CAST(ban_time AS VARCHAR)) ELSE '' END, ',"timestamp":"', strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'), '"}}') AS payload FROM ({_CHANGES}) c WHERE jail <> 'sshd'""")
def notify_payload(spark, sf):
    return reports.payloads(timeline.changes(multi_bans(spark, sf)), ["sshd-list", "sshd-strict"])


@query(O.STANDARD + """ SELECT seq, concat('banned ', ip, ' in ', jail, ' component=tracker jail=', jail, ' ip=', ip, ' reason="', CAST(ban_count AS VARCHAR), ' bans, last=\\"', CAST(banned_at AS VARCHAR), '\\""', ' ban_time=', CAST(ban_time AS VARCHAR), ' manual=', CAST(manual AS VARCHAR)) AS line FROM bans""")
def logfmt_events(spark, sf):
    return reports.logfmt(bans(spark, sf))


@query(O.STANDARD + """ SELECT seq, concat('{"msg":"banned ', ip, ' in ', jail, '","component":"tracker","jail":"', jail, '","ip":"', ip, '","ban_time":', CAST(ban_time AS VARCHAR), ',"manual":', CAST(manual AS VARCHAR), '}') AS line FROM bans""")
def json_events(spark, sf):
    return reports.json_lines(bans(spark, sf))


@query(O.MULTI + f""" SELECT concat('{{"jail":"', jail, '","ip":"', ip, '","banned_at":', CAST(banned_at AS VARCHAR), ',"expires_at":', coalesce(CAST(expires_at AS VARCHAR), 'null'), '}}') AS line FROM ({_active(T1)}) a""")
def bans_jsonl(spark, sf):
    return reports.bans_jsonl(timeline.active_at(multi_bans(spark, sf), T1))


_TEMPLATE = "block add <IP> --list <JAIL>"


@query(O.MULTI + f" SELECT concat('b-', jail) AS set_name, ip, CASE WHEN jail = 'sshd' THEN '22' ELSE '22,2222' END AS ports, 'tcp' AS protocol FROM ({_active(T1)}) a")
def blocklist_export(spark, sf):
    return reports.blocklist(timeline.active_at(multi_bans(spark, sf), T1), policy_table(spark), _TEMPLATE).drop("command")


@query(O.MULTI + f" SELECT ip, concat('block add ', ip, ' --list ', jail) AS command FROM ({_active(T1)}) a")
def rendered_command(spark, sf):
    return reports.blocklist(timeline.active_at(multi_bans(spark, sf), T1), policy_table(spark), _TEMPLATE).select("ip", "command")


# --- by the clock ----------------------------------------------------------------------------------------------------


@query(f"SELECT jail, ts // 3600 * 3600 AS hour, count(*) AS failures FROM ({O.FAIL}) f GROUP BY ALL")
def failures_per_hour(spark, sf):
    hour = F.window(F.timestamp_seconds("ts"), "1 hour")
    df = fails(spark, sf).groupBy("jail", hour.alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return df.select("jail", F.unix_seconds("w.start").alias("hour"), "failures")


@query(f"""SELECT ip, min(ts) AS first, max(ts) AS last, count(*) AS failures FROM (SELECT *, sum(CASE WHEN ts - before < 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY ip ORDER BY ts, seq) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY ip ORDER BY ts, seq) AS before FROM ({O.FAIL}) f) x) y GROUP BY ip, s""")
def attack_sessions(spark, sf):
    """Failures of an address with less than six hours between them."""
    session = F.session_window(F.timestamp_seconds("ts"), f"{6 * 3600 - 1} seconds")  # windows that touch are one, and times are whole seconds
    df = fails(spark, sf).groupBy("ip", session.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("failures"))
    return df.select("ip", "first", "last", "failures")


# --- streams ---------------------------------------------------------------------------------------------------------


@query(f"SELECT ip, jail, ts, seq FROM ({O.FAIL}) f")
def stream_failures(spark, sf):
    """The extraction as a stream over the events table, run until all of it has been read."""
    return replay.extracted(spark, sf).select("ip", "jail", "ts", "seq")


@query(f"SELECT CAST(seq AS VARCHAR) AS at, ip FROM ({O.FAIL}) f WHERE pattern_idx < 2")
def stream_journal(spark, sf):
    """A journal's export that lands in files, followed through field matches to failures."""
    path = folder(spark, "journal")
    unit = F.when(F.col("line").contains("Failed") | F.col("line").contains("Invalid"), "ssh.service").otherwise("cron.service")
    L.write_journal(V.auth_log(spark, sf).select(F.col("line").alias("MESSAGE"), F.col("seq").alias("__REALTIME_TIMESTAMP"), unit.alias("_SYSTEMD_UNIT")), path)
    rows = L.follow_journal(spark, path, {"_SYSTEMD_UNIT": ["ssh.service", "sshd.service"]})
    return replay.run(extract.match(extract.clean_lines(rows), FAILING).select(F.col("__REALTIME_TIMESTAMP").alias("at"), "ip"), spark)


@query(O.STANDARD + " SELECT ip, jail, banned_at, expires_at, ban_count FROM bans")
def stream_bans(spark, sf):
    """The tracker with keyed state, over lines that land shuffled; ``stream_changes`` has them in several parts, each up to a day late."""
    return replay.tracked(spark, sf, 1).filter("kind = 'ban'").select("ip", "jail", "banned_at", "expires_at", "ban_count")


@query(O.STANDARD + " SELECT banned_at AS ts, 'ban' AS kind, ip, jail, ban_time FROM bans UNION ALL SELECT ended_at, 'unban', ip, jail, NULL FROM bans WHERE ended_at IS NOT NULL")
def stream_changes(spark, sf):
    """Bans and, by timers, their ends."""
    return replay.tracked(spark, sf, 4).select(F.col("banned_at").alias("ts"), "kind", "ip", "jail", "ban_time")


@query(O.CHANGED + " SELECT ip, jail, banned_at, expires_at, ban_count FROM bans")
def stream_policies(spark, sf):
    """The tracker started again from its checkpoint with policies that then change."""
    return replay.across_versions(spark, sf).filter("kind = 'ban'").select("ip", "jail", "banned_at", "expires_at", "ban_count")


_BY_HAND = """SELECT ip, jail, ts, seq, CASE WHEN bt IS NOT NULL THEN 'ban' WHEN kind = 'unban' AND active THEN 'unban' ELSE 'reject' END AS outcome FROM st WHERE bt IS NOT NULL OR kind IN ('ban', 'unban')"""


@query(O.MANUAL + f" {_BY_HAND}")
def stream_commands(spark, sf):
    """Failures and manual commands as two inputs of one stream: bans, manual unbans, rejected commands."""
    rows = replay.commanded(spark, sf).filter("seq IS NOT NULL")  # expiries have no number
    return rows.select("ip", "jail", F.col("banned_at").alias("ts"), "seq", F.col("kind").alias("outcome"))


@query(O.STANDARD + " SELECT concat('{\"event\":\"', kind, '\",\"ip\":\"', ip, '\",\"jail\":\"', jail, CASE WHEN kind = 'ban' THEN concat('\",\"ban_time\":', CAST(ban_time AS VARCHAR), ',') ELSE '\",' END, '\"timestamp\":\"', strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'), '\"}') AS payload FROM (SELECT banned_at AS ts, 'ban' AS kind, ip, jail, ban_time FROM bans UNION ALL SELECT ended_at, 'unban', ip, jail, NULL FROM bans WHERE ended_at IS NOT NULL) c")
def stream_feed(spark, sf):
    """Notifications of bans and unbans of the tracker's stream, written to files."""
    return replay.fed(spark, sf)


del HOST, Window
