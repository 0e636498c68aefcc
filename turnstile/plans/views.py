"""Views over the driver's tables, as SQL that runs in Spark and, with other type names, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators.timeline import Policy
from turnstile.plans.samples import samples

#: 2024-01-15 and 2024-01-22, noon.
T1, T2 = 1705320000, 1705924800
STANDARD = {"sshd": Policy(3, 86400, 43200)}
JAILS = {
    "sshd": Policy(3, 86400, 43200, increment=True),
    "sshd-list": Policy(3, 86400, 3600, increment=True, multipliers=(1, 2, 4, 8), maxtime=7200),
    "sshd-strict": Policy(2, 21600, -1, restore=False),
}
#: What is valid from T1 on: one jail gets stricter, one longer bans, one is missing.
LATER = {"sshd": Policy(2, 43200, 21600, increment=True), "sshd-list": Policy(3, 86400, 7200)}
ALLOWED = [(None, "10.20.0.0/29"), (None, "::1/128"), ("sshd-list", "10.20.0.128/25")]


def spark_sql(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


IP = "concat('10.20.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR))"
PORT = "CAST(1024 + event_id % 50000 AS VARCHAR)"
AUTH = f"""
SELECT event_id AS seq, ts,
  concat(CAST(date_trunc('second', ts) AS VARCHAR), ' srv sshd[', CAST(1000 + event_id AS VARCHAR), ']: ',
    CASE event_type
      WHEN 'error'  THEN concat('Failed password for user', CAST(user_id AS VARCHAR), ' from ', ip, ' port ', {PORT}, ' ssh2')
      WHEN 'view'   THEN concat('Invalid user u', CAST(user_id AS VARCHAR), ' from ', ip, ' port ', {PORT})
      WHEN 'click'  THEN concat('Connection closed by authenticating user root ', ip, ' port ', {PORT}, ' [preauth]')
      WHEN 'signup' THEN concat('Accepted publickey for git from ', ip, ' port ', {PORT}, ' ssh2')
      ELSE 'Server listening on 0.0.0.0 port 22.' END) AS line
FROM (SELECT *, {IP} AS ip FROM events) e"""
_SAMPLES = ", ".join(f"({i}, '{s}', '{line.replace(chr(39), chr(39) * 2)}')" for i, (s, line) in enumerate(samples()))


def service_lines(escape: bool) -> str:
    """A line of some service for each event, with the event's address in it."""
    rows = _SAMPLES.replace("\\", "\\\\") if escape else _SAMPLES
    return f"""
SELECT event_id AS seq, s.service, replace(s.line, '{{ip}}', {IP}) AS line
FROM events JOIN (VALUES {rows}) AS s(k, service, line) ON event_id % 88 = s.k"""


GEO = """
SELECT 4 AS family, 169082880 + 64 * CAST(n_nationkey AS BIGINT) AS lo_n, 169082880 + 64 * CAST(n_nationkey AS BIGINT) + 63 AS hi_n,
  n_name AS country, 64512 + CAST(n_nationkey AS BIGINT) AS asn, o.as_org
FROM nation LEFT JOIN (
  SELECT s_nationkey, s_name AS as_org FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) s WHERE rn = 1
) o ON n_nationkey = o.s_nationkey"""
#: Addresses of both families, and networks of both that lie within each other.
BOTH = f"""
SELECT event_id AS seq, user_id, {IP} AS ip FROM events
UNION ALL SELECT -event_id - 1, user_id, concat('2001:db8:', lower(hex(user_id % 32)), '::', lower(hex(user_id))) FROM events"""
NETS = """
SELECT concat('10.20.', CAST(CAST(floor(n_nationkey / 4) AS BIGINT) AS VARCHAR), '.', CAST(64 * (n_nationkey % 4) AS VARCHAR), '/26') AS cidr, n_name AS country FROM nation
UNION ALL SELECT '10.20.0.0/16', 'WHOLE' FROM nation WHERE n_nationkey = 0
UNION ALL SELECT concat('2001:db8:', lower(hex(n_nationkey)), '::/48'), n_name FROM nation
UNION ALL SELECT concat('2001:db8:', lower(hex(n_nationkey)), '::/120'), concat(n_name, ' LAB') FROM nation WHERE n_nationkey % 2 = 0"""
#: Manual commands, from purchases: one in four unbans, the others ban; some name an unknown jail.
COMMANDS = f"""
SELECT CAST(floor(epoch_s) AS BIGINT) AS ts, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'unban' ELSE 'ban' END AS cmd,
  {IP} AS ip, CASE WHEN event_id % 10 = 3 THEN 'nowhere' ELSE 'sshd' END AS jail
FROM (SELECT *, EPOCH_OF_TS AS epoch_s FROM events WHERE event_type = 'purchase') e"""
ACCESS = """
SELECT l_orderkey * 8 + l_linenumber AS seq,
  concat('10.', CAST(l_suppkey % 4 AS VARCHAR), '.', CAST(CAST(floor(l_partkey / 256) AS BIGINT) % 256 AS VARCHAR), '.', CAST(l_partkey % 256 AS VARCHAR),
    ' - - [', DATE_TEXT, ' +0000] "GET ', CASE WHEN l_returnflag = 'R' THEN '/wp-login.php' ELSE '/index.html' END, ' HTTP/1.1" ',
    CASE WHEN l_returnflag = 'A' THEN '401' WHEN l_linenumber = 1 THEN '404' WHEN l_linenumber = 2 THEN '403' ELSE '200' END, ' 512') AS line
FROM lineitem"""
DUCK = {
    "COMMANDS": COMMANDS.replace("EPOCH_OF_TS", "epoch(ts)"),
    "ACCESS": ACCESS.replace("DATE_TEXT", "strftime(l_shipdate, '%d/%b/%Y:%H:%M:%S')"),
}
SPARK = {
    "COMMANDS": spark_sql(COMMANDS.replace("EPOCH_OF_TS", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6")),
    "ACCESS": spark_sql(ACCESS.replace("DATE_TEXT", "date_format(l_shipdate, 'dd/MMM/yyyy:HH:mm:ss')")),
}


#: Tables of which lines are made.
WORK = ("events", "lineitem")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one that comes in fewer parts than there are cores is dealt out, as matching its lines takes longer than reading it.

    Tables of many files are never shuffled for this.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in WORK and df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql over the parquet tables of sf_dir."""
    frames = {t: load(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = _named(sql, t)
    return spark.sql(spark_sql(sql), **frames)


def _named(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, AUTH, "events")


def service_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, s, line) for i, (s, line) in enumerate(samples())], "k int, service string, line string")
    ip = F.expr(spark_sql(IP))
    return events.join(F.broadcast(rows), F.col("event_id") % 88 == F.col("k")).select(F.col("event_id").alias("seq"), "service", F.replace("line", F.lit("{ip}"), ip).alias("line"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, SPARK["ACCESS"], "lineitem")


def geo_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, GEO, "nation", "supplier")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, SPARK["COMMANDS"], "events")
