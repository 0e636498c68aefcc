"""Reports over failures and bans, and the text forms they leave in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.functions import labels


def dry_run(failures: DataFrame, policy: DataFrame) -> DataFrame:
    """Per jail and address: failures, whether they would lead to a ban (find_time left out), and how many are missing."""
    counts = failures.groupBy("jail", "ip").agg(F.count(F.lit(1)).alias("failures"))
    df = counts.join(policy.select("jail", "max_retry"), "jail")
    return df.select("jail", "ip", "failures", (F.col("failures") >= F.col("max_retry")).alias("would_ban"), F.greatest(F.col("max_retry") - F.col("failures"), F.lit(0)).cast("long").alias("remaining"))


def dry_run_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("jail").agg(F.sum("failures").alias("matches"), F.count(F.lit(1)).alias("addresses"), F.count_if("would_ban").alias("would_ban"))


def stats_total(failures: DataFrame, bans: DataFrame, now: int) -> DataFrame:
    f = failures.agg(F.count(F.lit(1)).alias("failures"), F.greatest(F.lit(now) - F.min("ts"), F.lit(0)).alias("uptime"))
    ended = F.col("ended_at").isNotNull() & (F.col("ended_at") <= now)
    begun = F.col("banned_at") <= now
    b = bans.agg(F.count_if(begun).alias("bans"), F.count_if(begun & ended).alias("unbans"), F.count_if(begun & ~ended).alias("active"))
    return f.crossJoin(b)  # one row each


def stats_by_jail(jails: DataFrame, failures: DataFrame, bans: DataFrame, now: int) -> DataFrame:
    """One row per configured jail, with zeros."""
    begun, open_ = F.col("banned_at") <= now, F.col("ended_at").isNull() | (F.col("ended_at") > now)
    f = failures.groupBy("jail").agg(F.count(F.lit(1)).alias("failures"))
    b = bans.groupBy("jail").agg(F.count_if(begun).alias("bans"), F.count_if(begun & open_).alias("active"))
    df = jails.select("jail").distinct().join(f, "jail", "left").join(b, "jail", "left")
    return df.select("jail", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("failures", "bans", "active")])


#: Bits of a sketch's registers (2^12 of them, 4 KB at most), and three standard errors of its count.
SKETCH, SKETCH_ERROR = 12, 3 * 1.04 / 64


def sketches(failures: DataFrame, seconds: int = 3600) -> DataFrame:
    """jail, since, failures, sketch: for each jail and span of time the failures and a sketch of their addresses.

    Sketches of parts merge into that of the whole, so counts of distinct addresses over any spans need the failures no more.
    """
    since = (F.floor(F.col("ts") / seconds) * seconds).cast("long")
    return failures.groupBy("jail", since.alias("since")).agg(F.count(F.lit(1)).alias("failures"), F.hll_sketch_agg("ip", F.lit(SKETCH)).alias("sketch"))


def merged_sketches(parts: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of parts, merged by keys: failures, addresses (within SKETCH_ERROR of the exact number), and the merged sketch."""
    merged = parts.groupBy(*by).agg(F.sum("failures").alias("failures"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("addresses", F.hll_sketch_estimate("sketch"))


def gaps(bans: DataFrame) -> DataFrame:
    """Each ban's number and the time since the address's last one."""
    by = Window.partitionBy("ip").orderBy("banned_at", "seq", "jail")
    return bans.withColumn("nth", F.row_number().over(by)).withColumn("gap", F.col("banned_at") - F.lag("banned_at").over(by))


def listed(active: DataFrame, now: int) -> DataFrame:
    """Active bans as operators see them, the next to expire first, permanent ones last."""
    df = active.select("jail", "ip", F.date_format(F.timestamp_seconds("banned_at"), "dd MMM HH:mm").alias("banned"), labels.remaining(F.col("expires_at"), F.lit(now)).alias("remaining"), "expires_at")
    return df.orderBy(F.col("expires_at").asc_nulls_last(), "ip", "jail")


def iso_utc(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def payloads(changes: DataFrame, webhook_jails: list[str]) -> DataFrame:
    """Notifications, for jails that have a receiver; an unban has no ban_time."""
    body = F.to_json(F.struct(F.col("kind").alias("event"), "ip", "jail", "ban_time", iso_utc(F.col("ts")).alias("timestamp")))
    return changes.filter(F.col("jail").isin(webhook_jails)).select("ts", "ip", "jail", body.alias("payload"))


def logfmt(bans: DataFrame) -> DataFrame:
    text = F.concat(F.lit("banned "), "ip", F.lit(" in "), "jail")
    pairs = [("component", F.lit("tracker")), ("jail", labels.logfmt_value(F.col("jail"))), ("ip", labels.logfmt_value(F.col("ip"))), ("reason", labels.logfmt_value(F.concat(F.col("ban_count").cast("string"), F.lit(" bans, last=\""), F.col("banned_at").cast("string"), F.lit("\"")))), ("ban_time", F.col("ban_time").cast("string")), ("manual", F.col("manual").cast("string"))]
    return bans.select("seq", F.concat(text, *[F.concat(F.lit(f" {k}="), v) for k, v in pairs]).alias("line"))


def json_lines(bans: DataFrame) -> DataFrame:
    text = F.concat(F.lit("banned "), "ip", F.lit(" in "), "jail")
    return bans.select("seq", F.to_json(F.struct(text.alias("msg"), F.lit("tracker").alias("component"), "jail", "ip", "ban_time", "manual")).alias("line"))


def bans_jsonl(active: DataFrame) -> DataFrame:
    return active.select(F.to_json(F.struct("jail", "ip", "banned_at", "expires_at"), {"ignoreNullFields": "false"}).alias("line"))


def blocklist(active: DataFrame, policy: DataFrame, template: str) -> DataFrame:
    """Entries for a packet filter: a set for each jail and family, ports, protocol, and a command text. Nothing is run."""
    name = F.concat(F.lit("b-"), "jail", F.when(F.col("ip").contains(":"), "-v6").otherwise(""))
    command = F.replace(F.replace(F.lit(template), F.lit("<IP>"), F.col("ip")), F.lit("<JAIL>"), F.col("jail"))
    df = active.join(policy.select("jail", "port", "protocol"), "jail")
    return df.select(name.alias("set_name"), "ip", F.array_join("port", ",").alias("ports"), "protocol", command.alias("command"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What to add to and remove from a block-list between two states (ip, jail)."""
    add = after.select("ip", "jail").exceptAll(before.select("ip", "jail")).withColumn("action", F.lit("add"))
    drop = before.select("ip", "jail").exceptAll(after.select("ip", "jail")).withColumn("action", F.lit("remove"))
    return add.unionByName(drop)
