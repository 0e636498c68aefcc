"""Streams over the given tables, run to their end; the results are tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators import extract, reports
from turnstile.operators.timeline import Policies
from turnstile.plans import views as V
from turnstile.plans.catalogue import patterns_of
from turnstile.sources.tables import folder
from turnstile.streaming.tracker import track

#: State kept on local disks and, as changes, in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts in which a table's lines land, and how many seconds later than its time a line may land.
LANDINGS, LATE = 2, 86400


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """auth_log as a stream of the events table's files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders or patterns; this one holds for a file as for a folder of parts, and for no other name.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return spark.sql(V.spark_sql(V.AUTH).replace("FROM events", "FROM {events}"), events=events)


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.failures(lines(spark, sf_dir), [("sshd", patterns_of("sshd"))])


def run(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes all that the stream has to offer as parquet, and reads it."""
    base = folder(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(failures(spark, sf_dir), spark)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state with PROVIDER."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def landings(rows: DataFrame, parts: int = LANDINGS, late: int = LATE) -> Iterator[DataFrame]:
    """rows (ts, seq, ...) in the parts in which they land: in order of time on the whole, each up to ``late`` seconds late, shuffled within."""
    at = F.col("ts") + F.pmod(F.xxhash64("seq"), F.lit(late))
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if ends["a"] is None:
        return
    width = (ends["b"] - ends["a"]) // parts + 1
    for k in range(parts):
        yield rows.filter(F.floor((at - ends["a"]) / width) == k).orderBy(F.xxhash64("seq", F.lit(k)))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts (of the line), line."""
    return V.auth_log(spark, sf_dir).select("seq", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "line")


class Replay:
    """Lines and commands that land part by part, each time a stream that takes up what has landed from where the last one stopped.

    Every start reads its state from the checkpoint. With the last part a line lands that is a year ahead, for the watermark to pass all others.
    """

    def __init__(self, spark: SparkSession, jails: list[str], rows: DataFrame, commands: DataFrame | None = None):
        self.spark, self.base = spark, folder(spark, "replay")
        self.jails = [(j, patterns_of("sshd")) for j in jails]
        self.rows, self.commands = rows, commands
        self.state_rows: list[int] = []

    def _events(self) -> DataFrame:
        log = self.spark.readStream.schema("seq long, line string").parquet(f"{self.base}/log/*")
        rows = extract.failures(log, self.jails).select("ip", "jail", "ts", "seq", F.lit("failure").alias("kind"))
        if self.commands is not None:
            given = self.spark.readStream.schema("ip string, jail string, ts long, seq long, kind string").parquet(f"{self.base}/commands/*")
            rows = rows.unionByName(given)
        return rows

    def _go(self, policies: Policies, initial: DataFrame | None) -> DataFrame:
        out = track(self._events(), policies, initial, f"{LATE} seconds")
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{self.base}/checkpoint").option("path", f"{self.base}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        self.state_rows += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return out

    def run(self, *policies: Policies, initial: DataFrame | None = None, parts: int = LANDINGS) -> DataFrame:
        """All changes (kind, ip, ...). The n-th part is taken under the n-th policies, further ones under the last."""
        newest = self.rows.agg(F.max("ts").alias("t")).first()["t"] or 0
        ahead = F.date_format(F.timestamp_seconds(F.lit(newest + 366 * 86400)), "yyyy-MM-dd HH:mm:ss")
        last = self.spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.concat(ahead, F.lit(" srv sshd[1]: Invalid user end from 0.0.0.0 port 1")).alias("line"))
        with state_store(self.spark):
            logs = [part.select("seq", "line") for part in landings(self.rows, parts)] or [self.rows.limit(0).select("seq", "line")]
            # The line ahead lands with the last part: its batch still has the watermark of those before it.
            logs[-1] = logs[-1].unionByName(last)
            asked = list(landings(self.commands, len(logs))) if self.commands is not None else []
            for k, part in enumerate(logs):
                part.write.parquet(f"{self.base}/log/{k}")
                if self.commands is not None:
                    given = asked[k] if k < len(asked) else self.commands.limit(0)
                    given.select("ip", "jail", "ts", "seq", F.col("cmd").alias("kind")).write.parquet(f"{self.base}/commands/{k}")
                out = self._go(policies[min(k, len(policies) - 1)], initial)
        return self.spark.read.schema(out.schema).parquet(f"{self.base}/out")


def tracked(spark: SparkSession, sf_dir: str, parts: int = LANDINGS) -> DataFrame:
    return Replay(spark, list(V.STANDARD), log_rows(spark, sf_dir)).run(V.STANDARD, parts=parts)


def across_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part is taken before the change of policies is known; the stream is then started again with both versions."""
    before: Policies = [(0, V.JAILS)]
    return Replay(spark, list(V.JAILS), log_rows(spark, sf_dir)).run(before, [*before, (V.T1, V.LATER)])


def commanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual commands as a second input of the stream."""
    return Replay(spark, list(V.STANDARD), log_rows(spark, sf_dir), V.commands(spark, sf_dir)).run(V.STANDARD)


def restored(spark: SparkSession, sf_dir: str, start: DataFrame, since: int) -> DataFrame:
    """The stream of later lines, from the ban state of an earlier run."""
    return Replay(spark, list(V.STANDARD), log_rows(spark, sf_dir).filter(F.col("ts") >= since)).run(V.STANDARD, initial=start)


def feed(changes: DataFrame, path: str, checkpoint: str) -> None:
    """A stream of changes (kind, ip, jail, banned_at, ban_time) to text files of notifications, until all of it has been read.

    Files are committed once per batch, so a consumer that delivers them further sees each notification once.
    """
    lines = notifications(changes)
    lines.writeStream.format("text").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def notifications(changes: DataFrame) -> DataFrame:
    named = changes.filter("kind IN ('ban', 'unban')").withColumn("ts", F.col("banned_at"))
    return reports.payloads(named, sorted(V.STANDARD)).select("payload")


def fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notifications of the tracker's stream of bans and unbans, written by a second stream that follows its files."""
    changes = tracked(spark, sf_dir)
    base = folder(spark, "feed")
    stream = spark.readStream.schema(changes.schema).parquet(_folder_of(changes))
    feed(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.text(f"{base}/out").withColumnRenamed("value", "payload")


def _folder_of(df: DataFrame) -> str:
    """The folder of a table of files."""
    return df.inputFiles()[0].rsplit("/", 1)[0]
